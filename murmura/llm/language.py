"""Language identification by interpolated Kneser-Ney character models, one for each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kneser_ney as KN
from murmura.llm.common import Sent, doc_hash, given, mapped

ORDER, BITS = 3, 7
#: Entries of all models together at most, 16 bytes each, as they are broadcast; more are an error, not a silent cut.
MOST_ENTRIES = 1 << 26
#: One in so many learning texts, by a hash of its id, is kept from the models and sets the bounds of rejection.
CALIBRATE = 10
#: Allowance for short texts: so many nats over the square root of the characters come off the cross-entropy before it is compared with a bound.
SLACK = 1.0


def train(docs: DataFrame) -> dict[str, KN.Model]:
    """A model for each non-null ``lang`` (doc_id, text, lang; other columns are ignored), from all its whole texts but those kept for calibration.

    At most 2.1 million n-grams a language, as many as its texts hold. A language
    with texts for calibration alone has no model; null texts count nothing; repeated
    rows count repeatedly; an empty table gives no models.
    """
    learn = docs.filter("lang is not null").filter(doc_hash() % CALIBRATE != 0)
    counts = KN.count(learn, "lang", KN.letter_alphabet(), ORDER, BITS)
    size = counts.count()
    if 3 * size > MOST_ENTRIES:
        raise ValueError(f"{size} n-grams; the models are broadcast, and {MOST_ENTRIES} entries are the most")
    table = counts.toArrow()
    names, code, n = table["grp"].to_pandas(), table["code"].to_numpy(), table["n"].to_numpy()
    return {x: KN.build(code[own], n[own], ORDER, BITS) for x, own in sorted(names.groupby(names).indices.items())}


def predict(docs: DataFrame, models: dict[str, KN.Model], bounds: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, excess, rejected for each row; only the text is looked at, other columns are ignored.

    lang_pred is the language of the least cross-entropy a character, over the whole
    text; ``und`` for a null text, one without a letter, or when there is no model.
    score is its share of the evidence: a softmax of the cross-entropies times the
    square root of the length, 0 for ``und``. excess is the
    cross-entropy less SLACK; rejected: ``und``, or an excess above the language's bound. Ties go to the name that sorts first. Null ids and
    repeated rows keep their rows; an empty table gives none.
    """
    names = sorted(models)
    shared = Sent(docs.sparkSession, ([models[x] for x in names] or [KN.build(np.zeros(0, np.int64), np.zeros(0, np.int64), ORDER, BITS)], bounds or {}))
    alphabet = KN.letter_alphabet()

    def kernel(rows, buf, off):
        known, limit = shared.value
        loss, n = KN.losses(known, buf, off, alphabet)
        best = loss.argmin(1)
        least = loss[np.arange(len(n)), best]
        share = 1 / np.exp((least[:, None] - loss) * np.sqrt(np.maximum(n, 1))[:, None]).sum(1)
        ok = np.array(rows.column(2).fill_null(False)) & bool(names)
        excess = least - SLACK / np.sqrt(np.maximum(n, 1))
        top = np.array([limit.get(x, np.inf) for x in names] or [np.inf])[best]
        return [rows.column(0), pa.array([names[j] if good else "und" for j, good in zip(best, ok)], pa.string()), np.where(ok, share, 0.0), pa.array(least, mask=~ok), pa.array(excess, mask=~ok), ~ok | (excess > top)]

    asked = given(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return mapped(asked, kernel, "doc_id long, lang_pred string, score double, cross_entropy double, excess double, rejected boolean")


def calibrate(docs: DataFrame, models: dict[str, KN.Model], keep: float = 0.99) -> dict[str, float]:
    """Bounds of the excess by language, such that a new text of the language passes with a chance of ``keep`` at least.

    Of n texts of ``docs`` that train() left out, the bound is the ceil(keep * (n + 1))th
    by excess, in hundredths of a nat; where n is too small for that rank, as for a
    language that no such text is taken for, there is none and nothing is rejected.
    Null texts and texts without a letter are left out; an empty table gives no bounds.
    """
    found = predict(docs.filter("lang is not null").filter(doc_hash() % CALIBRATE == 0), models)
    found = found.filter("excess is not null").groupBy("lang_pred", F.ceil(F.col("excess") * 100).alias("bin")).agg(F.count("*").alias("n"))
    bounds, order = {}, found.orderBy("lang_pred", "bin").collect()  # a few hundred bins a language
    for lang in {r.lang_pred for r in order}:
        own = [r for r in order if r.lang_pred == lang]
        below = np.cumsum([r.n for r in own])
        rank = int(np.ceil(keep * (below[-1] + 1)))
        if rank <= below[-1]:
            bounds[lang] = own[int(np.searchsorted(below, rank))].bin / 100
    return bounds
