"""Quality rules: counts, repetition, and the perplexity of a Kneser-Ney character model within bands of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm import kneser_ney as KN
from murmura.llm.common import Sent, filtered, given, mapped, stored

ORDER, BITS = 4, 6
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Half a band's width: so many median deviations up and down, at least so many nats, and an allowance for short texts. On labelled texts, wider ones keep more poor texts, narrower ones lose good ones.
UP, DOWN, LEAST, SHORT = 5.0, 4.0, 0.06, 1.0
#: A language's band is drawn to that of all texts as if these were so many of its own.
PRIOR = 30.0
#: Texts that are judged by their letters besides. Asked of all labelled texts at sf0.1, the letters' bands would lose 98 of 3,243 good ones for their digits and signs.
MOSTLY_FOLDED = "2 * n_folded > n_scored"
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _counts(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    on = ~K.BLANK[buf]
    start, end, first = K.runs(on, off)
    n = np.diff(first)
    chars = K.segment_sum(on & ((buf & 0xC0) != 0x80), off)
    symbols = K.segment_sum(SYMBOL[buf], off)
    pre = K.prefix_hash(buf)
    newline = np.flatnonzero(buf == 0x0A)
    heads = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], newline + 1]))
    heads = heads[heads < len(buf)]
    stops = np.minimum(np.append(newline, len(buf))[np.searchsorted(newline, heads)], off[np.searchsorted(off, heads, "right")])
    worded = np.concatenate([[0], np.cumsum(on)])
    with_word = worded[stops] > worded[heads]
    heads, stops = heads[with_word], stops[with_word]
    doc = np.searchsorted(off, heads, "right") - 1
    line = K.mix(K.span_hash(pre, heads, stops) + doc.astype(np.uint64) * np.uint64(K.BASES[1]))
    dup = np.ones(len(line), bool)
    dup[np.unique(line, return_index=True)[1]] = False
    dups = np.bincount(doc[dup], minlength=len(n))
    word = K.span_hash(pre, start, end)
    of = np.repeat(np.arange(len(n)), n)
    gram = K.gram_hash(word, 3)
    inside = of[2:] == of[: max(0, len(of) - 2)]
    key = K.mix(gram + of[: len(gram)].astype(np.uint64) * np.uint64(K.BASES[1]))
    hit = np.flatnonzero(K.member(key, K.repeated(key[inside])) & inside) if len(gram) else np.zeros(0, np.int64)
    covered = np.zeros(len(word), bool)
    for j in range(3):
        covered[hit + j] = True
    return [n, chars, symbols, dups, K.segment_sum(covered, first)]


def base(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each whole text (null: none): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return mapped(given(docs, "doc_id", "text", "lang"), lambda rows, buf, off: [rows.column(0), rows.column(2), *_counts(buf, off)], schema)


def language_model(docs: DataFrame) -> KN.Model:
    """Counted over every whole text. 64 symbols and order 4 bound it at 16.8 million n-grams."""
    found = KN.count(docs, None, KN.quality_alphabet(), ORDER, BITS).select("code", "n").toArrow()
    return KN.build(found["code"].to_numpy(), found["n"].to_numpy(), ORDER, BITS)


def letter_models(docs: DataFrame) -> list[KN.Model]:
    """Of the characters that the 64 symbols fold together, each as itself, counted over every whole text: their pages of 64 code points, and their places in them.

    The some 160,000 characters of Unicode lie in some 2,600 pages, which bounds the
    models at 7 and 10 million n-grams.
    """
    found = KN.count_letters(docs, KN.quality_alphabet()).toArrow()
    kind, code, n = (found[c].to_numpy() for c in ("kind", "code", "n"))
    return [KN.build(code[kind == i], n[kind == i], order, KN.PAGE, symbols) for i, order, symbols in ((0, 2, KN.PAGES), (1, 3, 64))]


def measured(docs: DataFrame, model: KN.Model, letters: list[KN.Model]) -> DataFrame:
    """base() with n_scored, the characters, and cross_entropy, nats a character (null without characters); n_folded and letter_entropy are the same for characters that share their symbol."""
    shared = Sent(docs.sparkSession, (model, letters))
    alphabet = KN.quality_alphabet()

    def kernel(rows, buf, off):
        model, letters = shared.value
        loss, n = KN.losses([model], buf, off, alphabet)
        own, folded = KN.letter_losses(letters, buf, off, alphabet)
        return [rows.column(0), rows.column(2), *_counts(buf, off), n, pa.array(loss[:, 0], mask=n == 0), folded, pa.array(own, mask=folded == 0)]

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, cross_entropy double, n_folded long, letter_entropy double"
    return mapped(given(docs, "doc_id", "text", "lang"), kernel, schema).withColumn("base_failed", F.expr(BASE_FAILED))


def bands(found: DataFrame, of: str = "cross_entropy") -> DataFrame:
    """(lang, low, high) of the column ``of`` in nats a character, for each language (null: texts without one), from the median and the median deviation of texts that pass the base rules.

    They are taken from counts of thousandths of a nat: exact, alike in any
    partitioning, and a few thousand rows for each language, however many texts.
    A language's own band and that of all texts are weighed by its texts and PRIOR.
    """
    good = found.filter(~F.col("base_failed") & F.col(of).isNotNull()).select("lang", F.round(F.col(of) * 1000).cast("long").alias("bin"))
    bins = good.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("own", F.lit(True))
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n", F.lit(False).alias("own")))
    mid = bins.groupBy("own", "lang").agg(F.expr("percentile(bin, 0.5, n)").alias("mid"), F.sum("n").alias("texts"))
    near = bins.alias("b").join(mid.alias("m"), F.expr("b.own = m.own and b.lang <=> m.lang")).select("b.own", "b.lang", "mid", "texts", "n", F.abs(F.col("bin") - F.col("mid")).alias("far"))
    spread = near.groupBy("own", "lang", "mid", "texts").agg(F.expr("percentile(far, 0.5, n)").alias("mad"))
    half = lambda times: F.greatest(times * F.col("mad"), F.lit(LEAST * 1000))
    each = spread.select("own", "lang", "texts", ((F.col("mid") - half(DOWN)) / 1000).alias("low"), ((F.col("mid") + half(UP)) / 1000).alias("high"))
    whole = each.filter("not own").select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    drawn = lambda x: (F.col("texts") * F.col(x) + PRIOR * F.col(f"{x}_all")) / (F.col("texts") + PRIOR)
    return each.filter("own").join(whole).select("lang", drawn("low").alias("low"), drawn("high").alias("high"))


def letter_bands(found: DataFrame) -> DataFrame:
    """bands() of letter_entropy, among texts most of whose characters share their symbol."""
    return bands(found.filter(MOSTLY_FOLDED), "letter_entropy")


def judged(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang; other columns are ignored): counts, base_failed, cross_entropy, perplexity, letter_entropy, their bands, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. Other texts are kept if their cross-entropy lies in the band of their
    language, widened by 1 nat over the square root of the length. The 64 symbols say
    little of a text most of whose characters share theirs, as in other scripts: its
    letter_entropy has to lie in a band too, that of such texts. Texts of null lang
    have a band of their own; every band is drawn to that of all texts, the more the
    fewer texts it rests on. A null text counts as empty and fails; null ids and
    repeated rows each keep their row; an empty table gives none.
    """
    found = stored(measured(docs, language_model(docs), letter_models(docs)))
    limits = stored(bands(found)).select(F.col("lang").alias("of_lang"), "low", "high")
    of_letters = stored(letter_bands(found)).select(F.col("lang").alias("letter_lang"), F.col("low").alias("letter_low"), F.col("high").alias("letter_high"))
    met = found.join(limits, found.lang.eqNullSafe(limits.of_lang), "left").join(of_letters, found.lang.eqNullSafe(of_letters.letter_lang), "left")

    def inside(loss: str, n: str, low: str, high: str):
        room = SHORT / F.sqrt(F.greatest(n, F.lit(1)))
        return F.coalesce(F.col(loss).between(F.col(low) - room, F.col(high) + room), F.lit(False))

    good = inside("cross_entropy", "n_scored", "low", "high") & (~F.expr(MOSTLY_FOLDED) | inside("letter_entropy", "n_folded", "letter_low", "letter_high"))
    return met.select(*found.columns, F.exp("cross_entropy").alias("perplexity"), "low", "high", "letter_low", "letter_high", (~F.col("base_failed") & good).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, any others) that judged() keeps, each by its own text: ids play no part, null and repeated ones stay.

    Model and bands first, then one map over the rows; nothing with a text is
    shuffled. Null and empty texts go, repeated rows stay or go together, an empty
    table gives an empty one. The bands are a row for each language.
    """
    model, letters = language_model(docs), letter_models(docs)
    own = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", "lang")
    found = stored(measured(own, model, letters))
    limits, of_letters = ({r.lang: (r.low, r.high) for r in x.collect()} for x in (bands(found), letter_bands(found)))
    shared = Sent(docs.sparkSession, (model, letters, limits, of_letters))
    alphabet, lang = KN.quality_alphabet(), docs.columns.index("lang")

    def inside(loss, n, limits, langs):
        low, high = np.array([limits.get(x, (np.inf, -np.inf)) for x in langs]).reshape(-1, 2).T
        room = SHORT / np.sqrt(np.maximum(n, 1))
        return (n > 0) & (loss >= low - room) & (loss <= high + room)

    def good(rows, buf, off):
        model, letters, limits, of_letters = shared.value
        n_words, _, _, _, repeats = _counts(buf, off)
        loss, n = KN.losses([model], buf, off, alphabet)
        own, folded = KN.letter_losses(letters, buf, off, alphabet)
        langs = rows.column(lang).to_pylist()
        met = inside(loss[:, 0], n, limits, langs) & ((2 * folded <= n) | inside(own, folded, of_letters, langs))
        return ~((n_words < 50) | (100 * repeats > 50 * n_words)) & met

    return filtered(docs, good)
