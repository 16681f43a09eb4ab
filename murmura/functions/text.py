"""Column functions on texts: normalising, word bags, token estimates, parsing, scanning."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases of a refusal, in the order in which they are looked for.
REFUSALS = [
    "information is not available",
    "not available in the context",
    "not available in the provided",
    "not available in the tables",
    "isn't available",
    "is not available",
    "cannot determine",
    "cannot be determined",
    "unable to determine",
    "insufficient information",
    "not enough information",
    "cannot answer",
    "unable to answer",
    "cannot help with that",
    "can't help with that",
    "provided information does not",
    "cannot be answered from the given",
    "cannot be answered based on the given",
    "cannot be answered with the provided",
    "the provided tables do not contain",
    "none of the provided tables",
    "not possible to determine",
    "cannot find",
    "does not include information",
    "do not include information",
    "not specified in the provided",
    "additional external sources would be required",
]
# Words that a word bag leaves out.
STOPWORDS = ["the", "a", "an", "of", "in", "on", "for", "and", "or", "to", "is", "are", "was", "were"]
# Blocks that count as Chinese, Japanese or Korean, two characters to three tokens or so.
CJK_BLOCKS = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303F), (0x31C0, 0x31EF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x3134F)]
CJK = "[" + "".join(f"{chr(a)}-{chr(b)}" if b < 0x10000 else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_BLOCKS) + "]"
# Names of datasets.
DATASET_ALIASES = {"e2e-wtq": "e2ewtq", "e2e_wtq": "e2ewtq", "e2ewtq": "e2ewtq", "feta": "feta", "fetaqa": "feta", "feta-qa": "feta", "ott-qa": "ottqa", "ott_qa": "ottqa", "ottqa": "ottqa"}
# What must not be in a release.
SENSITIVE = {
    "credential": r"(?i)(sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|BEGIN (RSA |OPENSSH |EC |PGP )?PRIVATE KEY)",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "path": r"(/Users/|/home/|[A-Za-z]:[\\/]Users[\\/])",
}


def collapsed(text: Column) -> Column:
    """Lower case, trimmed, each run of white space one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), which Spark has no function for; texts already composed pass through."""
    return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


#: Characters that any text may hold and be in its NFKC form already, if it holds no others: ASCII, precomposed Latin letters, dashes, quotes, the euro.
STABLE = r"[\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018\u2019\u201C\u201D\u20AC]"


def composed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a text column in its NFKC form, in one pass. Only texts with other than STABLE characters in them meet Python; the columns keep their order."""
    plain = F.coalesce(F.col(column).rlike(rf"\A{STABLE}*+\z"), F.lit(True))
    return rows.withColumn(column, F.coalesce(nfkc(F.when(~plain, F.col(column))), F.col(column)))


def normalized(text: Column) -> Column:
    """collapsed() of the NFKC form."""
    return collapsed(nfkc(text))


def word_bag(text: Column) -> Column:
    """Distinct words, lower case, without possessive 's, wrapping quotes and stopwords, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)([\w']+)"), F.lit(1))
    bare = F.transform(words, lambda w: F.when(w.endswith("'s") & (F.char_length(w) > 2), F.substring(w, F.lit(1), F.char_length(w) - 2)).otherwise(w))
    bare = F.transform(bare, lambda w: F.when(w.startswith("'") & w.endswith("'") & (F.char_length(w) > 2), F.substring(w, F.lit(2), F.char_length(w) - 2)).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: (w != "") & ~w.isin(STOPWORDS))))


def judge(gold: Column, answer: Column, coverage: float = 0.6) -> Column:
    """1 or 0 where the lexical rules decide, null where a reader's judgment is needed."""
    g, a = (F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "") for c in (gold, answer))
    gb, ab = word_bag(g), word_bag(a)
    share = F.try_divide(F.size(F.array_intersect(gb, ab)).cast("double"), F.size(gb).cast("double"))
    return (
        F.when((g == "") & (a == ""), 1)
        .when((g == "") | (a == ""), 0)
        .when(F.contains(F.lower(a), F.lower(g)), 1)
        .when((F.size(gb) > 0) & (F.size(ab) > 0) & (share >= coverage), 1)
    )


def refusal_in(norm: Column) -> Column:
    """The first refusal phrase that a collapsed text holds, or null."""
    return F.coalesce(*(F.when(F.contains(norm, F.lit(p)), F.lit(p)) for p in REFUSALS))


def refusal(text: Column) -> Column:
    """The first refusal phrase that the collapsed text holds, or null."""
    return F.get(F.transform(F.array(collapsed(text)), refusal_in), F.lit(0))  # a lambda's variable is collapsed once, not for each phrase


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def token_estimate(text: Column) -> Column:
    """A quarter of other characters plus CJK characters over 0.7; 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    cjk = cjk_count(t)
    return (F.char_length(t) - cjk) / F.lit(4.0) + cjk / F.lit(0.7)


def token_counts(text: Column) -> Column:
    """struct(cjk, other, total, estimate): characters of either kind, all of them, and token_estimate()."""
    t = F.coalesce(text, F.lit(""))
    cjk, total = cjk_count(t), F.char_length(t)
    return F.struct(cjk.alias("cjk"), (total - cjk).alias("other"), total.alias("total"), token_estimate(text).alias("estimate"))


@F.pandas_udf(StringType())
def _truncate_mixed(text: pd.Series, most: pd.Series) -> pd.Series:
    def cut(t, limit):
        if t is None:
            return None
        cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        wide = np.zeros(len(cp), bool)
        for a, b in CJK_BLOCKS:
            wide |= (cp >= a) & (cp <= b)
        cjk = np.cumsum(wide)
        cost = (np.arange(1, len(cp) + 1) - cjk) / 4 + cjk / 0.7
        return t[: int(np.searchsorted(cost, limit, "right"))]

    return pd.Series([cut(t, m) for t, m in zip(text, most)])


def truncate_tokens(text: Column, most: int, mixed: bool = False) -> Column:
    """The longest prefix whose estimate is at most ``most``. Texts without CJK stay in the JVM, and so do those that need no cut; ``mixed`` adds the path for the others."""
    plain = F.substring(text, F.lit(1), F.lit(4 * most))
    if not mixed:
        return plain
    short = F.char_length(text) < F.lit(int(0.7 * most))  # even if all of it is CJK
    cut = ~short & (cjk_count(text) > 0) & (token_estimate(text) > most)
    # Python functions get every row, whatever the branch they stand in: rows that need no cut come as nulls
    return F.when(short, text).when(cut, _truncate_mixed(F.when(cut, text), F.lit(float(most)))).when(cjk_count(text) == 0, plain).otherwise(text)


def condition_of(name: Column) -> Column:
    """struct(k, rotation, negative) of names such as 10_middle_hard.jsonl, 1_perfect.jsonl, real_result_50.jsonl; k is 0 where none can be read."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(base, "_")
    real = base.rlike(r"^real_result_\d+$")
    k = F.when(real, F.regexp_extract(base, r"(\d+)$", 1).cast("int")).when(F.get(parts, F.lit(0)).rlike(r"^\d+$"), F.get(parts, F.lit(0)).cast("int")).otherwise(0)
    rotation = F.when(real, "real_result").when(base == "1", "").otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    negative = F.when(real, "real_result").when(base == "1_perfect", "perfect").otherwise(F.coalesce(F.get(parts, F.lit(2)), F.lit("")))
    return F.struct(k.alias("k"), rotation.alias("rotation"), negative.alias("negative"))


def feature_key(k: Column, rotation: Column) -> Column:
    """K=..,pos=.. for rotations that place gold at the start, middle or end; only K=.. for others."""
    return F.when(rotation.isin("start", "middle", "end"), F.concat(F.lit("K="), k.cast("string"), F.lit(",pos="), rotation)).otherwise(F.concat(F.lit("K="), k.cast("string")))


def error_label_of(raw: Column) -> Column:
    """One of the three failure labels, by keyword; the residual one for anything else."""
    t = collapsed(raw)
    refused = t.contains("premature") | t.contains("refusal") | t.contains("truncation")
    return F.when(t.contains("distractor"), "Distractor Extraction").when(refused, "Premature Refusal").otherwise("Reasoning Hallucination")


def dataset_name(raw: Column) -> Column:
    t = F.replace(collapsed(raw), F.lit(" "), F.lit(""))
    known = F.create_map(*(F.lit(x) for kv in DATASET_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, t), t)


def labelled_line(text: Column, label: str) -> Column:
    """What follows the last line that starts with ``label:``, trimmed, or null."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{label}\s*:\s*(.*?)\s*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def half_up(value: Column, places: int) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(value.cast(f"decimal(38,{min(18, places + 8)})"), places)
