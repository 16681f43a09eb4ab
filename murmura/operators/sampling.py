"""Samples that a seed fixes: rows in the order of a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.records import numbered


def draw(seed: int, *columns: str) -> Column:
    """The row's place in the lottery: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, fewer if there are fewer; a bounded top-n, not a full sort."""
    return rows.withColumn("lot", draw(seed, key)).orderBy("lot", key).limit(n).drop("lot")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int, without: DataFrame | None = None) -> DataFrame:
    """n rows of each stratum, without the keys of ``without``."""
    left = rows if without is None else rows.join(without.select(key).distinct(), key, "left_anti")
    order = Window.partitionBy(*strata).orderBy(draw(seed, key), key)
    return left.withColumn("lot", F.row_number().over(order)).filter(F.col("lot") <= n).drop("lot")


def offset_pick(rows: DataFrame, key: str, order: list[str], seed: int) -> DataFrame:
    """One row of each key: the one whose place by ``order`` a hash of the key chooses."""
    part = Window.partitionBy(key)
    place = F.row_number().over(part.orderBy(*order)) - 1
    wanted = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") % F.count("*").over(part)
    return rows.withColumns({"place": place, "wanted": wanted}).filter("place = wanted").drop("place", "wanted")


def opaque_ids(rows: DataFrame, key: str, seed: int, prefix: str = "HV") -> DataFrame:
    """Shuffled numbers as ids of six digits, numbered range by range."""
    found = numbered(rows.withColumn("lot", draw(seed, key)), ["lot", key], "number")
    return found.select(*rows.columns, F.format_string(f"{prefix}%06d", F.col("number")).alias("opaque_id"))


def primary_sample(rows: DataFrame, strata: list[str], question: str, order: list[str], n: int, seed: int, populations: dict | None = None) -> DataFrame:
    """n distinct questions of each stratum, and of each of them one record, at a hashed offset into its records by ``order``.

    populations, if given, states how many distinct questions each stratum (of one
    column) must have; another number is an error.
    """
    asked = rows.select(*strata, question).distinct()
    if populations is not None:
        wanted = F.create_map(*(F.lit(x) for kv in populations.items() for x in kv))
        counts = asked.groupBy(*strata).agg(F.count("*").alias("n"))
        bad = counts.withColumn("ok", F.assert_true(F.coalesce(F.try_element_at(wanted, F.col(strata[0])), F.lit(-1)) == F.col("n"), "question population mismatch"))
        asked = asked.join(bad.filter("ok is null").select(*strata), strata)
    chosen = stratified_sample(asked, strata, question, n, seed)
    return offset_pick(rows.join(chosen, [*strata, question], "left_semi"), question, order, seed)


def diagnostic_sample(rows: DataFrame, stratum: str, question: str, record: str, n: int, seed: int, without: DataFrame) -> DataFrame:
    """n distinct questions of each stratum, one record of each: the least by a hash of the record, as likely as any other.

    Records of ``without`` (by ``record``) are left out first. A stratum with fewer
    than n questions is an error.
    """
    left = rows.filter(F.col(stratum).isNotNull()).join(without.select(record).distinct(), record, "left_anti")
    asked = left.select(stratum, question).distinct()
    few = asked.groupBy(stratum).agg(F.count("*").alias("n_questions")).withColumn("ok", F.assert_true(F.col("n_questions") >= n, "a stratum has too few questions"))
    chosen = stratified_sample(asked.join(few.filter("ok is null").select(stratum), stratum), [stratum], question, n, seed)
    picked = left.join(chosen, [stratum, question], "left_semi")
    order = Window.partitionBy(stratum, question).orderBy(draw(seed, record), record)
    return picked.withColumn("lot", F.row_number().over(order)).filter("lot = 1").drop("lot")


def diagnostic_stratum(dataset: Column, judge: Column, official: Column, extracted: Column) -> Column:
    """Where a judge says 1 and the official metric 0: whether extraction rescues the answer; null elsewhere."""
    names = [("e2ewtq", "E2E"), ("ottqa", "OTT")]
    stratum = F.lit(None).cast("string")
    for data, short in names:
        here = (dataset == data) & (judge == 1) & (official == 0)
        stratum = F.when(here, F.when(extracted == 1, f"{short}_EXTRACTION_RESCUED").otherwise(f"{short}_PERSISTENT_DISAGREEMENT")).otherwise(stratum)
    return stratum


def id_order(id_column: str) -> list[Column]:
    """Sort key of mixed ids: whole numbers first, by value, then the others as text."""
    number = F.expr(f"try_cast({id_column} as bigint)")
    return [number.isNull(), number, F.col(id_column)]
