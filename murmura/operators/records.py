"""Joins between the study's records: contexts, representations, questions, results, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import truncate_tokens
from murmura.operators.cost import quarter_length
from murmura.sources.shared import scratch


def injected_tables(contexts: DataFrame, representations: DataFrame, most_tokens: int | None = None, first: int | None = None) -> DataFrame:
    """(query_id, tables): the representations of each context's ids, in the order of the context; ids without one drop out.

    contexts: query_id, injection; representations: id, representation; ids compare
    as text. Repeated ids give repeated tables. most_tokens cuts each text, first
    takes that many ids of a context. A context without any table keeps an empty list.
    """
    asked = contexts.select("query_id", F.posexplode_outer(F.slice("injection", 1, first) if first else F.col("injection")).alias("position", "id"))
    text = F.col("representation") if most_tokens is None else truncate_tokens(F.col("representation"), most_tokens, mixed=True)
    known = representations.select(F.col("id").cast("string").alias("id"), text.alias("representation"))
    met = asked.select("query_id", "position", F.col("id").cast("string").alias("id")).join(known, "id", "left")
    found = F.collect_list(F.when(F.col("representation").isNotNull(), F.struct("position", "representation")))
    return met.groupBy("query_id").agg(F.transform(F.array_sort(found), lambda x: x["representation"]).alias("tables"))


def filled_tokens(results: DataFrame, asked: DataFrame, contexts: DataFrame, representations: DataFrame) -> DataFrame:
    """``results`` with tokens estimated where either count is missing or zero: the answer's, and those of the question followed by its injected tables.

    results: query_id, answer, request_tokens, response_tokens; asked: query_id,
    question; contexts and representations as in injected_tables(). A result whose
    question or context is unknown has 0 request tokens. Rows with both counts stay.
    """
    tables = injected_tables(contexts, representations).select("query_id", F.concat_ws("", "tables").alias("joined"))
    prompts = asked.select("query_id", F.coalesce("question", F.lit("")).alias("question")).join(tables, "query_id").select("query_id", F.concat("question", "joined").alias("prompt"))
    known = F.coalesce((F.col("request_tokens") > 0) & (F.col("response_tokens") > 0), F.lit(False))
    met = results.join(prompts, "query_id", "left")
    request = F.when(F.col("prompt").isNotNull(), quarter_length(F.col("prompt"))).otherwise(F.lit(0).cast("long"))
    return met.select(
        *(c for c in results.columns if c not in ("request_tokens", "response_tokens")),
        F.when(known, F.col("request_tokens")).otherwise(request).cast("long").alias("request_tokens"),
        F.when(known, F.col("response_tokens")).otherwise(quarter_length(F.col("answer"))).cast("long").alias("response_tokens"),
        (~known).alias("filled"),
    )


def by_question(retrieved: DataFrame, asked: DataFrame, order: list[str], last: bool = False) -> DataFrame:
    """``retrieved`` (question, ...) with the query_id of the first, or last, question of equal text by ``order``; rows without one drop out."""
    pick = F.max_by if last else F.min_by
    one = asked.groupBy("question").agg(pick("query_id", F.struct(*order)).alias("query_id"))
    return retrieved.join(one, "question")


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, and its place among those that are kept; the order of first sight is kept by that number."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    return numbered(first, order, "place")


#: Rows of a range of numbered(), about.
ROWS = 1 << 20


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written in the ascending order of the named columns, nulls first, with the columns _range and _in: the number of a row's range, and its place there.

    Ranges are cut by a sample over all the named columns together, so a leading value
    that most rows have is spread over as many ranges as it fills; there is a range for
    about every ROWS rows. Rows equal in all of them keep to one range.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    by = [F.col(c).asc_nulls_first() for c in order]
    rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    place = F.col("_at")
    return spark.read.parquet(path).withColumn("_range", F.shiftright(place, 33)).withColumn("_in", place.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Adds each row's place in the ascending order of the named columns, without one task for all rows: its place in its range, and the rows of the ranges before. Nulls come first."""
    local = ranged(rows, order)
    sizes = local.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # a row for each range
    return local.join(F.broadcast(before), "_range").withColumn(name, F.col("_in") + F.col("_before") + F.lit(start)).drop("_range", "_in", "_before")


def blinded(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Only the identity columns: what a selection may see of a record."""
    return rows.select(*identity)


def identity_join(rows: DataFrame, scores: DataFrame, identity: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the scores of equal identity, null where there is none; identities compare null-safe, a repeated one takes the greatest values."""
    one = scores.groupBy(*identity).agg(F.max(F.struct(*columns)).alias("_s")).select(*(F.col(c).alias(f"_{c}") for c in identity), "_s")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(one, same, "left").select(*rows.columns, *(F.col(f"_s.{c}").alias(c) for c in columns))


def united(primary: DataFrame, diagnostic: DataFrame, identity: list[str], names: tuple[str, str]) -> DataFrame:
    """Both samples with the column membership. A record in both is an error."""
    both = primary.withColumn("membership", F.lit(names[0])).unionByName(diagnostic.withColumn("membership", F.lit(names[1])), allowMissingColumns=True)
    twice = both.groupBy(*identity).agg(F.countDistinct("membership").alias("_n")).filter("_n > 1").agg(F.count("*").alias("_overlap"))
    return both.join(twice).withColumn("_ok", F.assert_true(F.col("_overlap") == 0, "the samples overlap")).filter("_ok is null").drop("_overlap", "_ok")


def overlap(primary: DataFrame, diagnostic: DataFrame, identity: list[str]) -> DataFrame:
    """One row: how many identities both samples hold."""
    return primary.select(*identity).intersect(diagnostic.select(*identity)).agg(F.count("*").alias("overlap_count"))


def expanded(records: DataFrame, draws: DataFrame, cluster: str, order: list[str]) -> DataFrame:
    """Every record of each drawn cluster: draws (draw, cluster) in their order, a cluster's records in theirs; a cluster drawn twice comes twice."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(*order)).cast("long")
    return draws.join(records.withColumn("place", place), cluster)


def slice_of(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the wanted values, or are among them where a list is given."""
    for name, value in wanted.items():
        rows = rows.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows


def numeric(rows: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """Text columns as numbers, null where they are none; rows without a needed value go."""
    return rows.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in columns}).dropna(subset=needed)


def resumable(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not among those done; nulls compare as equal."""
    same = F.lit(True)
    past = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return todo.join(past, same, "left_anti")


def answered(rows: DataFrame, column: str = "answer") -> DataFrame:
    """``rows`` as they are; an empty or missing answer is an error, as no label can rest on it."""
    ok = F.assert_true(F.coalesce(F.trim(column), F.lit("")) != "", "a record has no answer")
    return rows.withColumn("_ok", ok).filter("_ok is null").drop("_ok")


def share_within(rows: DataFrame, value: Column, keys: list[str], name: str = "percent") -> DataFrame:
    """Adds each row's share of its group in percent, 0 where the group sums to zero: the height of a bar in a stack of 100."""
    return rows.withColumn(name, F.coalesce(F.try_divide(100.0 * value, F.sum(value).over(Window.partitionBy(*keys))), F.lit(0.0)))
