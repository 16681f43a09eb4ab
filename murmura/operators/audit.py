"""Release audits: scans, digests, snapshots, invariants; one row a rule."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.text import SENSITIVE
from murmura.operators.records import ranged


def sensitive_scan(rows: DataFrame, column: str) -> DataFrame:
    """(pattern, n_rows): how many texts match each sensitive pattern, zero included; one pass over the texts."""
    flags = rows.agg(*(F.coalesce(F.sum(F.coalesce(F.col(column), F.lit("")).rlike(p).cast("long")), F.lit(0)).cast("long").alias(n) for n, p in SENSITIVE.items()))
    return flags.select(F.inline(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n_rows")) for n in SENSITIVE))))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text, joined by unit separators; nulls are empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of a JSON list whose elements come one after the other."""
    digest, some = hashlib.sha256(b"["), False
    for batch in batches:
        for entry in batch.column(0).to_pylist():
            digest.update(b"," * some + entry.encode())
            some = True
    digest.update(b"]")
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])


def column_digest(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: SHA-256 of the JSON list of the rows' named columns, in the given order.

    Rows are sorted in ranges, in parallel, and written; one task then reads them in
    order and folds them into the digest, which is sequential by its nature, entry by
    entry: no list of rows is ever made.
    """
    entry = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sorted_ = ranged(rows.select(*order, entry.alias("_json")), [*order, "_json"])
    found = sorted_.select("_range", "_in", "_json").repartition(1).sortWithinPartitions("_range", "_in").select("_json").mapInArrow(_folded, "digest string")
    return found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit("[]"), 256)).alias("digest"))  # no rows, no task


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and an order-free digest of a table: sums of pieces of the row digests, so that no order and no collection is needed."""
    d = rows.select(row_digest(columns).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long"))
    return d.agg(F.count("*").alias("n_rows"), *(F.coalesce(part(i), F.lit(0)).alias(f"part_{i}") for i in range(4)))


def snapshot(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table_digest() with the number of distinct keys, and whether the key is unique."""
    keys = rows.agg(F.countDistinct(key).alias("n_keys"), F.sum(F.col(key).isNull().cast("long")).alias("n_null_keys"))
    return table_digest(rows, columns).join(keys).withColumn("unique_key", (F.col("n_keys") == F.col("n_rows")))


def invariants(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) from frames that hold the violating rows."""
    found = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        found = one if found is None else found.unionByName(one)
    return found


def consistency(left: DataFrame, right: DataFrame, keys: list[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """n_left, n_right, n_unmatched and n_different of two tables that should agree on a numeric column; keys compare null-safe."""
    a = left.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(column).alias("x"), F.lit(1).alias("in_a"))
    b = right.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col(column).alias("y"), F.lit(1).alias("in_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    met = a.join(b, same, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    differs = both & ~F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance, F.col("x").isNull() & F.col("y").isNull())
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return met.agg(count(F.col("in_a").isNotNull()).alias("n_left"), count(F.col("in_b").isNotNull()).alias("n_right"), count(~both).alias("n_unmatched"), count(differs).alias("n_different"))


def zipped(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Rows of two tables side by side by their source row index; an index that one side lacks is an error, not a silent cut."""
    met = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), index, "full")
    checked = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "the tables differ in length")
    return met.withColumn("_ok", checked).filter("_ok is null").drop("_l", "_r", "_ok")
