"""What the operators share: sessions, shared folders, texts in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.sources.shared import scratch

#: Bytes of text that a kernel takes at once; a longer text makes a slice of its own.
SLICE = 512 << 10


def ship() -> None:
    """Functions of this package travel inside the tasks, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules["murmura"])


class Sent:
    """A broadcast value whose class executors need not have: pickled as bytes with its code, and made once in each worker process."""

    def __init__(self, spark: SparkSession, value: object):
        ship()
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self._bytes, "_made"):
            self._bytes._made = cloudpickle.loads(self._bytes.value)
        return self._bytes._made


#: Shuffle files go as soon as the query that made them is done; what it wrote is all that is read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: computed once, and no executor's loss costs it."""
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(partition_by) if partition_by else df.write).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing will read again."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def given(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs``, doc_id as a long: kernels pass ids on as they come. An id that is no whole number is an error, not a null."""
    kind = dict(docs.dtypes).get("doc_id")
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be a whole number, not {kind}")
    return docs.select(*(F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in columns))


def size_hint(df: DataFrame) -> int:
    """Bytes of the files a plan reads, by the optimizer's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows, about ``most`` bytes of text at a time: the rows, buf and off."""
    for batch in batches:
        buf, off = K.layout(batch.column(batch.schema.get_field_index(text)))
        for a, b in K.slices(off, most):
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]


def mapped(df: DataFrame, kernel: Callable, schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over slices of rows. kernel(rows, buf, off) returns the columns in order."""
    ship()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for rows, buf, off in by_slices(batches, text):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in kernel(rows, buf, off)], names)

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, keep: Callable, text: str = "text") -> DataFrame:
    """The rows for which keep(rows, buf, off) is true, with all their columns; one map, no shuffle."""
    ship()

    def run(batches):
        for rows, buf, off in by_slices(batches, text):
            yield rows.filter(pa.array(keep(rows, buf, off)))

    return df.mapInArrow(run, df.schema)


def doc_hash(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def strings(parts: list[str]) -> pa.Array:
    return pa.array(parts, pa.string())
