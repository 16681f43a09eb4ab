"""Tables that are upserted: rows in buckets of their key, and a manifest for each version that says which files hold which bucket.

An upsert reads and rewrites the buckets that its rows fall into and leaves the others'
files where they are. Its version counts once the manifest is there, which appears under
its final name in one step; a write that fails before leaves the version before as it
was. Old versions stay readable until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.robustness import latest
from murmura.sources.shared import drop, exists, names_under, rename, write_text

#: Buckets of a new table; a manifest has a line for each at most.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made this version in the meantime."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names_under(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(("_", "."))]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """keys, schema, buckets, and under files the folder of each bucket that has rows, of a version, the last one if none is named."""
    at = versions(spark, path)[-1] if version is None else version
    lines = spark.read.text(f"{path}/manifests/{at:08d}.json").collect()  # BUCKETS folders at most
    return json.loads("".join(r.value for r in lines))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named."""
    m = manifest(spark, path, version)
    return _rows(spark, path, m, list(m["files"])).drop("_bucket")


def _rows(spark: SparkSession, path: str, m: dict, buckets: list[str]) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(m["schema"])
    folders = sorted({f"{path}/{m['files'][b]}/_bucket={b}" for b in buckets if b in m["files"]})
    if not folders:
        return spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
    return spark.read.schema(schema).parquet(*folders).withColumn("_bucket", F.lit(0))


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version_column: str, buckets: int = BUCKETS) -> int:
    """Puts rows into the table, or begins it: of equal keys the row of the highest ``version_column`` stays. The number of the new version.

    Equal keys include null ones. Keys and the number of buckets are those the table
    began with. One writer at a time: the second of two that start from the same
    version is refused with Conflict.
    """
    before = versions(spark, path)
    m = manifest(spark, path, before[-1]) if before else {"keys": keys, "buckets": buckets, "schema": json.loads(new.schema.json()), "files": {}}
    if m["keys"] != keys:
        raise ValueError(f"the table's keys are {m['keys']}")
    number = before[-1] + 1 if before else 0
    bucket = F.pmod(F.xxhash64(*keys), F.lit(m["buckets"])).cast("int")
    columns = [f["name"] for f in m["schema"]["fields"]]
    rows = new.select(*columns).withColumn("_bucket", bucket)
    touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]
    old = _rows(spark, path, m, touched).withColumn("_bucket", bucket)
    folder = f"data/{number:08d}-{uuid.uuid4().hex[:8]}"
    latest(old, rows, keys, version_column).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    files = m["files"] | {b: folder for b in touched}
    commit(spark, path, number, m | {"files": files})
    return number


def commit(spark: SparkSession, path: str, number: int, m: dict) -> None:
    """Makes a manifest the table's version ``number``."""
    name = f"{path}/manifests/{number:08d}.json"
    aside = f"{path}/manifests/_{uuid.uuid4().hex}"
    write_text(spark, aside, json.dumps(m))
    if exists(spark, name) or not rename(spark, aside, name):
        drop(spark, aside)
        raise Conflict(f"version {number} of {path} is taken")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all versions but the last ``keep``, and the files that only they have; how many folders went."""
    every = versions(spark, path)
    stay = {f for v in every[-keep:] for f in manifest(spark, path, v)["files"].values()}
    for v in every[:-keep]:
        drop(spark, f"{path}/manifests/{v:08d}.json")
    gone = [n for n in names_under(spark, f"{path}/data") if f"data/{n}" not in stay]
    for n in gone:
        drop(spark, f"{path}/data/{n}")
    return len(gone)
