"""Upserted tables, exact order statistics, total orders and digests."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import audit, cost, records, selection
from murmura.sources import keyed
from murmura.sources.shared import names_under

SUMMARY = "k string, part int, v int, x string"


def table(spark, rows):
    return spark.createDataFrame(rows, SUMMARY)


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(f"k{i}", i % 3 if i % 5 else None, 1, "old") for i in range(200)]
    assert keyed.upsert(spark, path, table(spark, first), ["k", "part"], "v", buckets=16) == 0
    before = keyed.manifest(spark, path)["files"]
    files = {b: names_under(spark, f"{path}/{f}/_bucket={b}") for b, f in before.items()}
    new = [("k0", None, 2, "new"), ("k1", 1, 0, "older than what is there"), ("z", 9, 1, "added")]
    assert keyed.upsert(spark, path, table(spark, new), ["k", "part"], "v") == 1
    after = keyed.manifest(spark, path)["files"]
    same = [b for b in before if after[b] == before[b]]
    assert len(same) >= len(before) - 3 and all(names_under(spark, f"{path}/{after[b]}/_bucket={b}") == files[b] for b in same)
    want = {(r[0], r[1]): r[3] for r in first} | {("k0", None): "new", ("z", 9): "added"}
    assert {(r.k, r.part): r.x for r in keyed.read(spark, path).collect()} == want
    assert {(r.k, r.part): r.x for r in keyed.read(spark, path, 0).collect()} == {(r[0], r[1]): r[3] for r in first}
    assert keyed.vacuum(spark, path) == 0 and keyed.versions(spark, path) == [1]  # untouched buckets still lie in the first folder


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(spark, path, table(spark, [("a", 1, 1, "old"), ("b", 1, 1, "old")]), ["k", "part"], "v", buckets=4)
    broken = table(spark, [("a", 1, 2, "new"), ("b", 1, 2, "new")]).withColumn("x", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(spark, path, broken, ["k", "part"], "v")
    assert {r.x for r in keyed.read(spark, path).collect()} == {"old"} and keyed.versions(spark, path) == [0]
    keyed.upsert(spark, path, table(spark, [("a", 1, 2, "new")]), ["k", "part"], "v")
    assert {r.k: r.x for r in keyed.read(spark, path).collect()} == {"a": "new", "b": "old"}


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(spark, path, table(spark, [("a", 1, 1, "one")]), ["k", "part"], "v")
    with pytest.raises(keyed.Conflict):
        keyed.commit(spark, path, 0, keyed.manifest(spark, path))
    with pytest.raises(ValueError):
        keyed.upsert(spark, path, table(spark, [("a", 1, 1, "one")]), ["k"], "v")
    assert keyed.upsert(spark, path, table(spark, []), ["k", "part"], "v") == 1 and keyed.read(spark, path).count() == 1


@pytest.mark.parametrize("groups", [1, 3])
def test_percentiles_equal_type_7(spark, groups):
    rng = random.Random(groups)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), float(rng.randrange(5)), -0.0, 1e-300, -1e300, 0.1]) for _ in range(500)]
    rows = [(i % groups if i % 7 or groups == 1 else None, v) for i, v in enumerate(values)] + [(0, None)] * 3
    shares = [0.0, 0.025, 0.3333, 0.5, 0.975, 1.0]
    got = {(r.g, r.share): r.value for r in selection.percentiles(spark.createDataFrame(rows, "g int, v double").repartition(5), "v", shares, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = np.array([v for x, v in rows if x == g and v is not None])
        for s in shares:
            assert got[g, s] == pytest.approx(np.percentile(mine, 100 * s), rel=1e-12, abs=1e-300)
    assert len(got) == len(shares) * len({r[0] for r in rows})
    assert selection.percentiles(spark.createDataFrame([], "g int, v double"), "v", [0.5], ["g"]).count() == 0


def test_percentiles_of_one_group_without_keys(spark):
    rows = spark.range(10_001).select(((F.col("id") * 7919) % 10_007).alias("v"))
    got = {r.share: r.value for r in selection.percentiles(rows, "v", [0.25, 0.5], []).collect()}
    mine = np.array([(i * 7919) % 10_007 for i in range(10_001)])
    assert got == {s: np.percentile(mine, 100 * s) for s in (0.25, 0.5)}


def test_token_stats_with_a_null_key(spark):
    found = cost.token_stats(spark.createDataFrame([(None, 5), (None, 2), ("a", None)], "g string, t int"), ["g"], "t")
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 0, 0.0, 0.0, 0, 0), (None, 7, 3.5, 3.5, 2, 5)]


def test_one_leading_value_does_not_fill_one_range(spark):
    rows = spark.range(20_000).select(F.lit("same").alias("lead"), (F.col("id") * 7919 % 20_011).alias("then"))
    sizes = [r["count"] for r in records.ranged(rows, ["lead", "then"]).groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 0.5 * 20_000
    got = records.numbered(rows, ["lead", "then"], "n").collect()
    assert [r.then for r in sorted(got, key=lambda r: r.n)] == sorted(r.then for r in got) and sorted(r.n for r in got) == list(range(1, 20_001))


def test_digest_of_a_sorted_list(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('x"é'), F.col("id").cast("string"))).alias("t")).repartition(7)
    want = "[" + ",".join(json.dumps({"t": f'x"é{i}' if i % 3 else None}, ensure_ascii=False, separators=(",", ":")) for i in range(2999, -1, -1)) + "]"
    found = audit.column_digest(rows.withColumn("back", -F.col("id")), ["t"], ["back"])
    assert found.first().digest == hashlib.sha256(want.encode()).hexdigest()
    assert audit.column_digest(rows.limit(0), ["t"], ["id"]).first().digest == hashlib.sha256(b"[]").hexdigest()
