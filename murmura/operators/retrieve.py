"""Exact cosine top-K retrieval over embeddings: the corpus stays where it is, queries come to it in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.sources.shared import drop, scratch

#: Queries that are sent to all tasks at once, vectors of a block, queries multiplied at a time, results a task holds before it keeps the best.
QUERIES, BLOCK, ROWS, HELD = 4096, 1024, 512, 1 << 18
#: Vectors that centres are trained on and rounds of training; centres at most.
SAMPLE, ROUNDS, CENTRES = 8192, 6, 256
#: Scores are rounded: what a bound may be off by and still be met.
SLACK = 2e-6


@dataclass
class Index:
    """A clustered corpus: vectors (id, embedding, centre, angle) in the order of centre and angle, and the unit centres. ``dims`` is the length that vectors must have."""

    vectors: DataFrame
    centres: np.ndarray
    dims: int


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one of the right length and not of zero, and these rows' places."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    here = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    rows = pc.list_flatten(column.filter(ok)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(dims, 1))
    size = np.linalg.norm(rows, axis=1)
    good = np.isfinite(size) & (size > 0)
    return rows[good] / size[good, None], here[good]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _trained(sample: np.ndarray) -> np.ndarray:
    """Unit centres of a sample: k-means on the sphere from evenly spaced rows."""
    many = int(min(CENTRES, max(1, len(sample) ** 0.5)))
    centres = sample[np.linspace(0, len(sample) - 1, many).astype(np.int64)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def _kind(df: DataFrame, name: str) -> str:
    return "string" if dict(df.dtypes)[name] == "string" else "long"


def _dims(df: DataFrame) -> int:
    return df.agg(F.max(F.size("embedding")).alias("n")).first().n or 0


def clustered(corpus: DataFrame) -> Index:
    """An index of ``corpus`` (id, embedding): each vector goes to its nearest centre, and all are put in order of centre and angle to it.

    Centres come from a bounded sample (SAMPLE vectors, at most CENTRES centres) and
    decide how much can be skipped, never what is found. The order is a range partition
    with the id as last key, so a crowded centre, or equal vectors, fill as many
    partitions as they need. Written to the shared folder, where it can be searched
    again and again. Missing, zero and odd-sized vectors are not in it.
    """
    spark, own, raw = corpus.sparkSession, _kind(corpus, "id"), scratch(corpus.sparkSession)
    corpus.select(F.col("id").cast(own).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).write.parquet(raw)  # read three times: made once
    rows = spark.read.parquet(raw)
    dims = _dims(rows)
    rows = rows.filter(F.size("embedding") == dims)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    units, _ = _units(sample, dims)
    centres = _trained(units) if len(units) else np.zeros((0, dims))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, here = _units(batch.column(1), dims)
            if len(here):
                angle = _angles(units, centres)
                near = np.argmin(angle, axis=1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(here)) for c in batch.columns), pa.array(near), pa.array(angle[np.arange(len(near)), near])], ["id", "embedding", "centre", "angle"])

    path = scratch(spark)
    placed = rows.mapInArrow(assigned, f"id {own}, embedding array<double>, centre long, angle double")
    placed.repartitionByRange("centre", "angle", "id").sortWithinPartitions("centre", "angle", "id").write.parquet(path)
    drop(spark, raw)
    return Index(spark.read.parquet(path), centres, dims)


def _least(asked: pa.Table, k: int) -> pa.Table:
    """Each query's best k of (q, score, id): higher scores, then smaller ids."""
    best = asked.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = best.column("q").to_numpy()
    return best.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, pa.Array, int, float, float]]:
    """Units, ids, centre, least and greatest angle of each run of rows of one centre; without an index, of each run of rows, with centre -1."""
    columns = batch.schema.names
    centre = batch.column(columns.index("centre")).to_numpy() if "centre" in columns else np.full(batch.num_rows, -1)
    angle = batch.column(columns.index("angle")).to_numpy() if "angle" in columns else np.zeros(batch.num_rows)
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(centre)) + 1, np.arange(0, batch.num_rows, BLOCK), [batch.num_rows]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        units, here = _units(batch.column(columns.index("embedding")).slice(a, b - a), dims)
        if len(here):
            yield units, batch.column(columns.index("id")).slice(a, b - a).take(pa.array(here)), int(centre[a]), float(angle[a:b].min()), float(angle[a:b].max())


def _scan(asked: np.ndarray, least: np.ndarray, angles: np.ndarray, dims: int, k: int, places: int, report: bool) -> Callable:
    """A task's pass over its vectors: a block is left out for each query whose bound there is below its k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held, rows, pairs, skipped = least.copy(), [], 0, 0, 0
        for batch in batches:
            for units, ids, centre, low, high in _blocks(batch, dims):
                on = np.arange(len(asked))
                if centre >= 0:
                    apart = np.maximum(np.maximum(angles[:, centre] - high, low - angles[:, centre]), 0)
                    on = np.flatnonzero(np.cos(apart) + SLACK >= floor)
                pairs, skipped = pairs + len(asked), skipped + len(asked) - len(on)
                for a in range(0, len(on), ROWS):
                    mine = on[a : a + ROWS]
                    sim = np.round(asked[mine] @ units.T, places) + 0.0
                    edge = sim.shape[1] - min(k, sim.shape[1])
                    q, c = np.nonzero(sim >= np.maximum(np.partition(sim, edge, axis=1)[:, edge], floor[mine])[:, None])
                    if len(q):
                        held.append(pa.table({"q": pa.array(mine[q]), "id": ids.take(pa.array(c)), "score": pa.array(sim[q, c])}))
                        rows += len(q)
                if rows > HELD:
                    held = [_least(pa.concat_tables(held), k)]
                    rows = held[0].num_rows // 2
                    q = held[0].column("q").to_numpy()
                    last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                    floor[q[last]] = np.maximum(floor[q[last]], held[0].column("score").to_numpy()[last])
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([skipped])], ["pairs", "skipped"])
        elif held:
            yield from _least(pa.concat_tables(held), k).select(["q", "id", "score"]).to_batches()

    return run


def _first_scores(index: Index, asked: np.ndarray, angles: np.ndarray, k: int, places: int) -> np.ndarray:
    """A score that each query's k-th best reaches at least: from the BLOCK vectors of the corpus that lie first around each of its nearest centres. One pass that reads nothing else."""
    near = np.unique(np.argmin(angles, axis=1))
    around = index.vectors.filter(F.col("centre").isin(near.tolist()))
    some = around.withColumn("place", F.row_number().over(Window.partitionBy("centre").orderBy("angle", "id"))).filter(F.col("place") <= max(1, BLOCK * 16 // len(near)))
    found = some.select("centre", "embedding").toArrow()
    units, here = _units(found.column("embedding").combine_chunks(), index.dims)
    least = np.full(len(asked), -np.inf)
    for a in range(0, len(asked), ROWS):
        sim = np.round(asked[a : a + ROWS] @ units.T, places) + 0.0
        if sim.shape[1] >= k:
            least[a : a + ROWS] = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    return least


def _searched(queries: DataFrame, index: Index, k: int, places: int, report: bool) -> DataFrame:
    spark = queries.sparkSession
    own, kind = _kind(queries, "query_id"), _kind(index.vectors, "id")
    asked = queries.select(F.col("query_id").cast(own).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") == index.dims)
    blocks = max(1, -(-asked.count() // QUERIES))
    schema = "pairs long, skipped long" if report else f"q long, id {kind}, score double"
    found = spark.createDataFrame([], schema if report else f"query_id {own}, id {kind}, score double")
    for i in range(blocks):
        mine = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()  # about QUERIES rows
        units, here = _units(mine.column("embedding").combine_chunks() if mine.num_rows else pa.array([], pa.list_(pa.float64())), index.dims)
        if not len(here):
            continue
        angles = _angles(units, index.centres) if len(index.centres) else np.zeros((len(units), 0))
        least = _first_scores(index, units, angles, k, places) if len(index.centres) else np.full(len(units), -np.inf)
        met = index.vectors.mapInArrow(_scan(units, least, angles, index.dims, k, places, report), schema)
        if not report:
            names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(here))), "query_id": mine.column("query_id").take(pa.array(here))}))
            met = met.join(F.broadcast(names), "q").select("query_id", "id", "score")
        if blocks > 1:  # one block of queries after another: what is sent to the tasks stays bounded
            path = scratch(spark)
            met.write.parquet(path)
            met = spark.read.parquet(path)
        found = found.unionByName(met) if blocks > 1 else met
    return found


def search(queries: DataFrame, index: Index, k: int, places: int = 6) -> DataFrame:
    """(query_id, rank, id, score): the k nearest vectors of the index for each query (query_id, embedding), by cosine, rounded; ties go to the smaller id.

    Exact. Queries go to the tasks in blocks of about QUERIES; vectors stay in their
    partitions. A run of vectors around one centre, all at angles between a and b to it,
    holds nothing nearer to a query than the triangle inequality allows; where that is
    below the query's k-th best score so far, the run is skipped for it. Each task passes
    on k rows a query at most. Ids and query ids may be numbers or text; query ids must
    be distinct. Queries without a vector, or with a zero or odd-sized one, find nothing.
    """
    found = _searched(queries, index, k, places, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def skipped(queries: DataFrame, index: Index, k: int, places: int = 6) -> DataFrame:
    """(pairs, skipped, share): how many runs of vectors search() would meet with how many queries, and for how many of these pairs it need not look."""
    found = _searched(queries, index, k, places, True).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return found.withColumn("share", F.round(F.coalesce(F.try_divide("skipped", "pairs"), F.lit(0.0)), 4))


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, places: int = 6) -> DataFrame:
    """search() over a corpus (id, embedding) as it lies, without an index: one scan for each block of queries, nothing skipped, no vector moved."""
    rows = corpus.select(F.col("id").cast(_kind(corpus, "id")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return search(queries, Index(rows, np.zeros((0, 0)), _dims(queries)), k, places)


def tag_gold(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """retrieved with is_gold: whether (query_id, id) is among the gold pairs."""
    marked = gold.select("query_id", "id").distinct().withColumn("is_gold", F.lit(True))
    return retrieved.join(marked, ["query_id", "id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
