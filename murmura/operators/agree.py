"""Agreement of two raters: confusion, kappa, correlations, ranks, percentiles, cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.records import numbered
from murmura.operators.selection import percentiles  # noqa: F401  part of this module's interface


def confusion(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn and n of 0/1 ratings; a is the truth. Other values, and without keys no ratings at all, raise an error."""
    ok = F.assert_true(F.coalesce(F.col(a).isin(0, 1) & F.col(b).isin(0, 1), F.lit(False)), "ratings are 0 or 1")
    seen = pairs.withColumn("checked", ok)
    cell = lambda x, y: F.sum(((F.col(a) == x) & (F.col(b) == y) & F.col("checked").isNull()).cast("long"))
    found = seen.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), F.count("*").alias("n"))
    return found if keys else found.withColumn("some", F.assert_true(F.col("n") > 0, "there are no ratings")).filter("some is null").drop("some")


def agreement(cells: DataFrame) -> DataFrame:
    """Adds agreement (share of equal ratings) and kappa, null where expected agreement is 1 to 1e-15."""
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    observed = (tp + tn) / n
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return cells.withColumns({"agreement": observed, "kappa": F.when(F.abs(1 - expected) > 1e-15, F.try_divide(observed - expected, 1 - expected))})


def pearson(pairs: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """r by group; null under two pairs, with infinite or missing values among them, or without variance."""
    bad = F.max((F.col(x).isNull() | F.col(y).isNull() | F.isnan(F.col(x).cast("double")) | F.isnan(F.col(y).cast("double")) | F.abs(x).isin(float("inf")) | F.abs(y).isin(float("inf"))).cast("int"))
    flat = (F.coalesce(F.var_pop(x), F.lit(0.0)) <= 1e-30) | (F.coalesce(F.var_pop(y), F.lit(0.0)) <= 1e-30)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.count("*") >= 2) & (bad == 0) & ~flat, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))).alias("r"))


def average_rank(value: str, keys: list[str]) -> Column:
    """1-based rank within keys; ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def spearman(pairs: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson's r of the average ranks."""
    ranked = pairs.withColumns({"rank_x": average_rank(x, keys), "rank_y": average_rank(y, keys)})
    return pearson(ranked, "rank_x", "rank_y", keys).withColumnRenamed("r", "rho")


def accuracy_gap(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean and largest absolute difference, in percentage points, of two accuracies over the groups."""
    by = pairs.groupBy(*keys).agg((F.avg(a) * 100).alias("x"), (F.avg(b) * 100).alias("y"))
    return by.agg(F.count("*").alias("groups"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_gap"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_gap"))


def cluster_bootstrap(pairs: DataFrame, a: str, b: str, cluster: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile intervals (2.5 and 97.5) of agreement and kappa, drawing whole clusters with replacement.

    Clusters are numbered, range by range, and reduced to their four counts first, so
    a replicate handles one row a cluster; draws are hashes of (seed, replicate, draw),
    the same on any cluster and in any engine with md5. Replicates without a kappa are
    counted.
    """
    cells = confusion(pairs, a, b, [cluster])
    number = F.col("number") - 1
    found = numbered(cells, [cluster], "number").select(*cells.columns, number.alias("number"))
    size = cells.agg(F.count("*").alias("clusters"))
    spark = pairs.sparkSession
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").join(size).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("clusters")
    weights = draws.groupBy("replicate", pick.alias("number")).agg(F.count("*").alias("times"))
    met = weights.join(found, "number")
    sums = met.groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn", "tn", "n")))
    return _intervals(sums)


def _intervals(sums: DataFrame) -> DataFrame:
    """replicates, invalid and the percentile intervals of agreement and kappa, of a row of counts for each replicate."""
    found = agreement(sums)
    at = F.array(F.lit(0.025), F.lit(0.975))
    done = found.agg(F.count("*").alias("replicates"), F.sum(F.col("kappa").isNull().cast("long")).alias("invalid"), F.percentile("agreement", at).alias("a"), F.percentile("kappa", at).alias("k"))
    return done.select("replicates", "invalid", *(F.round(F.col(c)[i], 6).alias(n) for c, i, n in (("a", 0, "agreement_low"), ("a", 1, "agreement_high"), ("k", 0, "kappa_low"), ("k", 1, "kappa_high"))))


#: Clusters of a leaf, whose draws are dealt out at once.
LEAF = 1024


def _leaf_draws(leaf: int, clusters: int, replicates: int, seed: int, known: dict) -> np.ndarray:
    """How many of each replicate's draws fall on a leaf's clusters: from the root of a tree over all leaves, each node halves its draws by a binomial that its place decides."""
    low, high, draws = 0, -(-clusters // LEAF), np.full(replicates, clusters, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        if (low, high) not in known:
            left = (middle - low) * LEAF / (min(high * LEAF, clusters) - low * LEAF)
            known[low, high] = np.random.default_rng([seed, low, high]).binomial(draws, left)
        draws, low, high = (known[low, high], low, middle) if leaf < middle else (draws - known[low, high], middle, high)
    return draws


def bootstrap_sums(numbered_cells: DataFrame, columns: list[str], clusters: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, draws, columns): the sums of each replicate's ``clusters`` draws with replacement, from rows of clusters numbered from 0.

    A leaf of consecutive clusters gets its number of draws by binomial splitting and
    deals them out by a multinomial, exactly as drawing one by one would; a task adds
    up all its leaves and passes on one row a replicate, however many clusters there
    are. What is drawn depends on the seed and the numbers alone, not on partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        sums, held = np.zeros((replicates, 1 + len(columns)), np.int64), {}

        def add(leaf: int) -> None:
            number, cells = (np.concatenate(x) for x in zip(*held.pop(leaf)))
            size = min(LEAF, clusters - leaf * LEAF)
            draws = _leaf_draws(leaf, clusters, replicates, seed, known)
            weights = np.random.default_rng([seed, leaf]).multinomial(draws, np.full(size, 1 / size))
            sums[:, 0] += draws
            sums[:, 1:] += weights[:, number - leaf * LEAF] @ cells

        for batch in batches:
            number = batch.column(0).to_numpy()
            cells = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            for leaf in np.unique(number // LEAF).tolist():
                for before in [x for x in held if x != leaf]:
                    add(before)
                on = number // LEAF == leaf
                held.setdefault(leaf, []).append((number[on], cells[on]))
        for leaf in list(held):
            add(leaf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *(pa.array(x) for x in sums.T)], ["replicate", "draws", *columns])

    leaf = F.floor(F.col("number") / LEAF)
    rows = numbered_cells.select("number", *(F.col(c).cast("long").alias(c) for c in columns)).repartition(leaf).sortWithinPartitions("number")
    fields = ", ".join(f"{c} long" for c in ("replicate", "draws", *columns))
    return rows.mapInArrow(run, fields).groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("draws", *columns)))


def cluster_bootstrap_large(pairs: DataFrame, a: str, b: str, cluster: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """cluster_bootstrap() for any number of clusters: draws of bootstrap_sums() in place of one hash a draw. No clusters give no replicates."""
    cells = numbered(confusion(pairs, a, b, [cluster]), [cluster], "number", 0)
    clusters = cells.count()
    sums = bootstrap_sums(cells, ["tp", "fp", "fn", "tn", "n"], clusters, replicates, seed)
    return _intervals(sums.filter(F.lit(clusters > 0)))
