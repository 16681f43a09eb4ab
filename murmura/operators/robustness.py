"""Scores under noise: accuracy, trial spread, noise retention, noise ceilings, position effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(trials: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy (share of score 1, six places) and accuracy_4dp of each group."""
    share = F.avg(F.when(F.col("score") == 1, 1.0).otherwise(0.0))
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), F.round(share, 6).alias("accuracy"), F.round(share, 4).alias("accuracy_4dp"))


def latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: of rows with equal keys in either table, the one of the highest version."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def trial_spread(trials: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """n_runs, mean, sample deviation and standard error of the run scores of each group; deviations need two runs."""
    runs = trials.groupBy(*keys, run).agg(F.avg("score").alias("run_score"))
    found = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg("run_score").alias("mean"), F.stddev_samp("run_score").alias("sd"))
    return found.select(*keys, "n_runs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.col("sd") / F.sqrt("n_runs"), 6).alias("sem"))


def noise_retention(trials: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """score and nrr: each group's mean score over that of the same group at k = 1; null if that is zero or missing."""
    scores = trials.groupBy(*keys, k).agg(F.avg("score").alias("score"))
    one = F.max(F.when(F.col(k) == 1, F.col("score"))).over(Window.partitionBy(*keys))
    return scores.withColumn("nrr", F.try_divide(F.col("score"), F.nullif(one, F.lit(0.0))))


def frozen_check(retained: DataFrame, frozen: DataFrame, keys: list[str], tolerance: float = 0.0006) -> DataFrame:
    """``retained`` with frozen_nrr of equal keys and matches: whether they differ by the tolerance at most."""
    met = retained.join(frozen.select(*keys, F.col("nrr").alias("frozen_nrr")), keys)
    return met.withColumn("matches", F.abs(F.col("nrr") - F.col("frozen_nrr")) <= tolerance)


def noise_ceiling(retained: DataFrame, keys: list[str], grid: list[int], least: float = 0.9, strict: bool = True) -> DataFrame:
    """kc: the largest k of the grid whose nrr reaches ``least``, whatever lies below it; display shows the last one as ``>=``.

    A group that lacks a k of the grid, or has another, is an error; with strict off
    the column complete tells.
    """
    passing = F.max(F.when(F.col("nrr") >= least, F.col("k")))
    whole = F.array_sort(F.collect_set(F.col("k").cast("int"))) == F.array(*(F.lit(k) for k in sorted(grid)))
    found = retained.groupBy(*keys).agg(passing.alias("kc"), whole.alias("complete"))
    if strict:
        found = found.withColumn("ok", F.assert_true("complete", "incomplete K grid")).filter("ok is null").drop("ok")
    return found.withColumn("kc_display", F.when(F.col("kc") == max(grid), F.lit(f">={max(grid)}")).otherwise(F.col("kc").cast("string")))


def spec_matrix(ceilings: DataFrame, keys: list[str], condition: str, values: list[str], expected: int | None = None) -> DataFrame:
    """Ceilings with one column for each condition; another number of rows than expected is an error."""
    wide = ceilings.groupBy(*keys).pivot(condition, values).agg(F.first("kc_display"))
    found = wide.select(*keys, *(F.col(v).alias(f"kc_{v}") for v in values))
    if expected is None:
        return found
    size = found.agg(F.count("*").alias("n")).withColumn("ok", F.assert_true(F.col("n") == expected, f"the matrix has other than {expected} rows"))
    return found.join(size.filter("ok is null").select("n")).drop("n")


def position_effects(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score by gold position, its mean absolute deviation, and the middle's deficit against the worse end."""
    wide = trials.groupBy(*keys).pivot("rotation", ["start", "middle", "end"]).agg(F.avg("score"))
    mean = (F.col("start") + F.col("middle") + F.col("end")) / 3
    spread = (F.abs(F.col("start") - mean) + F.abs(F.col("middle") - mean) + F.abs(F.col("end") - mean)) / 3
    return wide.select(*keys, *(F.round(c, 6).alias(c) for c in ("start", "middle", "end")), F.round(spread, 6).alias("absolute_variance"), F.round(F.least("start", "end") - F.col("middle"), 6).alias("middle_deficit"))
