"""Tokens and money: statistics, backfilled estimates, cost per success with rounding intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.selection import percentiles

#: USD for a million input and output tokens, by reader number. Fixed values.
PRICES = [(0, "2.50", "10.00"), (1, "1.00", "5.00"), (2, "0.02", "0.10"), (3, "0.29", "0.59")]


def price_table(spark) -> DataFrame:
    rows = F.inline(F.array(*(F.struct(F.lit(r).alias("reader"), F.lit(i).cast("double").alias("rate_in"), F.lit(o).cast("double").alias("rate_out")) for r, i, o in PRICES)))
    return spark.range(1).select(rows)


def token_stats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """total, mean, median, min and max of a column by group; zeros where it has no value. The median is exact, by selection.percentiles()."""
    c, zero = F.col(column), F.lit(0)
    sums = rows.groupBy(*keys).agg(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))
    middle = percentiles(rows, column, [0.5], keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("value").alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = sums.join(middle, same, "left")
    return met.select(
        *keys,
        F.coalesce("total", zero).cast("long").alias("total"),
        F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"),
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce("min", zero).cast("long").alias("min"),
        F.coalesce("max", zero).cast("long").alias("max"),
    )


def quarter_length(text: Column, floor: int = 1) -> Column:
    """Length over four, rounded down, and at least ``floor``."""
    return F.greatest(F.lit(floor).cast("long"), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long"))


def backfill(rows: DataFrame, request: Column, response: Column) -> DataFrame:
    """request_tokens and response_tokens, estimated from the texts unless both are positive already."""
    known = (F.col("request_tokens") > 0) & (F.col("response_tokens") > 0)
    return rows.withColumns({"request_tokens": F.when(known, F.col("request_tokens")).otherwise(quarter_length(request)), "response_tokens": F.when(known, F.col("response_tokens")).otherwise(quarter_length(response)), "filled": ~F.coalesce(known, F.lit(False))})


def cost_per_success(trials: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Mean tokens, score, cost and cps = cost / score of each group (null at score 0). prices: reader, rate_in, rate_out; small, and broadcast by Spark's size check."""
    found = trials.groupBy(*keys).agg(F.avg("request_tokens").alias("tokens_in"), F.avg("response_tokens").alias("tokens_out"), F.avg("score").alias("score"))
    cost = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6
    return found.join(prices, "reader").withColumn("cost", cost).withColumn("cps", F.try_divide("cost", F.nullif("score", F.lit(0.0))))


def display_interval(text: Column) -> tuple[Column, Column]:
    """What a printed number may stand for: half a unit of its last place to either side."""
    places = F.when(F.instr(text, ".") > 0, F.char_length(F.split_part(text, F.lit("."), F.lit(2)))).otherwise(0)
    half = F.lit(5.0) * F.pow(F.lit(10.0), -(places + 1))
    value = text.cast("double")
    return value - half, value + half


def interval_match(rows: DataFrame) -> DataFrame:
    """cps_low, cps_high from the printed columns in_text, out_text, score_text, and whether they meet published_text's interval (strictly)."""
    (il, ih), (ol, oh), (sl, sh), (pl, ph) = (display_interval(F.col(c)) for c in ("in_text", "out_text", "score_text", "published_text"))
    low = F.try_divide((il * F.col("rate_in") + ol * F.col("rate_out")) / 1e6, sh)
    high = F.try_divide((ih * F.col("rate_in") + oh * F.col("rate_out")) / 1e6, sl)
    return rows.withColumns({"cps_low": low, "cps_high": high, "matches": F.greatest(low, pl) < F.least(high, ph)})
