"""Exact order statistics by radix selection: a few passes of counts, whatever the size of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Bits that each pass settles, from the highest; a pass has a count for each of their values at most, in each group.
PASSES = (22, 21, 21)


@F.pandas_udf(LongType())
def sortable(value: pd.Series) -> pd.Series:
    """A double as a whole number of the same order: its bits, those below the sign turned round for negative ones. Both zeros are one; not-a-number is the greatest."""
    x = np.where(np.isnan(value.to_numpy(np.float64)), np.nan, value.to_numpy(np.float64) + 0.0)
    bits = x.view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def unsorted(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[f"_{c}"])
    return same


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def order_statistics(rows: DataFrame, column: str, places: Column, keys: list[str]) -> DataFrame:
    """(keys, n, place, value): the values at zero-based ``places`` (an array, made of the column n) of each group's ascending values, nulls left out.

    Three passes: each counts the values of the next bits among those that still may be
    at a place, so a group needs no more memory with more rows, a single group neither.
    A place that a group does not have gives no row.
    """
    bits = rows.filter(F.col(column).isNotNull()).select(*keys, sortable(F.col(column).cast("double")).alias("_bits"))
    left, found = sum(PASSES), None
    for i, width in enumerate(PASSES):
        left -= width
        prefix = F.shiftright("_bits", left)
        if found is None:
            counts = bits.groupBy(*keys, prefix.alias("_at")).agg(F.count("*").alias("_c"))
            before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at")) - F.col("_c")
            counts = counts.withColumn("_before", before).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
            asked = counts.withColumn("place", F.explode(F.array_distinct(places)))
            found = asked.filter("place >= _before and place < _before + _c").select(*keys, "n", "place", "_at", "_before")
        else:
            known = _renamed(found.select(*keys, "_at").distinct(), [*keys, "_at"])
            here = bits.withColumn("_at", F.shiftright("_bits", left + width))
            counts = here.join(known, _same(here, known, [*keys, "_at"]), "left_semi").groupBy(*keys, "_at", prefix.alias("_next")).agg(F.count("*").alias("_c"))
            before = F.sum("_c").over(Window.partitionBy(*keys, "_at").orderBy("_next")) - F.col("_c")
            counts = _renamed(counts.withColumn("_in", before), [*keys, "_at"])
            met = found.join(counts, _same(found, counts, [*keys, "_at"])).withColumn("_low", F.col("_before") + F.col("_in"))
            found = met.filter("place >= _low and place < _low + _c").select(*keys, "n", "place", F.col("_next").alias("_at"), F.col("_low").alias("_before"))
    return found.select(*keys, "n", "place", unsorted("_at").alias("value"))


def percentiles(rows: DataFrame, column: str, shares: list[float], keys: list[str]) -> DataFrame:
    """(keys, i, share, value): percentiles with linear interpolation (type 7), a row for each share; groups without a value have none."""
    spot = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    places = F.array(*(f(x).cast("long") for x in spot for f in (F.floor, F.ceil)))
    found = order_statistics(rows, column, places, keys)
    listed = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_v"))  # two for each share at most
    at = lambda f, x: F.element_at("_v", f(x).cast("long"))
    one = lambda x: at(F.floor, x) + (x - F.floor(x)) * (at(F.ceil, x) - at(F.floor, x))
    values = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share"), F.when(F.floor(x) == F.ceil(x), at(F.floor, x)).otherwise(one(x)).alias("value")) for i, (s, x) in enumerate(zip(shares, spot))))
    return listed.select(*keys, F.inline(values))
