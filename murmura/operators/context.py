"""Contexts of gold and distractor ids: hard (retrieved) or soft (random) negatives, and where gold stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.records import numbered


def hard_negatives(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id): the first k retrieved ids that are not gold, with the ranks that retrieval gave them."""
    others = retrieved.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    return others.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", "rank", "id")


def _drawn(*parts: Column) -> Column:
    """The first 60 bits of an md5 of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def soft_negatives(queries: DataFrame, corpus: DataFrame, gold: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(query_id, rank, id): k corpus ids that are not gold, drawn uniformly by a seeded hash, for each query by itself; all of them if fewer.

    Ids are numbered once. A query draws places with replacement and takes the first k
    different ids that are not gold; it draws eight for each id it may need, and 64
    more, so that with a corpus of four times its need or more it runs out less than
    once in 10^50 queries. In a smaller corpus it goes through all places, in an order
    of its own. The draws of a query are made within its row, and of its different places
    the first k plus its number of gold ids go on: so many hold k others. The work is
    proportional to k and the gold ids of a query, never to the corpus.
    """
    ids = numbered(corpus.select("id").distinct(), ["id"], "place", 0)
    size = ids.agg(F.count("*").alias("size"))
    known = gold.select("query_id", "id").distinct()
    asked = queries.select("query_id").distinct().join(known.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id", "left").join(F.broadcast(size))
    need = (F.lit(k) + F.coalesce("n_gold", F.lit(0))).cast("long")
    text, mark = F.col("query_id").cast("string"), F.lit(str(seed))
    asked = asked.filter("size > 0").withColumn("need", need).withColumn("small", F.col("size") < 4 * F.col("need"))
    asked = asked.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    turn = F.sequence(F.lit(0).cast("long"), F.when(F.col("small"), F.col("size")).otherwise(8 * F.col("need") + 64) - 1)
    drawn = lambda t: _drawn(mark, text, t.cast("string"))
    walked = F.transform(F.array_sort(F.transform(turn, lambda t: F.struct(drawn(t).alias("drawn"), t.alias("place")))), lambda x: x["place"])
    places = F.when(F.col("small"), walked).otherwise(F.array_distinct(F.transform(turn, lambda t: drawn(t) % F.col("size"))))
    first = asked.select("query_id", F.posexplode(F.slice(places, F.lit(1), F.col("need").cast("int"))).alias("order", "place"))
    met = first.join(ids, "place").join(known, ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("order")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id")


def ordered_ids(rows: DataFrame, name: str, by: str = "rank") -> DataFrame:
    """(query_id, name): the ids of each query as one array, in order."""
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "id"))), lambda x: x["id"]).alias(name))


def placed(gold: Column, negatives: Column, rotation: str) -> Column:
    """Gold before, between (after half of the negatives, rounded down) or behind the negatives."""
    if rotation == "start":
        return F.concat(gold, negatives)
    if rotation == "end":
        return F.concat(negatives, gold)
    half = F.floor(F.size(negatives) / 2).cast("int")
    return F.concat(F.slice(negatives, F.lit(1), half), gold, F.slice(negatives, half + 1, F.size(negatives)))


def contexts(gold: DataFrame, negatives: DataFrame, k: int, rotation: str) -> DataFrame:
    """(query_id, k, rotation, injection, gold_positions) from (query_id, gold) and (query_id, negatives) arrays.

    At k = 1 a context is all gold ids. Queries with more gold ids than k, or too few negatives, have none.
    """
    met = gold.join(negatives, "query_id", "left").withColumn("negatives", F.coalesce("negatives", F.slice("gold", 1, 0)))
    need = F.lit(k) - F.size("gold")
    if k == 1:
        met = met.withColumn("injection", F.col("gold"))
    else:
        met = met.filter((need >= 0) & (F.size("negatives") >= need)).withColumn("injection", placed(F.col("gold"), F.slice(F.col("negatives"), F.lit(1), need), rotation))
    return met.select("query_id", F.lit(k).alias("k"), F.lit(rotation).alias("rotation"), "injection", positions("injection", "gold").alias("gold_positions"))


def batches(gold: DataFrame, negatives: dict[str, DataFrame], ks: list[int], rotations: list[str]) -> DataFrame:
    """contexts() of every condition (k, rotation, negative) at once: at k = 1 one, named perfect; else one for each rotation and kind of negatives."""
    found = None
    kinds = list(negatives.items())
    for k in ks:
        for rotation in ["perfect"] if k == 1 else rotations:
            for name, rows in [("perfect", kinds[0][1])] if k == 1 else kinds:
                one = contexts(gold, rows, k, rotation).withColumn("negative", F.lit(name))
                found = one if found is None else found.unionByName(one)
    return found


def positions(context: str, gold: str) -> Column:
    """Zero-based places of gold ids in a context."""
    return F.filter(F.sequence(F.lit(0), F.size(context) - 1), lambda i: F.array_contains(F.col(gold), F.element_at(F.col(context), i + 1)))


def real_result_context(retrieved: DataFrame, k: int) -> DataFrame:
    """(query_id, injection): the first k retrieved ids; queries with fewer have none."""
    return ordered_ids(retrieved, "ids").filter(F.size("ids") >= k).select("query_id", F.slice("ids", 1, k).alias("injection"))
