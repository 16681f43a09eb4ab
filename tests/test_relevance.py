import math

import pytest

from murmura.operators import context, relevance, retrieve


def one(spark, retrieved, gold, ks, index=None):
    q = spark.createDataFrame([(1,)], "query_id long")
    r = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(retrieved)], "query_id long, rank int, id string")
    g = spark.createDataFrame([(1, x) for x in gold], "query_id long, id string")
    i = None if index is None else spark.createDataFrame([(x,) for x in index], "id string")
    return {r.k: r for r in relevance.metrics(q, r, g, ks, i).collect()}


def test_empty_gold_and_empty_results(spark):
    assert one(spark, [], [], [5])[5].recall == 1 and one(spark, ["a"], [], [5])[5].recall == 0
    r = one(spark, ["a"], [], [5])[5]
    assert r.recall_strict == r.recall_soft == 1 and r.ndcg == 0
    r = one(spark, [], ["a"], [5])[5]
    assert r.recall == r.precision == r.ndcg == r.recall_strict == r.recall_soft == 0


def test_precision_divides_by_k_and_counts_repeats(spark):
    assert one(spark, ["a", "b"], ["a"], [5])[5].precision == pytest.approx(0.2)
    assert one(spark, ["a", "a"], ["a"], [2])[2].precision == 1.0


def test_gold_outside_the_index(spark):
    r = one(spark, ["b"], ["a"], [3], index=["b"])[3]
    assert (r.recall, r.recall_strict, r.recall_soft, r.ndcg) == (0, 1, 1, 0)


def test_ndcg_and_soft_recall(spark):
    r = one(spark, ["x", "a", "b"], ["a", "b", "c"], [2, 3])
    assert r[3].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert r[3].recall_soft == pytest.approx(2 / 3) and r[2].recall_soft == pytest.approx(1 / 3) and r[3].recall_strict == 0


def test_topk_ties_zero_and_missing_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(5, [2.0, 0.0]), (4, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 0.0]), (8, None)], "id long, embedding array<float>").repartition(3)
    got = [(r.query_id, r["rank"], r.id, r.score) for r in retrieve.cosine_topk(q, c, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 4, 1.0), (1, 2, 5, 1.0)]
    assert retrieve.cosine_topk(q.limit(0), c, 2).count() == 0


def ctx(spark, gold, negatives, k, rotation):
    g = spark.createDataFrame([(1, gold)], "query_id long, gold array<string>")
    n = spark.createDataFrame([(1, negatives)], "query_id long, negatives array<string>")
    return [(r.injection, r.gold_positions) for r in context.contexts(g, n, k, rotation).collect()]


def test_contexts(spark):
    assert ctx(spark, ["g", "h"], [], 1, "start") == [(["g", "h"], [0, 1])]
    assert ctx(spark, ["g", "h", "i"], ["a"], 2, "start") == []
    assert ctx(spark, ["g"], ["a", "b", "c"], 4, "middle") == [(["a", "g", "b", "c"], [1])]
    assert ctx(spark, ["g"], ["a", "b"], 4, "end") == []
    assert ctx(spark, ["g"], ["a", "b", "c"], 3, "end") == [(["a", "b", "g"], [2])]


def test_hard_and_soft_negatives(spark):
    r = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id long, rank int, id long")
    g = spark.createDataFrame([(1, 10)], "query_id long, id long")
    assert [(x["rank"], x.id) for x in context.hard_negatives(r, g, 5).orderBy("rank").collect()] == [(2, 11), (3, 12)]
    q, c = spark.createDataFrame([(1,)], "query_id long"), spark.createDataFrame([(i,) for i in range(10, 20)], "id long")
    first, again = (context.soft_negatives(q, c, g, 4).orderBy("rank").collect() for _ in range(2))
    assert first == again and len(first) == 4 and 10 not in {x.id for x in first}
    assert context.soft_negatives(q, c, g, 100).count() == 9


def test_class_metrics_count_every_item_of_a_label(spark):
    """Items of a label are gold wherever they lie, as pairs listed in full say; a null label has none."""
    items = [(i, None if i % 7 == 0 else i % 3) for i in range(200)]
    asked = [(1000 + i, None if i == 4 else i % 4) for i in range(8)]
    found = [(q, n + 1, (q * 31 + n * 17) % 200) for q, _ in asked if q != 1005 for n in range(12)]
    q, r, e = spark.createDataFrame(asked, "query_id long, label int"), spark.createDataFrame(found, "query_id long, rank int, id long"), spark.createDataFrame(items, "id long, label int")
    index, gold = e.filter("id % 3 <> 1").select("id"), q.join(e, "label").select("query_id", "id")
    for held in (None, index):
        want = sorted(tuple(x) for x in relevance.metrics(q, r, gold, [1, 5, 10], held).collect())
        got = sorted(tuple(x) for x in relevance.class_metrics(q, r, e, [1, 5, 10], held).collect())
        assert len(got) == len(want) == 24 and all(a == pytest.approx(b) for a, b in zip(got, want))


def test_soft_recall_takes_all_vectors_of_a_label_as_gold(spark):
    import duckdb

    from murmura.plans import catalog

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{folder}/embeddings.parquet'")
    rows = con.sql("select vec_id, label from embeddings").fetchall()
    size = {a: sum(1 for i, b in rows if b == a and i % 5) for a in {b for _, b in rows}}
    of = dict(rows)
    for name in ("recall_soft_at_k", "ndcg_at_k", "availability_filter"):
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())
        want = sorted(con.sql(catalog.ORACLES[name]).fetchall())
        assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(got, want))
        if name == "recall_soft_at_k":
            assert all(abs(x * size[of[q]] - round(x * size[of[q]])) < 1e-3 for q, _, x in got)
            assert min(size.values()) > 30


def test_soft_negatives_make_their_draws_within_a_row(spark):
    """Draws are not rows that one task has to group: only the places that may be needed leave a query's row, and they are the first different ones."""
    q, c = spark.range(0, 30).toDF("query_id"), spark.range(0, 500).toDF("id")
    g = spark.range(0, 30).selectExpr("id as query_id", "explode(sequence(id, id + id % 4)) as id")
    made = context.soft_negatives(q, c, g, 5)
    assert not [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "place#" in x]
    import hashlib

    for query in (0, 3, 17):
        gold = set(range(query, query + query % 4 + 1))
        drawn = [int(hashlib.md5(f"42|{query}|{t}".encode()).hexdigest()[:15], 16) % 500 for t in range(8 * (5 + len(gold)) + 64)]
        want = [x for x in dict.fromkeys(drawn) if x not in gold][:5]
        assert [r.id for r in made.filter(f"query_id = {query}").orderBy("rank").collect()] == want
