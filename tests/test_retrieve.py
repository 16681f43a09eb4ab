"""Exact top-k search, with and without an index, against brute force."""

import numpy as np
import pytest

from murmura.operators import retrieve


def brute(queries, corpus, k):
    out = []
    for q, a in queries:
        scored = []
        for i, b in corpus:
            if a is not None and b is not None and len(a) == len(b) and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0:
                scored.append((-(round(float(np.dot(np.array(a) / np.linalg.norm(a), np.array(b) / np.linalg.norm(b))), 6) + 0.0), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clouds(seed, many, size, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(many, dims))
    return [(centres[i % many] + 0.05 * rng.normal(size=dims)).tolist() for i in range(size)]


def frame(spark, rows, key, kind="long"):
    return spark.createDataFrame(rows, f"{key} {kind}, embedding array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(retrieve, "HELD", 500)
    monkeypatch.setattr(retrieve, "BLOCK", 64)
    name = (lambda i: i) if kind == "long" else (lambda i: f"t{i}")
    vectors = clouds(1, 12, 900, 8)
    vectors[5], vectors[6], vectors[7], vectors[8] = None, [0.0] * 8, [1.0, 2.0], vectors[9]
    corpus = [(name(i), v) for i, v in enumerate(vectors)]
    queries = [(name(i), v) for i, v in enumerate(clouds(2, 12, 40, 8))] + [(name(90), None), (name(91), [0.0] * 8), (name(92), [1.0])]
    asked, known = frame(spark, queries, "query_id", kind), frame(spark, corpus, "id", kind)
    want = brute(queries, corpus, 7)
    index = retrieve.clustered(known)
    got = [sorted(tuple(r) for r in df.collect()) for df in (retrieve.cosine_topk(asked, known, 7), retrieve.search(asked, index, 7))]
    assert got[0] == want and got[1] == want
    monkeypatch.setattr(retrieve, "QUERIES", 11)  # several blocks of queries
    assert sorted(tuple(r) for r in retrieve.search(asked, index, 7).collect()) == want


def test_the_index_skips_what_cannot_be_near(spark):
    corpus = frame(spark, list(enumerate(clouds(3, 30, 3000, 16))), "id")
    asked = frame(spark, list(enumerate(clouds(3, 30, 60, 16))), "query_id")
    found = retrieve.skipped(asked, retrieve.clustered(corpus), 10).first()
    assert found.pairs > 0 and found.share > 0.8


def test_vectors_stay_where_they_are(spark):
    corpus = frame(spark, list(enumerate(clouds(4, 3, 50, 4))), "id")
    asked = frame(spark, list(enumerate(clouds(4, 3, 5, 4))), "query_id")
    plan = retrieve.search(asked, retrieve.clustered(corpus), 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") : plan.index("BroadcastExchange")]  # the vectors' side; the other side names the queries
    assert "Exchange" not in below and "Join" not in below and "Scan parquet" in below


def test_more_asked_than_there_is_and_nothing_at_all(spark):
    corpus, asked = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id"), frame(spark, [(1, [1.0, 1.0])], "query_id")
    index = retrieve.clustered(corpus)
    assert [(r["rank"], r.id) for r in retrieve.search(asked, index, 9).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert retrieve.search(asked.limit(0), index, 9).count() == 0
    assert retrieve.search(asked, retrieve.clustered(corpus.limit(0)), 9).count() == 0
    assert retrieve.cosine_topk(asked, corpus.limit(0), 9).count() == 0
    assert retrieve.skipped(asked.limit(0), index, 9).first().share == 0.0


def test_a_task_holds_few_results_at_once(monkeypatch):
    """Of a full block of queries, whatever the vectors that stream past it: none makes a task sort a million rows."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    asked = rng.normal(size=(retrieve.QUERIES, 8))
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    sizes, least = [], retrieve._least
    monkeypatch.setattr(retrieve, "_least", lambda t, k: sizes.append(t.num_rows) or least(t, k))
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(1024) + 1024 * i), pa.array(list(rng.normal(size=(1024, 8))), pa.list_(pa.float64()))], ["id", "embedding"]) for i in range(6))
    run = retrieve._scan(asked, np.full(len(asked), -np.inf), np.zeros((len(asked), 0)), 8, 50, 6, False)
    assert sum(b.num_rows for b in run(batches)) == 50 * len(asked)
    assert max(sizes) < 600_000
