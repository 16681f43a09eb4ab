import __spark_entry__ as entry


def test_queries_and_sql_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]) >= 64


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "score", "is_gold"] and df.count() == 500
