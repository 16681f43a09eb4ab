import pytest
from pyspark.sql import functions as F

from murmura.plans.facade import Study
from murmura.sources import readers, writers


def vectors(rows):
    """A stand-in for an encoder: counts of three words."""
    count = lambda w: (F.size(F.split(F.lower("text"), w)) - 1).cast("double")
    return rows.select("id", F.array(count("red"), count("blue"), count("green")).alias("embedding"))


def test_a_study_from_tables_to_metrics(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("t1", [["c"]], [["red"], ["red"]], {"k": "v"}), ("t2", [["c"]], [["blue"]], None), ("t3", [["c"]], [["green"], ["blue"]], None)],
        "id string, header array<array<string>>, instances array<array<string>>, metadata map<string,string>",
    )
    asked = spark.createDataFrame([(1, "which red?"), (2, "which blue blue?")], "query_id long, question string")
    gold = spark.createDataFrame([(1, "t1"), (2, "t2"), (2, "gone")], "query_id long, id string")
    study = Study(spark, str(tmp_path), encoders={"words": vectors}, readers={"echo": lambda rows: rows.withColumn("answer", F.upper("question"))})
    each, means = study.run_retrieval(corpus, asked, gold, "words", [1, 2])
    assert {(r.query_id, r.k): (r.recall, r.recall_strict) for r in each.collect()} == {(q, k): (1.0, 1.0) for q in (1, 2) for k in (1, 2)}
    assert all(r.n_queries == 2 and r.ndcg == 1.0 for r in means.collect())
    assert {r.index_key: r.n for r in study.indices().collect()} == {"words": 3}
    made = study.build_representations(corpus)
    contexts = spark.createDataFrame([(1, ["t3", "no", "t1"])], "query_id long, injection array<string>")
    r = study.reason(asked, contexts, made, "echo").first()
    assert r.answer == "WHICH RED?" and r.prompt.index("green") < r.prompt.index("| red |")
    assert study.delete_index("words") and not study.delete_index("words")


def test_files_are_found_by_ordered_fallbacks(spark, tmp_path):
    names = spark.createDataFrame([("b_k50_hard_soft_negative", False), ("b_k5_hard_soft_negative", False), ("b_x_retrieval", True), ("b_other", False), ("c_retrieval", True)], "name string, has_real boolean")
    pick = lambda **k: [r.name for r in readers.injection_folder(names, "b", **k).collect()]
    assert pick() == ["b_k5_hard_soft_negative"] and pick(real_only=True) == ["b_x_retrieval"]
    assert [r.name for r in readers.injection_folder(names.filter("name like '%other'"), "b", True).collect()] == ["b_other"]
    assert readers.injection_folder(names, "z").collect() == []
    files = spark.createDataFrame([("md.jsonl",), ("md_a_b.jsonl",), ("md_b_a_long.jsonl",), ("md_b_a.jsonl",), ("other.jsonl",)], "name string")
    one = lambda *p: [r.name for r in readers.representation_file(files, "md", list(p)).collect()]
    assert one("a", "b") == ["md_a_b.jsonl"] and one("long") == ["md_b_a_long.jsonl"] and one("none") == ["md.jsonl"] and one() == ["md.jsonl"]
    spark.range(3).selectExpr("cast(id as string) as value").coalesce(1).write.text(str(tmp_path / "d=1"))
    found = readers.listing(spark, str(tmp_path)).filter("name like 'part-%.txt'").first()
    assert found.parent == "d=1" and found.length == 6


def test_records_by_lines_and_whole_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"i": 1}\nbroken\n{"i": 2}\n')
    (tmp_path / "b.json").write_text('{\n "results": [{"i": 3}, {"i": 4}]}')
    (tmp_path / "c.json").write_text(' [{"i": 5},\n {"i": 6}]')
    (tmp_path / "d.json").write_text('{"data": [{"i": 7}]}')
    (tmp_path / "e.json").write_text("")
    assert sorted(r.i for r in readers.records(spark, str(tmp_path), "i long").collect()) == list(range(1, 8))


def test_an_index_key_with_odd_characters_is_deleted(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    for key in ("a=1", "b c/d"):
        writers.vector_index(rows, str(tmp_path), key)
    assert writers.delete_index(spark, str(tmp_path), "b c/d")
    assert [r.index_key for r in writers.index_keys(spark, str(tmp_path)).collect()] == ["a=1"]


def test_plugged_functions(spark, tmp_path):
    from murmura.plans import plugins

    corpus = spark.createDataFrame([("t1", [["a", "b"]], [["1", "2"], ["3", None]], {}), ("t2", [], [], {})], "id string, header array<array<string>>, instances array<array<string>>, metadata map<string,string>")
    lines = lambda header, rows: "; ".join(f"{h}={c}" for r in rows for h, c in zip(header[-1], r))
    study = Study(spark, str(tmp_path))
    study.representations["lines"] = plugins.representation(spark, "as_lines", lines)
    assert {r.id: r.representation for r in study.build_representations(corpus, "lines").collect()} == {"t1": "a=1; b=2; a=3; b=None", "t2": ""}
    assert spark.sql("select representation from as_lines(array(array('x')), array(array('y')))").first()[0] == "x=y"
    find = plugins.retriever(spark, "by_words", plugins.by_shared_words)
    asked = spark.createDataFrame([(1, "red big dog", ["x", "y", "z"], ["a red dog", "big red dogs", None]), (2, "", [], [])], "query_id long, question string, ids array<string>, texts array<string>")
    assert sorted(tuple(r) for r in find(asked, 2).collect()) == [(1, 1, "x", 2 / 3), (1, 2, "y", 2 / 3)]
    with pytest.raises(ValueError):
        plugins.register(spark, "no name", plugins.pieces, "a int, b string")
    assert plugins.pieces("abcde", 2) == [(0, "ab"), (1, "cd"), (2, "e")] and plugins.pieces(None, 3) == []
