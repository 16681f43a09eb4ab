import gzip
import json

from pyspark.sql import functions as F

from murmura.sources import readers, writers
from murmura.streaming import incremental


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_tables(spark, tmp_path):
    path = lines(tmp_path / "t.jsonl", [
        {"id": 1, "header": "a,\"b, c\"", "instances": [["1", "2"]]},
        {"id": "2", "header": ["x", "y"], "instances": ["1,\"q, r\"", "3,4"], "file_name": "f"},
        {"id": "3", "header": [["h1"], ["h2"]], "instances": []},
        {"id": "1", "header": ["last"], "instances": [["z"], [" "]]},
        "{broken",
    ])
    got = {r.id: r for r in readers.tables(spark, path).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].header == [["last"]] and got["1"].instances == [["z"], [" "]]
    assert got["2"].instances == [["1", "q, r"], ["3", "4"]] and got["3"].header == [["h1"], ["h2"]]
    cells = readers.cell_map(readers.tables(spark, path))
    assert sorted((r.table_id, r.cell) for r in cells.collect()) == [("1", "z"), ("2", "1"), ("2", "3"), ("2", "4"), ("2", "q, r")]


def test_queries_and_gold_tables(spark, tmp_path):
    t = lines(tmp_path / "t.jsonl", [{"id": "a", "header": ["h"], "instances": []}, {"id": "b", "header": ["h"], "instances": []}])
    q = lines(tmp_path / "q.jsonl", [{"id": 0, "question": "x", "ground_truth_list": [{"id": "b"}, {"id": "none"}, {"id": "a"}], "sql": "s"}, {"query_id": "1", "question": "y"}, {"query_id": "1", "question": "z", "ground_truth_list": [{"id": "gone"}]}])
    asked = readers.queries(spark, q)
    assert [r.question for r in readers.last_by_key(asked).filter("query_id = '1'").collect()] == ["z"]
    assert [r.question for r in readers.first_by(asked, "query_id").filter("query_id = '1'").collect()] == ["y"]
    got = readers.attach_tables(readers.last_by_key(asked), readers.tables(spark, t)).collect()
    assert [(r.query_id, [x.id for x in r.tables]) for r in got] == [("0", ["b", "a"])]
    assert readers.last_by_key(asked).filter("query_id = '0'").first().answer == "s"


def test_records_from_lines_and_documents(spark, tmp_path):
    schema = "query_id string, score int"
    a = lines(tmp_path / "a.jsonl", [{"query_id": "1", "score": 1}, "oops", {"query_id": "2", "score": 0}])
    assert readers.records(spark, a, schema).count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"model": "m", "records": [{"query_id": "1", "score": 1}]}))
    assert [tuple(r) for r in readers.records(spark, str(tmp_path / "b.json"), schema).collect()] == [("1", 1)]
    (tmp_path / "c.json").write_text(json.dumps([{"query_id": "1", "score": 1}, {"query_id": "3", "score": 0}]))
    assert readers.records(spark, str(tmp_path / "c.json"), schema).count() == 2


def test_csv_with_mark_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write('name,value\n"a, b",1\n')
    df = readers.results_csv(spark, str(tmp_path / "r.csv.gz"))
    assert df.columns == ["name", "value"] and tuple(df.first()) == ("a, b", "1")
    assert readers.resolve_column(df, ["x", "value", "name"]) == "value"


def test_prices(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("currency: USD\nrates:\n  m-1:\n    input: 0.02\n    output: 0.10\n    provider: p\n  m-2:\n    input: 1\n    output: 5.00\n")
    got = {r.model: (float(r.rate_in), float(r.rate_out)) for r in readers.prices(spark, str(tmp_path / "p.yaml")).collect()}
    assert got == {"m-1": (0.02, 0.1), "m-2": (1.0, 5.0)}


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    for key in ("k1", "k2", "k1"):
        writers.vector_index(e, str(tmp_path / "index"), key)
    assert {r.index_key: r.n for r in writers.index_keys(spark, str(tmp_path / "index")).collect()} == {"k1": 1, "k2": 1}
    assert writers.load_index(spark, str(tmp_path / "index"), "k2").count() == 1
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    writers.json_lines(old, str(tmp_path / "j"), by=["v"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    for _ in range(2):
        writers.csv_report(old, str(tmp_path / "c"), append=True)
        writers.log_usage(old, str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2 and spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10", 1, 5), ("a", "2024-01-01 00:00:10", 1, 5), ("b", "2024-01-01 00:07:00", 0, 3)]
    df = spark.createDataFrame(rows, "query_id string, at string, score int, tokens long").withColumn("ts", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental.append_files(incremental.once(read(), ["query_id"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.query_id for r in done.collect()) == ["a", "b"]
    assert incremental.pending(df, done.filter("query_id = 'a'"), ["query_id"]).select("query_id").first().query_id == "b"
    q = incremental.running_accuracy(read(), ["query_id"]).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.query_id: r.accuracy for r in spark.table("acc").collect()} == {"a": 1.0, "b": 0.0}
    q = incremental.windowed_usage(read(), "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("use").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.calls, r.tokens, r.failures) for r in spark.table("use").collect()) == [(1, 3, 1), (2, 10, 0)]
