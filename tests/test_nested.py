"""Whole JSON documents, read by byte ranges."""

import json
import random

import pytest

from murmura.sources import nested, readers

PIECES = ["plain ", 'qu"ote ', 'br}{ace]["', "back\\slash\\ ", "é漢\n", '"records":[{"id":1}]', "\\\\", '\\"}']


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "3000")
    spark.conf.set(names[1], "100")
    yield spark
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_documents_of_every_form(small_ranges, tmp_path):
    rng = random.Random(4)
    recs = [{"id": i, "text": rng.choice(PIECES) * rng.randrange(1, 30), "sub": {"a": [1, {"b": "}"}], "data": [{"id": -3}]}} for i in range(400)]
    files = {
        "a.json": json.dumps(recs[:150]),
        "b.json": json.dumps({"meta": {"records": [{"id": -1}]}, "data": [{"id": -2}], "records": recs[150:250], "z": [{"id": -5}]}, indent=1),
        "c.json": json.dumps({"results": recs[250:300]}),
        "d.jsonl": "".join(json.dumps(r) + "\n" for r in recs[300:390]) + "{broken\n",
        "e.json": json.dumps(recs[390]),
        "f.json": json.dumps([1, "x", [{"id": -9}], *recs[391:400], {"id": 400, "text": "z" * 20_000}]),
        "g.json": "[]",
        "h.json": '{"records":[]}',
        "i.json": "",
        "j.txt": '{"data": [{"id": 401, "text": "t"}], "records": 1}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = {r["id"]: r["text"] for r in recs} | {400: "z" * 20_000, 401: "t"}
    got = [(r.id, r.text) for r in readers.records(small_ranges, str(tmp_path), "id long, text string").filter("id is not null").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_a_document_is_read_by_several_tasks(spark, tmp_path):
    big = [{"id": i, "text": f"value {i} " + "x}" * 40} for i in range(60_000)]
    (tmp_path / "big.json").write_text(json.dumps({"records": big}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert nested.pieces(spark, str(tmp_path)).select("start").distinct().count() >= 5
        found = readers.records(spark, str(tmp_path), "id long, text string")
        assert found.selectExpr("count(*)", "sum(id)", "max(length(text))").first() == (60_000, sum(range(60_000)), len(big[-1]["text"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("header, rows", [
    ('"a,b"', [["a", "b"]]),
    ('["name,\\"x, y\\""]', [["name", "x, y"]]),
    ('["Name, first", "Age"]', [["Name, first", "Age"]]),
    ('[["a", "b"], ["c", "d"]]', [["a", "b"], ["c", "d"]]),
    ("[]", [[]]),
])
def test_headers(spark, tmp_path, header, rows):
    (tmp_path / "t.jsonl").write_text(f'{{"id": "t", "file_name": "f", "header": {header}, "instances": [["1", "2"]]}}\n')
    assert readers.tables(spark, str(tmp_path)).first().header == rows
