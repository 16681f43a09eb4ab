"""The runner across a kill, and running totals against the batch rollup."""

import datetime
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from murmura.operators.anatomy import usage_rollup
from murmura.streaming import totals
from murmura.streaming.runner import Runner, Unanswered, run_all

ROOT = Path(__file__).resolve().parent.parent
WORK = "query_id long, question string, injection array<string>"


def reader(calls, fail=lambda q, attempt: ""):
    """Writes down every call; a context of more than twenty tables is too long, and ``fail`` names other errors."""

    def said(rows):
        @F.udf("string")
        def error(query_id, attempt, tables):
            with open(f"{calls}/{query_id}", "a") as f:
                f.write(f"{attempt} {len(tables)}\n")
            return "400 context too long" if len(tables) > 20 else fail(query_id, attempt)

        return rows.withColumn("error", error.asNondeterministic()("query_id", "attempt", "tables")).withColumn("answer", F.when(F.col("error") == "", F.concat(F.lit("a"), F.col("query_id").cast("string"))))

    return said


def work(spark, path, ids, sizes=lambda i: 3):
    spark.createDataFrame([(i, f"q{i}?", [f"t{j}" for j in range(sizes(i))]) for i in ids], WORK).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(WORK).option("maxFilesPerTrigger", 1).parquet(str(path))


def tables(spark):
    return spark.createDataFrame([(f"t{j}", f"table {j}") for j in range(40)], "id string, representation string")


def calls_of(path):
    return {int(p.name): p.read_text().split("\n")[:-1] for p in path.iterdir()}


def test_retries_and_the_short_context(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    busy = lambda q, attempt: "busy" if attempt < q % 3 else ""
    made = run_all(Runner(spark, str(tmp_path / "run"), tables(spark), reader(str(tmp_path / "calls"), busy), retries=2), work(spark, tmp_path / "in", range(9), lambda i: 30 if i in (3, 4) else i))
    got = {r.query_id: (r.n_tables, r.attempts, r.answer) for r in made.collect()}
    assert got == {i: (20 if i in (3, 4) else i, max(i % 3, int(i in (3, 4))) + 1, f"a{i}") for i in range(9)}
    assert calls_of(tmp_path / "calls")[4] == ["0 30", "1 20"] and calls_of(tmp_path / "calls")[5] == ["0 5", "1 5", "2 5"]


def test_unanswered_questions_stop_the_run_and_the_next_run_goes_on(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    late = lambda q, attempt: "down" if q == 2 and attempt < 3 else ""
    runner = Runner(spark, str(tmp_path / "run"), tables(spark), reader(str(tmp_path / "calls"), late), retries=1)
    stream = work(spark, tmp_path / "in", range(4))
    with pytest.raises(Exception, match="without an answer"):
        run_all(runner, stream)
    assert sorted(r.query_id for r in runner.results().collect()) == [0, 1, 3]
    assert sorted(r.query_id for r in run_all(runner, stream).collect()) == [0, 1, 2, 3]
    assert calls_of(tmp_path / "calls") == {0: ["0 3"], 1: ["0 3"], 3: ["0 3"], 2: ["0 3", "1 3", "2 3", "3 3"]}
    work(spark, tmp_path / "in", [1, 7])  # one known question, one new
    assert sorted(r.query_id for r in run_all(runner, stream).collect()) == [0, 1, 2, 3, 7]
    assert len(calls_of(tmp_path / "calls")[1]) == 1
    assert issubclass(Unanswered, RuntimeError)


KILLED = """
import os, signal, sys
sys.path[:0] = {paths!r}
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {tmp!r} + "/shared").getOrCreate()
import test_streaming as t
from pathlib import Path
tmp = Path({tmp!r})
said = t.reader(str(tmp / "calls"), lambda q, attempt: "busy" if attempt < q % 3 else "")
asked = []
def cut(rows):
    asked.append(1)
    if len(asked) == {at}:  # the process goes while the answers of this attempt are being written
        rows = said(rows)
        rows.select("query_id", "error").collect()
        os.kill(os.getpid(), signal.SIGKILL)
    return said(rows)
t.run_all(t.Runner(spark, str(tmp / "run"), t.tables(spark), cut, retries=2), t.work(spark, tmp / "in", range(0) if {again} else range(9)))
"""


def test_a_kill_in_the_middle_of_a_batch_changes_nothing(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    script = KILLED.format(paths=[str(ROOT), str(ROOT / "tests")], tmp=str(tmp_path), at=2, again=False)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests"}
    assert subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, timeout=300).returncode == -9
    assert {q: len(c) for q, c in calls_of(tmp_path / "calls").items()} == {i: 1 if i % 3 == 0 else 2 for i in range(9)}
    busy = lambda q, attempt: "busy" if attempt < q % 3 else ""
    runner = Runner(spark, str(tmp_path / "run"), tables(spark), reader(str(tmp_path / "calls"), busy), retries=2)
    stream = spark.readStream.schema(WORK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.query_id, r.attempts, r.answer) for r in run_all(runner, stream).collect())
    assert got == [(i, i % 3 + 1, f"a{i}") for i in range(9)]
    # only the attempt that was cut off is made again
    assert {q: [int(x.split()[0]) for x in c] for q, c in calls_of(tmp_path / "calls").items()} == {i: [0] if i % 3 == 0 else [0, 1, 1] if i % 3 == 1 else [0, 1, 1, 2] for i in range(9)}


def test_running_totals_equal_the_rollup(spark, tmp_path):
    spark.conf.set(*totals.STORE)
    schema = "id string, stage string, ts timestamp, request_tokens long, response_tokens long, cost double, score int"
    rows = [(str(i), "ab"[i % 2], datetime.datetime(2024, 1, 3) - datetime.timedelta(hours=i), i, 2 * i, i / 8, i % 3) for i in range(30)]  # each later row is an earlier call
    for part in (rows[:20], rows[10:], rows[:5]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    now = {}

    def keep(batch, _):
        now.update({r.key: (r.calls, r.request_tokens, r.response_tokens, round(r.cost, 6), r.failures) for r in batch.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals.running_totals(stream, "stage", "ts").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    want = usage_rollup(spark.createDataFrame(rows, schema), "stage").filter("stage is not null").collect()
    assert now == {r.stage: (r.calls, r.request_tokens, r.response_tokens, r.cost, r.failures) for r in want}
    assert json.dumps(sorted(now)) == '["a", "b"]'
