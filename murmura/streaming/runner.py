"""Answers to a stream of questions over their tables: resumed, retried, with a shorter context where the full one is too long.

Every attempt of a batch is a table of its own in the ledger, and counts once it is
written whole. A run that is killed starts the same batch again: attempts that are in
the ledger are read, not made again, so a reader is asked anew only for the attempt that
was cut off, and each question has one result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmura.operators.records import injected_tables
from murmura.sources.shared import exists, names_under

#: Tables of the shorter context.
FALLBACK = 20


class Unanswered(RuntimeError):
    """Questions of a batch are left without an answer after all attempts."""


@dataclass
class Runner:
    """reader adds answer and error (text, null or empty without one), and what else it knows, to rows of query_id, question, tables and attempt. representations: id, representation.

    A question whose error says that its context is too long (``too_long``, a condition
    on the column error) has its first FALLBACK tables from then on. ``retries`` are
    made after the first attempt, with waits that begin at ``wait`` seconds and grow by
    ``backoff`` up to ``longest_wait``. If questions stay without an answer the run
    stops with Unanswered after the batch's results are written, unless ``stop`` is off;
    the next run gives them as many attempts again.
    """

    spark: SparkSession
    folder: str
    representations: DataFrame
    reader: Callable[[DataFrame], DataFrame]
    retries: int = 3
    fallback: int = FALLBACK
    most_tokens: int = 8000
    too_long: Callable[[Column], Column] = lambda error: error.contains("400")
    stop: bool = True
    wait: float = 0.0
    backoff: float = 2.0
    longest_wait: float = 60.0

    def start(self, work: DataFrame) -> StreamingQuery:
        """Runs over a stream of (query_id, question, injection: the ids of its tables) until all that is there is done."""
        return work.select("query_id", "question", "injection").writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(self.batch).start()

    def results(self) -> DataFrame | None:
        """What is answered so far: query_id, question, n_tables, attempts, answer and the reader's other columns; None before the first batch is done."""
        done = [n for n in names_under(self.spark, f"{self.folder}/results") if exists(self.spark, f"{self.folder}/results/{n}/_SUCCESS")]
        return self.spark.read.option("basePath", f"{self.folder}/results").parquet(*(f"{self.folder}/results/{n}" for n in done)).drop("batch") if done else None

    def batch(self, rows: DataFrame, number: int) -> None:
        """One batch; calling it again with the same number changes nothing that is done."""
        if exists(self.spark, f"{self.folder}/results/batch={number}/_SUCCESS") and not self._given_up(number):
            return
        rows = self._fixed(rows, number)
        begun, left, answered = self._given_up(number) * (self.retries + 1), rows, None
        wait = self.wait
        for attempt in range(begun + self.retries + 1):
            made = self._attempt(left, number, attempt, wait if attempt > begun else 0.0)
            wait = min(self.longest_wait, wait * max(1.0, self.backoff)) if attempt > begun else wait
            good = made.filter("_good")
            answered = good if answered is None else answered.unionByName(good)
            short = made.filter(~F.col("_good")).select("query_id", (F.col("_short") | F.coalesce(self.too_long(F.col("error")), F.lit(False))).alias("_short"))
            left = rows.drop("_short").join(short, "query_id")
            if not short.take(1):
                break
        answered.drop("_good", "_short", "error").write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")
        some = short.take(1)
        if some:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/given_up/batch={number}/round={self._given_up(number)}")
            if self.stop:
                raise Unanswered(f"batch {number} has questions without an answer after {self.retries + 1} attempts, the first of them {some[0].query_id}")

    def _given_up(self, number: int) -> int:
        path = f"{self.folder}/given_up/batch={number}"
        return sum(exists(self.spark, f"{path}/{n}/_SUCCESS") for n in names_under(self.spark, path))

    def _fixed(self, rows: DataFrame, number: int) -> DataFrame:
        """A batch's questions, one row each, without those that earlier batches have answered: written once, so that every attempt and every run sees the same."""
        path = f"{self.folder}/todo/batch={number}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            earlier = [n for n in names_under(self.spark, f"{self.folder}/results") if n != f"batch={number}"]
            todo = rows.dropDuplicates(["query_id"])
            if earlier:
                done = self.spark.read.parquet(*(f"{self.folder}/results/{n}" for n in earlier)).select("query_id")
                todo = todo.join(done, "query_id", "left_anti")
            todo.withColumn("_short", F.lit(False)).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _attempt(self, rows: DataFrame, number: int, attempt: int, wait: float) -> DataFrame:
        """The reader's answers to ``rows``, from the ledger if they are there."""
        path = f"{self.folder}/attempts/batch={number}/attempt={attempt}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            time.sleep(wait)
            ids = rows.withColumn("injection", F.when(F.col("_short"), F.slice("injection", 1, self.fallback)).otherwise(F.col("injection")))
            met = ids.drop("injection").join(injected_tables(ids.select("query_id", "injection"), self.representations, self.most_tokens), "query_id")
            said = self.reader(met.withColumn("attempt", F.lit(attempt)))
            good = (F.coalesce(F.trim("error"), F.lit("")) == "") & (F.trim(F.coalesce("answer", F.lit(""))) != "")
            said.withColumn("n_tables", F.size("tables")).withColumn("attempts", F.lit(attempt + 1)).withColumn("_good", good).drop("tables", "attempt").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def run_all(runner: Runner, work: DataFrame) -> DataFrame:
    """start() to its end, and the results."""
    runner.start(work).awaitTermination()
    return runner.results()
