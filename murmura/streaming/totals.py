"""Running totals of usage, kept in Spark's state store in place of a locked file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What transformWithState() needs; set on the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SUMS = "calls long, request_tokens long, response_tokens long, cost double, failures long"
DAY = 86_400_000


class Totals(StatefulProcessor):
    """The totals of one key. Ids that it has seen are kept until no repeat of theirs can pass the watermark: a timer for each day of calls forgets that day's."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.seen = handle.getMapState("seen", "id string", "day long")
        self.days_open = handle.getMapState("days_open", "day long", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        calls, asked, said, cost, failed = self.sums.get() if self.sums.exists() else (0, 0, 0, 0.0, 0)
        days = set()
        for batch in rows:
            for id_, ms, a, b, c, score in zip(batch["id"], batch["ms"], batch["request_tokens"], batch["response_tokens"], batch["cost"], batch["score"]):
                if self.seen.containsKey((id_,)):
                    continue
                day = int(ms) // DAY
                days.add(day)
                self.seen.updateValue((id_,), (day,))
                calls, asked, said, cost, failed = calls + 1, asked + int(a), said + int(b), cost + float(c), failed + int(score == 0)
        for day in days:
            if not self.days_open.containsKey((day,)):
                until = (day + self.days + 1) * DAY
                self.days_open.updateValue((day,), (until,))
                self.handle.registerTimer(until)
        self.sums.update((calls, asked, said, cost, failed))
        yield pd.DataFrame([[*key, calls, asked, said, cost, failed]], columns=["key", "calls", "request_tokens", "response_tokens", "cost", "failures"])

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        over = [d[0] for d, until in self.days_open.iterator() if until[0] <= now]
        for id_ in [i for i, d in self.seen.iterator() if d[0] in over]:
            self.seen.removeKey(id_)
        for d in over:
            self.days_open.removeKey((d,))
        yield from ()

    def close(self) -> None:
        pass


def running_totals(log: DataFrame, key: str, event_time: str, days: int = 7) -> DataFrame:
    """(key, calls, request_tokens, response_tokens, cost, failures), for output mode update: the totals of each key after every batch that touched it.

    log: id (text, unique to a call), the key, the time of the call, request_tokens,
    response_tokens, cost, score. A call that comes again counts once; one that is up to
    ``days`` late counts, a later one is dropped by the watermark. No lock is taken, as a
    key's state belongs to one task. The session needs STORE.
    """
    seen = log.withWatermark(event_time, f"{days} days")
    rows = seen.select(event_time, F.unix_millis(event_time).alias("ms"), F.col(key).cast("string").alias("key"), F.col("id").cast("string").alias("id"), *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("request_tokens", "long"), ("response_tokens", "long"), ("cost", "double"))), F.coalesce(F.col("score").cast("int"), F.lit(1)).alias("score"))
    return rows.groupBy("key").transformWithStateInPandas(Totals(days), f"key string, {SUMS}", "update", "eventTime")
