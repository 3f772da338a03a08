"""Requests and their responses: attribution over the whole log, and time-outs as a stream with timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from evidentia.operators.ordered import last_known, ranged
from evidentia.plans.staging import shared_dir


def attributed(events: DataFrame) -> DataFrame:
    """Every response of a client's log (case_id, event_id, ts, event) with the file that it was asked for.

    A ``run`` answers the last ``run_started`` before it in the order of (ts, event_id), and that was asked
    for the last ``file`` before itself. asked_file and request_id are null where there is none;
    ``late`` says that another file has been chosen since, so the response must not be shown for the
    current one. Rows may come in any order. Null times come first."""
    by, order = ["case_id"], ["ts", "event_id"]
    log = events.select("case_id", "event_id", "ts", "event", F.when(F.col("event") == "file", F.col("event_id")).alias("mark"))
    log = last_known(ranged(log, by, order), by, order, "mark", "file_id")
    asking = F.when(F.col("event") == "run_started", F.struct(F.col("event_id").alias("request_id"), F.col("file_id").alias("asked_file")))
    log = last_known(log.withColumn("asking", asking), by, order, "asking", "request")
    late = F.col("request").isNotNull() & ~F.col("request.asked_file").eqNullSafe(F.col("file_id"))
    return log.filter("event = 'run'").select("case_id", "event_id", "ts", "request.request_id", "request.asked_file", "file_id", late.alias("late"))


ANSWERED = "case_id long, request_id long, waited long, status string"


class Waiting(StatefulProcessor):
    """Of one case: requests without a verdict, and the responses that may still answer one.

    A request waits ``limit`` microseconds. Its verdict falls when the watermark has passed that, so all
    that could answer it has come, in whatever order and however often. One timer stands for the
    earliest request. Responses go when no request that is or can still come is before them."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.requests = handle.getMapState("requests", "event_id long", "ts long")
        self.responses = handle.getMapState("responses", "ts long, event_id long", "seen boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _due(self, ts: int) -> int:
        """The first whole millisecond by which the time is over."""
        return -(-(ts + self.limit) // 1000)

    def _set_timer(self, at: int) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for event_id, ts, event in zip(batch["event_id"].tolist(), batch["micros"].tolist(), batch["event"].tolist()):
                if event == "run_started":
                    self.requests.updateValue((event_id,), (ts,))
                    first = ts if first is None else min(first, ts)
                else:
                    self.responses.updateValue((ts, event_id), (True,))
        if first is not None:
            self._set_timer(self._due(first))
        elif not self.timer.exists():
            self._forget(timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def _forget(self, before: int) -> None:
        for ts, event_id in [k for k in self.responses.keys() if k[0] < before]:
            self.responses.removeKey((ts, event_id))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = sorted((v[0], k[0]) for k, v in self.requests.iterator())
        answers = sorted(tuple(k) for k in self.responses.keys())
        found, at = [], 0
        for ts, event_id in waiting:
            if self._due(ts) > watermark:
                break
            while at < len(answers) and answers[at] <= (ts, event_id):
                at += 1
            waited = answers[at][0] - ts if at < len(answers) and answers[at][0] <= ts + self.limit else None
            found.append((key[0], event_id, waited, "no_response" if waited is None else "answered"))
            self.requests.removeKey((event_id,))
        left = waiting[len(found) :]
        if left:
            self._set_timer(self._due(left[0][0]))
        self._forget(min([watermark * 1000] + [ts for ts, _ in left[:1]]))
        yield pd.DataFrame(found, columns=["case_id", "request_id", "waited", "status"]).astype({"waited": "Int64"})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers and maps need the store that keeps state outside the heap."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def verdicts(stream: DataFrame, limit_seconds: int, late: str) -> DataFrame:
    """A stream (case_id, event_id, ts, event) -> case_id, request_id, waited (microseconds) and status of
    every request whose time is over. Repeated events count once; later than the watermark, not at all."""
    typed = stream.filter("event in ('run_started', 'run') and ts is not null and case_id is not null").select("case_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    marked = typed.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return marked.groupBy("case_id").transformWithStateInPandas(Waiting(limit_seconds * 1_000_000), ANSWERED, "Append", "EventTime")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives for all input that is there now, written to the shared folder and read back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/evidentia-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _rocksdb(spark):
        writer = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
