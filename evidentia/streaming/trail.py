"""The review trail: an append-only log of actions, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Events with ``session_no``: a gap longer than the limit starts a new one, an equal gap does not."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    first = F.when(since.isNull() | (since > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("starts", first).withColumn("session_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def session_summary(events: DataFrame, key: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    found = sessions(events, key, ts, gap_seconds, tie)
    return found.groupBy(key, "session_no").agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def latest_action(events: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Each key's last event: a maximum that is combined before the shuffle, not a window."""
    last = F.max(F.struct(ts, tie, *columns))
    return events.groupBy(key).agg(last.alias("e")).select(key, *[F.col("e")[c].alias(c) for c in (ts, tie, *columns)])


def daily_counts(events: DataFrame, ts: str, kind: str) -> DataFrame:
    """Tumbling days by kind. The same code serves a batch frame and a stream with a watermark."""
    day = F.window(F.col(ts), "1 day")
    return events.groupBy(day.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def watermarked(stream: DataFrame, ts: str, event_id: str, late: str = "1 hour") -> DataFrame:
    """The stream with its watermark and without repeated events within it.

    Parquet's timestamps without zone become timestamps first, which watermarks ask for."""
    typed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return typed.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])


def session_windows(stream: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Native session windows, for streams; state is bounded by the watermark."""
    found = stream.groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "n_events")


def event_state(event: Column, states: dict[str, str]) -> Column:
    """The state that an event leads to; null for events that change none."""
    return F.create_map(*[F.lit(x) for pair in states.items() for x in pair])[event]
