"""Streams of events: windows, sessions, interval join, user state, activity graph.

Windows and sessions are emitted once, when the watermark has passed their end, so
the state stays bounded and late events change nothing that was written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windows(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``(start, end, event_type, n, total)`` per closed window; an event repeated
    within ``delay`` counts once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        once.groupBy(span.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("w.start", "w.end", "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """``(user_id, start, end, n)`` of closed sessions. Sessions are merged inside each
    task before the shuffle, so a busy user sends sessions and not events."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", "w.start", "w.end", "n")
    )


def interval_join(views: DataFrame, purchases: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """``(user_id, view_id, purchase_id, view_ts, purchase_ts)``: purchases within ``seconds``
    after a view of the same user.

    Both streams carry a time bucket as wide as the interval in their join key: a view
    enters its own bucket and the next. One user's events thus spread over tasks,
    and rows meet only those of two buckets.
    """
    bucket = F.floor(F.unix_timestamp("ts") / F.lit(seconds))
    v = (
        views.select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"),
                     F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
        .withWatermark("view_ts", delay)
    )
    p = purchases.select(
        F.col("user_id").alias("p_user"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"),
        bucket.alias("p_bucket"),
    ).withWatermark("purchase_ts", delay)
    return v.join(
        p,
        (F.col("user_id") == F.col("p_user"))
        & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("purchase_ts") >= F.col("view_ts"))
        & (F.col("purchase_ts") <= F.col("view_ts") + F.expr(f"INTERVAL {seconds} SECONDS")),
    ).select("user_id", "view_id", "purchase_id", "view_ts", "purchase_ts")


def activity_edges(events: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """``(start, src, dst, weight)``: user-to-event-type edges per closed window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "user_id", "event_type")
        .agg(F.count("*").alias("weight"))
        .select(
            F.col("w.start").alias("start"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"),
            F.concat(F.lit("type:"), "event_type").alias("dst"),
            "weight",
        )
    )


class UserProfile(StatefulProcessor):
    """Running count, total and last time per user. A user idle for ``idle_ms`` of event
    time, past the watermark, is forgotten and starts anew."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", "n bigint, total double, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, last = self.state.get() if self.state.exists() else (0, 0.0, None)
        for pdf in rows:
            n += int(pdf["n"].sum())
            total += float(pdf["total"].sum())
            newest = pdf["last"].max().to_pydatetime()
            last = newest if last is None else max(last, newest)
        self.state.update((n, total, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ms = int(pd.Timestamp(last).timestamp() * 1000)
        self.handle.registerTimer(ms + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "last": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.groupby("user_id", as_index=False).agg(
            n=("event_id", "size"), total=("value", "sum"), last=("ts", "max")
        )


def profiles(events: DataFrame, idle_ms: int = 90 * 86_400_000, delay: str = "1 hour") -> DataFrame:
    """``(user_id, n, total, last)`` after each micro-batch, in update mode.

    Arrow batches are summed per user before the shuffle, so a busy user's state is
    fed one row per batch.
    """
    events.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    shape = "user_id bigint, n bigint, total double, last timestamp"
    part = events.select("user_id", "event_id", "value", "ts").mapInPandas(_combine, shape).withWatermark("last", delay)
    return part.groupBy("user_id").transformWithStateInPandas(
        UserProfile(idle_ms), outputStructType=shape, outputMode="Update", timeMode="EventTime"
    )
