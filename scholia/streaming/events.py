"""Time-driven rules on event streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scholia.operators.learner import (
    CARD_GAIN,
    CARD_KEEP,
    QUIZ_GAIN,
    QUIZ_KEEP,
    QUIZ_PASS,
    TREND_STEP,
)
from scholia.sources.tables import VIEWS


def read_event_stream(
    spark: SparkSession, folder: str, schema: StructType, name: str = "events.parquet", per_batch: int | None = None
) -> DataFrame:
    """Parquet event files as a stream; a batch takes at most ``per_batch`` files where asked."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_batch is not None:
        files = files.option("maxFilesPerTrigger", per_batch)
    return files.parquet(folder)


def as_view(stream: DataFrame, name: str) -> DataFrame:
    """A catalogue view over the raw event stream (study_events, attempts)."""
    sql = VIEWS[name].replace("JSONK(", "get_json_object(")
    return stream.sparkSession.sql(sql, events=stream)


def stream_event_counts(events: DataFrame, window: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events per kind in tumbling or sliding windows; later rows than ``delay`` are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        events.withWatermark("ts", delay)
        .groupBy(span, "kind")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "kind", "n")
    )


def stream_sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Study sessions by inactivity gap, emitted once they can grow no more; minutes from first to last event."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last_seen"))
        .select(
            "user_id", "started", "last_seen", "events",
            F.floor((F.unix_micros("last_seen") - F.unix_micros("started")) / 60_000_000).alias("minutes"),
        )
    )


def stream_toggle_state(toggles: DataFrame) -> DataFrame:
    """Current like state per (user, item): on after an odd number of toggles."""
    return toggles.groupBy("user_id", "material_id").agg(((F.count("*") % 2) == 1).alias("liked"))


def stream_dedupe(events: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch in event order; batches are bounded by file count."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


class RateLimit(StatefulProcessor):
    """State per user: times of the last k accepted calls, until none of them can matter any more."""

    def __init__(self, k: int, seconds: int):
        self.k, self.window = k, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "us long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _in_order(rows)
        recent = [int(r[0]) for r in self.accepted.get()] if self.accepted.exists() else []
        verdicts = []
        for us in part["us"]:
            ok = len(recent) < self.k or recent[0] < us - self.window
            if ok:
                recent = [*recent, int(us)][-self.k :]
            verdicts.append(ok)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        due = (recent[-1] + self.window) // 1_000 + 1
        if due > timerValues.getCurrentWatermarkInMs():
            self.accepted.put([(us,) for us in recent])
            self.due.update((due,))
            self.handle.registerTimer(due)
        else:
            self.accepted.clear()
        yield pd.DataFrame({"event_id": part["event_id"], "user_id": key[0], "accepted": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(calls: DataFrame, k: int = 5, seconds: int = 600, delay: str = "1 day") -> DataFrame:
    """Accepted or rejected calls; a user's state goes once the watermark has left the window of the last call."""
    keyed = calls.withWatermark("ts", delay).select("event_id", "user_id", "ts", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("user_id").transformWithStateInPandas(
        RateLimit(k, seconds), "event_id long, user_id long, accepted boolean", "Append", "EventTime"
    )


class Mastery(StatefulProcessor):
    """State per (user, topic): level, attempts, correct, last review, trend."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "mastery", "level double, attempts long, correct long, last_us long, trend string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            level, attempts, correct, last, trend = self.state.get()
        else:
            level, attempts, correct, last, trend = 0.0, 0, 0, 0, "stable"
        for kind, ratio, us in _in_order(rows)[["kind", "ratio", "us"]].itertuples(index=False):
            before = level
            if kind == "quiz":
                level, hit = before * QUIZ_KEEP + ratio * QUIZ_GAIN, ratio >= QUIZ_PASS
            else:
                hit = ratio >= 0.5
                level = before * CARD_KEEP + (CARD_GAIN if hit else 0.0)
            if level - before > TREND_STEP:
                trend = "improving"
            elif before - level > TREND_STEP:
                trend = "declining"
            elif kind == "quiz":
                trend = "stable"
            attempts, correct, last = attempts + 1, correct + int(hit), max(last, int(us))
        self.state.update((level, attempts, correct, last, trend))
        yield pd.DataFrame(
            {
                "user_id": [key[0]], "topic": [key[1]], "level": [level], "attempts": [attempts],
                "correct": [correct], "last_us": [last], "trend": [trend],
            }
        )

    def close(self) -> None:
        pass


def stream_mastery(attempts: DataFrame) -> DataFrame:
    """Mastery kept up to date; each batch emits the topics it touched."""
    keyed = attempts.select("user_id", "topic", "event_id", "ts", F.unix_micros("ts").alias("us"), "kind", "ratio")
    return keyed.groupBy("user_id", "topic").transformWithStateInPandas(
        Mastery(),
        "user_id long, topic string, level double, attempts long, correct long, last_us long, trend string",
        "Update",
        "None",
    )


class StaleExpiry(StatefulProcessor):
    """State per item: its last update; a timer fails it when none follows in time."""

    def __init__(self, minutes: int):
        self.wait_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = _in_order(rows).iloc[-1]
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if last["status"] == "processing":
            due = int(last["ms"]) + self.wait_ms + 1
            if due <= timerValues.getCurrentWatermarkInMs():
                yield self._failed(key, due)
            else:
                self.due.update((due,))
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield self._failed(key, due)

    def _failed(self, key, due: int) -> pd.DataFrame:
        return pd.DataFrame({"item_id": [key[0]], "status": ["failed"], "due_ms": [due]})

    def close(self) -> None:
        pass


def stream_stale_expiry(updates: DataFrame, minutes: int = 10, delay: str = "1 minute") -> DataFrame:
    """'failed' for items left in processing with no update for ``minutes``."""
    keyed = updates.withWatermark("ts", delay).select(
        "item_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "status"
    )
    return keyed.groupBy("item_id").transformWithStateInPandas(
        StaleExpiry(minutes), "item_id long, status string, due_ms long", "Append", "EventTime"
    )
