"""Streaming queries, drained to the end and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.duck import sql
from scholia.plans.learners import PLAIN
from scholia.plans.registry import ORACLES, register
from scholia.session import work_folder
from scholia.sources.tables import Catalog
from scholia.streaming import events as se
from scholia.streaming import sinks


#: Files, and so batches, that the events of a stream are split into by time.
SLICES = 3


def _stream(t: Catalog, view: str = "study_events", closed: bool = False) -> DataFrame:
    """The events as a stream of SLICES files in order of time, one a batch, so that state crosses batches.

    closed adds a last file with one event a year later, which lets everything before it end.
    """
    sinks.use_rocksdb(t.spark)
    path = work_folder(t.spark, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.events.select(F.percentile_approx(micros, [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    slice_of = F.lit(0)
    for cut in cuts:
        slice_of = slice_of + (micros > cut).cast("int")
    for i in range(SLICES):
        t.events.where(slice_of == i).coalesce(1).write.mode("append").parquet(path)
    if closed:
        later = (F.max("ts").cast("timestamp") + F.expr("INTERVAL 365 DAYS")).cast(t.events.schema["ts"].dataType)
        end = t.events.agg(later.alias("ts"), F.lit(-1).alias("user_id"), F.lit(-1).alias("event_id"))
        held = [F.col(f.name).cast(f.dataType) if f.name in end.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in t.events.schema]
        end.select(*held).write.mode("append").parquet(path)
    return se.as_view(se.read_event_stream(t.spark, path, t.events.schema, "*.parquet", per_batch=1), view)


def _whole_stream(t: Catalog) -> DataFrame:
    """The events as one batch, for results that depend on where batches end."""
    sinks.use_rocksdb(t.spark)
    return se.as_view(se.read_event_stream(t.spark, t.folder, t.events.schema), "study_events")


def _appended(t: Catalog, stream: DataFrame, name: str) -> DataFrame:
    path = work_folder(t.spark, name)
    sinks.append_to_table(stream, path)
    return t.spark.read.schema(stream.schema).parquet(f"{path}/table")


def _upserted(t: Catalog, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path = work_folder(t.spark, name)
    sinks.stream_upsert_sink(stream, path, keys)
    return sinks.read_upserted(t.spark, path)


@register(
    "stream_event_counts",
    sql("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, kind, count(*) AS n FROM study_events GROUP BY ALL"),
)
def _(t: Catalog):
    return _upserted(t, se.stream_event_counts(_stream(t), "1 day"), "counts", ["window_start", "kind"])


@register(
    "stream_sliding_counts",
    sql("""SELECT window_start, kind, count(*) AS n FROM (SELECT kind, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL 12 HOUR]) AS window_start
           FROM study_events) GROUP BY ALL"""),
)
def _(t: Catalog):
    return _upserted(t, se.stream_event_counts(_stream(t), "1 day", "12 hours"), "sliding", ["window_start", "kind"])


@register(
    "stream_sessions",
    sql("""
    SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS minutes FROM (
      SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM study_events))
    GROUP BY user_id, g"""),
)
def _(t: Catalog):
    return _appended(t, se.stream_sessions(_stream(t, closed=True), "6 hours"), "sessions")


@register("stream_rate_limit", ORACLES["rate_limit_audit"])
def _(t: Catalog):
    return _appended(t, se.stream_rate_limit(_stream(t), 5, 86_400), "limit")


@register(
    "stream_mastery",
    sql("SELECT user_id, topic, round(level, 6) AS level, attempts, correct, trend FROM mastery", **PLAIN),
)
def _(t: Catalog):
    out = _upserted(t, se.stream_mastery(_stream(t, "attempts")), "mastery", ["user_id", "topic"])
    return out.select("user_id", "topic", F.round("level", 6).alias("level"), "attempts", "correct", "trend")


@register("stream_toggle_state", ORACLES["toggle_replay"])
def _(t: Catalog):
    toggles = _stream(t).where("kind = 'like_toggle'")
    state = _upserted(t, se.stream_toggle_state(toggles), "toggles", ["user_id", "material_id"])
    return state.groupBy("material_id").agg(F.sum(F.col("liked").cast("long")).alias("likes"))


@register(
    "stream_stale_expiry",
    sql("""SELECT material_id AS item_id, 'failed' AS status FROM study_events
           GROUP BY material_id HAVING arg_max(kind, (ts, event_id)) IN ('session', 'quiz')
             AND max(epoch_ms(ts)) + 600001 <= (SELECT max(epoch_ms(ts)) FROM study_events) - 60000"""),
)
def _(t: Catalog):
    """Items whose last event opened work that nothing closed."""
    opened = F.when(F.col("kind").isin("session", "quiz"), "processing").otherwise("ready")
    updates = _whole_stream(t).select("event_id", "ts", F.col("material_id").alias("item_id"), opened.alias("status"))
    return _appended(t, se.stream_stale_expiry(updates), "expiry").select("item_id", "status")


@register(
    "stream_dedupe",
    sql("SELECT DISTINCT user_id, kind, material_id FROM study_events"),
)
def _(t: Catalog):
    keys = ["user_id", "kind", "material_id"]
    return _appended(t, se.stream_dedupe(_stream(t), keys, "60 days"), "dedupe").select(*keys)


@register(
    "stream_upsert_sink",
    sql("SELECT user_id, max(ts) AS last_seen, count(*) AS events FROM study_events GROUP BY user_id"),
)
def _(t: Catalog):
    latest = _stream(t).groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))
    return _upserted(t, latest, "latest", ["user_id"])
