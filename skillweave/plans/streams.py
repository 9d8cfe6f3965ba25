"""Queries that run the streaming forms to their end and return what they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skillweave import streaming
from skillweave.plans.tables import table
from skillweave.session import shared_folder


def _events(spark, d, files):
    schema = table(spark, d, "events").schema
    return streaming.read_new_files(spark, f"{d}/events.parque[t]", schema, files_per_batch=files), schema  # a pattern may match a file or a folder


def streamed_latest(spark, d, files=100):
    """The last event of every user, by merging the stream of events into a table; in whatever batches events come."""
    stream, schema = _events(spark, d, files)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    held = streaming.VersionedTable(spark, f"{at}/table", schema, ["user_id"])
    policy = {c: "overwrite" for c in schema.fieldNames() if c != "user_id"}
    streaming.merge_stream(stream, held, policy, f"{at}/checkpoint", lambda: [F.col("ts"), F.col("event_id")], newer=["ts", "event_id"]).awaitTermination()
    return held.read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def streamed_windows(spark, d, files=100):
    """Events per hour and type, counted by the stream; the last hour is open until later events close it.

    Files may come in any order of time, so there is no watermark: the state has a row per hour and type.
    """
    stream, _ = _events(spark, d, files)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    stamped = stream.withColumn("at", F.col("ts").cast("timestamp"))
    counted = streaming.windowed_counts(stamped, "at", "event_type", "value", "1 hour", late=None)
    held = streaming.VersionedTable(spark, f"{at}/table", "window_start timestamp, event_type string, n bigint, total double, last timestamp")
    streaming.replace_stream(counted, held, f"{at}/checkpoint").awaitTermination()
    every = held.read()
    end = every.agg(F.max("last").alias("end"))
    found = every.crossJoin(F.broadcast(end)).where(F.col("window_start") + F.expr("interval 1 hour") <= F.col("end"))  # one row
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (streamed_latest, streamed_windows)}

ORACLE = {
    "streamed_latest": """SELECT user_id, event_id, event_type, round("value", 6) "value" FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "streamed_windows": """SELECT date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum("value"), 4) total FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2""",
}
