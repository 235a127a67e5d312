"""Incremental upkeep of per-user first events with Structured Streaming.

The analyses contain no stream. But the time-to-event (T1), retention (R1-R3) and cohort
(C1) analyses all start from each user's *first* event, and on an append-only event log
that table can be kept current without rescanning the log:

* a streaming aggregation keeps ``min(ts)`` per user in the state store (its size is
  bounded by the number of users, not by the log);
* each trigger emits only the users whose minimum changed (``update`` mode) and
  ``foreachBatch`` appends them as parquet under ``out_dir``;
* readers take ``min`` per user over what was appended. ``min`` is idempotent, so a
  batch that is replayed after a failure (at-least-once append) changes nothing.

The checkpoint goes under the shared folder named by ``spark.checkpoint.dir`` unless a
location is given, so a restarted query resumes from its state on any executor set.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortscope.plans.period import Period, restrict
from cohortscope.session import checkpoint_dir


def first_event_updates(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "created_at",
    period: Period | None = None,
    where: Column | None = None,
    name: str = "first_at",
) -> DataFrame:
    """Streaming (or batch) aggregate: first ``ts`` per user in the period."""
    f = restrict(events, period, ts)
    if where is not None:
        f = f.filter(where)
    return f.groupBy(user).agg(F.min(ts).alias(name))


def start_first_events(
    events: DataFrame,
    out_dir: str,
    user: str = "user_id",
    ts: str = "created_at",
    period: Period | None = None,
    where: Column | None = None,
    checkpoint_location: str | None = None,
    query_name: str = "first_events",
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the streaming upkeep of first events from a streaming ``events`` DataFrame."""
    spark = events.sparkSession
    location = checkpoint_location or posixpath.join(checkpoint_dir(spark), query_name)
    updates = first_event_updates(events, user, ts, period, where)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    writer = (
        updates.writeStream.outputMode("update")
        .queryName(query_name)
        .option("checkpointLocation", location)
        .foreachBatch(write_batch)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_first_events(
    spark: SparkSession, out_dir: str, user: str = "user_id", name: str = "first_at"
) -> DataFrame:
    """Current first event per user: the minimum over all appended updates."""
    return spark.read.parquet(out_dir).groupBy(user).agg(F.min(name).alias(name))
