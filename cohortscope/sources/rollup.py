"""A per-user rollup of an event log, written once and shared by the per-user analyses.

One row per user, day and event type: how many events, the first and the last of them, and
sums of measures. The table is bucketed by user, so an analysis that counts per user or asks who
was active reads far fewer rows than the log and moves none of them: its grouping and its joins
by user find the rows in place.

A rollup answers a period exactly or not at all (:func:`answers`). Who was active: any period
whose lower bound is a midnight, since the first event of a day tells whether one lies before
the upper bound. How many events, and sums: periods whose bounds are midnights; events at the
very midnight have rows of their own, so a closed period, which ends with that instant, is
exact too. Other questions go to the log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.plans.period import Period
from cohortscope.sources.layout import write_bucketed

ROLLUP = "cohortscope.rollup"  # session setting: the table of the event log's rollup
COUNT = "n"


def user_days(
    events: DataFrame, user: str, ts: str, by: Sequence[str] = (), sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """``user, day, midnight, *by, n, created_at`` (the first event), ``last_at`` and the ``sums``
    (``{name: column}``), one row per user, day, whether at its midnight, and ``by``.

    Partially aggregated before its one shuffle. Rollups of disjoint parts of a log union to
    a rollup of the whole: every reader adds up, so (user, day) may repeat. Events without a
    time are left out, a NULL user keeps theirs.
    """
    at = events.filter(F.col(ts).isNotNull()).withColumn("_day", F.col(ts).cast("date"))
    midnight = F.col(ts) == F.col("_day").cast("timestamp_ntz")
    return at.groupBy(user, F.col("_day").alias("day"), midnight.alias("midnight"), *by).agg(
        F.count(F.lit(1)).alias(COUNT), F.min(ts).alias("created_at"), F.max(ts).alias("last_at"),
        *[F.sum(c).alias(name) for name, c in (sums or {}).items()])


def write_rollup(
    rollup: DataFrame, table: str, path: str, user: str, buckets: int, mode: str = "overwrite",
) -> None:
    """Save a rollup bucketed by ``user``. ``mode="append"`` adds the rows of further days, so a
    daily load reads that day's events only. ``path`` must be shared storage on a cluster."""
    write_bucketed(rollup, table, user, buckets, path, mode=mode)


def use_rollup(spark: SparkSession, table: str | None) -> None:
    """Answer per-user questions on the event log from ``table`` from now on (None: no longer)."""
    if table is None:
        spark.conf.unset(ROLLUP)
    else:
        spark.conf.set(ROLLUP, table)


def answers(period: Period | None, counts: bool) -> bool:
    """Whether a rollup by day answers a question over ``period`` exactly."""
    if period is None:
        return True
    midnight = lambda t: len(t) == 10 or t[10:].strip("T 0:.") == ""
    return midnight(period.lo) and (not counts or midnight(period.hi))


def rolled_up(spark: SparkSession, period: Period | None, counts: bool) -> DataFrame | None:
    """The session's rollup within ``period``, or None where there is none or it is not exact."""
    table = spark.conf.get(ROLLUP, None)
    if not table or not answers(period, counts):
        return None
    rows = spark.table(table)
    return rows if period is None else rows.filter(period.days("day") & period.mask("created_at"))
