"""Date and id lists stored as JSON text (L1-L5).

Per-row work uses higher-order functions on the parsed array (``array_min``,
``array_max``, ``filter``), so a list is never exploded unless one row per element is
the wanted output. Lists are bounded per user (one entry per calendar day), and every
aggregate over users is partially aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import (
    list_dates,
    list_length,
    list_timestamps,
    mean,
    month_label,
    safe_date,
)
from cohortscope.plans.period import Period, restrict
from cohortscope.sources.json_lists import explode_dates


def dates_per_row(df: DataFrame, key: str, list_col: str, strict: bool = False) -> DataFrame:
    """(key, dates array<date>) for rows whose list has at least one element.

    Matches the inner lateral join: NULL, malformed and empty lists contribute nothing
    (``strict``: text that is no JSON fails the job).
    """
    return (
        df.select(F.col(key), list_dates(list_col, strict).alias("dates"))
        .filter(F.size("dates") > 0)
    )


def first_last_by_key(
    df: DataFrame,
    key: str = "user_id",
    list_col: str = "attendance_date_list",
    first_name: str = "first_attendance_date",
    last_name: str = "last_attendance_date",
    strict: bool = False,
) -> DataFrame:
    """L2 first and last listed date per key (unparsable entries ignored)."""
    rows = dates_per_row(df, key, list_col, strict)
    return rows.groupBy(key).agg(
        F.min(F.array_min("dates")).alias(first_name),
        F.max(F.array_max("dates")).alias(last_name),
    )


def first_per_list(
    df: DataFrame,
    key: str = "user_id",
    list_col: str = "attendance_date_list",
    name: str = "start_at",
    instants: bool = False,
    strict: bool = False,
) -> DataFrame:
    """(key, first entry) of every stored list with an element: dates, or instants of lists
    of date-times. A key with several lists has several rows; nothing is shuffled."""
    entries = (list_timestamps if instants else list_dates)(list_col, strict)
    rows = df.select(F.col(key), entries.alias("entries")).filter(F.size("entries") > 0)
    return rows.select(key, F.array_min("entries").alias(name))


def first_timestamp_by_key(
    df: DataFrame,
    key: str = "user_id",
    list_col: str = "attendance_date_list",
    name: str = "start_at",
) -> DataFrame:
    """L2 on lists of date-times: the first listed instant per key (bad entries ignored)."""
    rows = df.select(F.col(key), list_timestamps(list_col).alias("times")).filter(F.size("times") > 0)
    return rows.groupBy(key).agg(F.min(F.array_min("times")).alias(name))


def first_last_overall(
    df: DataFrame,
    key: str = "user_id",
    list_col: str = "attendance_date_list",
    first_name: str = "global_first_attendance_date",
    last_name: str = "global_last_attendance_date",
    strict: bool = False,
) -> DataFrame:
    """L3 first and last listed date over the whole table (one row)."""
    rows = dates_per_row(df, key, list_col, strict)
    return rows.agg(
        F.min(F.array_min("dates")).alias(first_name),
        F.max(F.array_max("dates")).alias(last_name),
    )


def monthly_list_counts(
    df: DataFrame, list_col: str = "attendance_date_list", name: str = "attendance_cnt"
) -> DataFrame:
    """L4 listed entries per month.

    The text is cut on commas after stripping escaped quotes, brackets and quotes, so
    repeated dates count every time, empty tokens are dropped and a token that is not a
    date falls in the NULL month. NULL lists contribute nothing.
    """
    cleaned = F.col(list_col)
    for token in ('\\"', "[", "]", '"'):
        cleaned = F.replace(cleaned, F.lit(token), F.lit(""))
    tokens = df.select(F.explode(F.split(cleaned, ",")).alias("tok")).select(
        F.trim("tok").alias("tok")
    )
    return (
        tokens.filter(F.col("tok") != "")
        .groupBy(month_label(safe_date("tok")).alias("ym"))
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.col("ym").asc_nulls_first())
    )


def list_length_stats(
    users: DataFrame,
    cohort: DataFrame,
    list_col: str = "friend_id_list",
    user_key: str = "id",
    cohort_key: str = "user_id",
    user_period: Period | None = None,
    user_ts: str = "created_at",
    prefix: str = "friend_count",
    strict: bool = False,
) -> DataFrame:
    """L5 average / max / min list length over users who are in ``cohort``.

    The membership test is a left-semi join (EXISTS); the cohort side is reduced to its
    distinct keys first, so a user with many cohort rows costs one row. NULL lists are
    ignored by the aggregates; ``[]`` counts as 0.
    """
    members = cohort.select(F.col(cohort_key).alias(user_key)).distinct()
    base = restrict(users, user_period, user_ts).join(members, user_key, "left_semi")
    n = list_length(list_col, strict)
    return base.select(n.alias("n")).agg(
        mean("n").alias(f"avg_{prefix}"),
        F.max("n").alias(f"max_{prefix}"),
        F.min("n").alias(f"min_{prefix}"),
    )


__all__ = [
    "dates_per_row",
    "explode_dates",
    "first_last_by_key",
    "first_last_overall",
    "first_per_list",
    "first_timestamp_by_key",
    "list_length_stats",
    "monthly_list_counts",
]
