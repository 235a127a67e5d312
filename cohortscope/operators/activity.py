"""Activity reports over an event log (A1-A8).

Per-user counts are computed with partial aggregation (map-side combine), so a user who
holds a large share of the log sends one partial row per partition, not its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import div, dround, iso_yearweek, month_label
from cohortscope.plans.period import Period, restrict


def activity_totals(
    df: DataFrame, user: str = "user_id", users_name: str = "paying_users",
    rows_name: str = "total_payments",
) -> DataFrame:
    """A1 distinct users and rows."""
    return df.agg(F.countDistinct(user).alias(users_name), F.count(F.lit(1)).alias(rows_name))


def events_per_user(df: DataFrame, user: str = "user_id", name: str = "avg_payments_per_user") -> DataFrame:
    """A2 ``COUNT(*) / COUNT(DISTINCT user)`` with the dialect's 4 extra decimals."""
    return df.agg(div(F.count(F.lit(1)), F.countDistinct(user)).alias(name))


UNITS = {"week": ("year_week", iso_yearweek), "month": ("ym", month_label)}


def activity_state(
    df: DataFrame, unit: str, user: str = "user_id", ts: str = "created_at",
    period: Period | None = None, n: str = "n",
) -> DataFrame:
    """(user, unit, n): rows per user and ISO week (``year_week``) or month (``ym``).

    The mergeable state of A3 and A6: states of disjoint parts of a log (days, say) union to
    the state of the whole, as their readers add up. So a new day is its own small state, and
    no earlier row is read again (``sources.state`` keeps the loads). NULL users and times
    keep rows of their own.
    """
    name, label = UNITS[unit]
    return restrict(df, period, ts).groupBy(user, label(ts).alias(name)).agg(F.count(F.lit(1)).alias(n))


def merge_states(states: DataFrame, n: str = "n") -> DataFrame:
    """One row per key of united states."""
    keys = [c for c in states.columns if c != n]
    return states.groupBy(*keys).agg(F.sum(n).cast("long").alias(n))


def monthly_activity_of(
    state: DataFrame, user: str = "user_id", rows_name: str = "payment_cnt", users_name: str = "paying_users",
    merged: bool = False,
) -> DataFrame:
    """A3 from the monthly state of any number of loads (``merged``: one row per key already)."""
    per_user = state if merged else merge_states(state.select(user, "ym", "n"))
    return (
        per_user.groupBy("ym")
        .agg(F.sum("n").cast("long").alias(rows_name), F.count(user).alias(users_name))
        .orderBy("ym")
    )


def monthly_activity(
    df: DataFrame, ts: str = "created_at", user: str = "user_id",
    rows_name: str = "payment_cnt", users_name: str = "paying_users",
) -> DataFrame:
    """A3 per month: rows and distinct users, through the monthly state (one row per user and
    month after the first, partially aggregated shuffle)."""
    return monthly_activity_of(activity_state(df, "month", user, ts), user, rows_name, users_name, merged=True)


def frequency_histogram(
    df: DataFrame, user: str = "user_id", freq_name: str = "payment_cnt", users_name: str = "user_cnt"
) -> DataFrame:
    """A4 how many users have exactly n rows (two aggregation levels)."""
    per_user = df.groupBy(user).agg(F.count(F.lit(1)).alias(freq_name))
    return (
        per_user.groupBy(freq_name).agg(F.count(F.lit(1)).alias(users_name)).orderBy(freq_name)
    )


def item_stats(
    df: DataFrame, item: str = "productId", user: str = "user_id",
    rows_name: str = "payment_cnt", users_name: str = "users",
) -> DataFrame:
    """A5 per item: rows and distinct users, by rows descending (key as tie-break)."""
    return (
        df.groupBy(item)
        .agg(F.count(F.lit(1)).alias(rows_name), F.countDistinct(user).alias(users_name))
        .orderBy(F.col(rows_name).desc(), F.col(item))
    )


def weekly_intensity(
    df: DataFrame, user: str = "user_id", ts: str = "created_at",
    period: Period | None = None, name: str = "avg_votes_per_week_per_user",
) -> DataFrame:
    """A6 mean over users of (rows / active ISO weeks).

    Weeks without activity are not in a user's denominator. The per-user ratio keeps 4
    decimals (integer division of the dialect), the mean is rounded to 2.
    """
    return weekly_intensity_of(activity_state(df, "week", user, ts, period), user, name, merged=True)


def weekly_intensity_of(
    state: DataFrame, user: str = "user_id", name: str = "avg_votes_per_week_per_user", merged: bool = False,
) -> DataFrame:
    """A6 from the weekly state of any number of loads (``merged``: one row per key already)."""
    weekly = state if merged else merge_states(state.select(user, "year_week", "n"))
    per_user = weekly.groupBy(user).agg(div(F.sum("n"), F.count(F.lit(1))).alias("avg_votes_per_active_week"))
    # AVG of a 4-decimal value keeps 8 decimals, so only the final rounding applies.
    return per_user.agg(dround(F.avg("avg_votes_per_active_week"), 2).alias(name))


def rank_users(
    df: DataFrame, user: str = "user_id", count_col: str = "created_at", name: str = "payment_cnt"
) -> DataFrame:
    """A7 non-NULL rows per user, descending (no limit; user id as tie-break)."""
    return (
        df.groupBy(user)
        .agg(F.count(F.col(count_col)).alias(name))
        .orderBy(F.col(name).desc(), F.col(user))
    )


def joined_item_counts(
    facts: DataFrame,
    cohort: DataFrame,
    user: str = "user_id",
    item: str = "question_piece_id",
    k: int = 20,
    facts_period: Period | None = None,
    cohort_period: Period | None = None,
    ts: str = "created_at",
    name: str = "question_piece_cnt",
    fanout: bool = False,
) -> DataFrame:
    """A8 top-k users of ``facts`` by row count, among users present in ``cohort``.

    The intent is a membership test (left-semi join on the distinct cohort keys). With
    ``fanout=True`` the literal inner join is reproduced: each fact row counts once per
    matching cohort row. Both are computed from per-user counts, so no row-by-row join of
    two fact tables happens.
    """
    counts = (
        restrict(facts, facts_period, ts)
        .groupBy(user)
        .agg(F.count(F.col(item)).alias(name))
    )
    members = restrict(cohort, cohort_period, ts)
    if fanout:
        per_user = members.groupBy(user).agg(F.count(F.lit(1)).alias("_m"))
        counts = counts.join(per_user, user).select(
            user, (F.col(name) * F.col("_m")).alias(name)
        )
    else:
        counts = counts.join(members.select(user).distinct(), user, "left_semi")
    return counts.orderBy(F.col(name).desc(), F.col(user)).limit(k)
