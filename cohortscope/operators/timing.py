"""Time from one event to the next (T1).

Rule shared by every variant: take each side's *first* event per user, then compare.
A user whose first end event precedes the start is dropped even if a later end event
follows it. Both sides are stacked and reduced by one conditional aggregate per user, so
nothing is joined and rows move once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import days_between, dround, mean, pct
from cohortscope.plans.period import Period, restrict


def first_event(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "created_at",
    period: Period | None = None,
    where: Column | None = None,
    as_date: bool = False,
    name: str = "start_at",
) -> DataFrame:
    """(user, first ts) per user in the period; ``as_date`` keeps only the day."""
    f = restrict(df, period, ts)
    if where is not None:
        f = f.filter(where)
    first = F.min(ts)
    if as_date:
        first = first.cast("date")
    return f.groupBy(user).agg(first.alias(name))


def event_times(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "created_at",
    period: Period | None = None,
    where: Column | None = None,
    as_date: bool = False,
    name: str = "start_at",
) -> DataFrame:
    """(user, time) of every event in the period, not yet reduced: a side of
    :func:`time_to_event`."""
    f = restrict(df, period, ts)
    if where is not None:
        f = f.filter(where)
    at = F.col(ts)
    return f.select(F.col(user), (at.cast("date") if as_date else at).alias(name))


def first_pair(
    starts: DataFrame, ends: DataFrame, user: str = "user_id", start_col: str = "start_at",
    end_col: str = "end_at",
) -> DataFrame:
    """(user, first start, first end) of every user with a row in ``starts``; the first end
    is NULL where ``ends`` has none.

    Both sides may hold any number of rows per user. They are stacked and reduced by one
    conditional aggregate: one exchange on the user, no join, and a user with a third of all
    rows sends one row per partition. A NULL user keeps their starts and meets no end.
    """
    s = starts.select(F.col(user), F.col(start_col), F.lit(True).alias("_s"))
    e = ends.filter(F.col(user).isNotNull()).select(F.col(user), F.col(end_col), F.lit(False).alias("_s"))
    both = s.unionByName(e, allowMissingColumns=True)
    return (
        both.groupBy(user)
        .agg(F.bool_or("_s").alias("_s"), F.min(start_col).alias(start_col), F.min(end_col).alias(end_col))
        .filter("_s").drop("_s")
    )


def time_to_event(
    starts: DataFrame,
    ends: DataFrame,
    user: str = "user_id",
    start_col: str = "start_at",
    end_col: str = "end_at",
    unit: str = "elapsed",
    strict: bool = False,
    share: bool = False,
    avg_digits: int | None = 2,
    names: Sequence[str] = ("user_cnt", "avg_days", "min_days", "max_days"),
    share_name: str = "user_ratio_pct",
    first_start: Column | None = None,
) -> DataFrame:
    """Users whose first end follows their first start, and avg / min / max days between.

    ``starts`` and ``ends`` hold any number of rows per user (:func:`event_times`, or one row
    per user from elsewhere). ``unit``: ``calendar`` (difference of dates) or ``elapsed``
    (whole 24 h units). ``strict``: end must be later than start (``>``), else ``>=``.
    ``share``: add the users' percentage of all starters. ``avg_digits``: the mean keeps 4
    decimals; 2 rounds it again to 2. ``first_start``: a condition on the first start, for
    starters whose first event must fall in a period.
    """
    pairs = first_pair(starts, ends, user, start_col, end_col)
    if first_start is not None:
        pairs = pairs.filter(first_start)
    s, e = F.col(start_col), F.col(end_col)
    ok = (e > s) if strict else (e >= s)
    diff = F.when(ok, days_between(s, e, unit))
    stats = pairs.select(diff.alias("_d"))
    avg = mean("_d") if avg_digits is None else dround(mean("_d"), avg_digits)
    cols = [F.count("_d").alias(names[0])]
    if share:
        cols.append(pct(F.count("_d"), F.count(F.lit(1))).alias(share_name))
    cols += [avg.alias(names[1]), F.min("_d").alias(names[2]), F.max("_d").alias(names[3])]
    return stats.agg(*cols)
