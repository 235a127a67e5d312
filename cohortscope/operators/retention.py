"""Retention after a first event (R1-R3).

A cohort member's start day is the day of their first event in the period. Visits come
from a JSON date list per user, or as rows (one per visit, ``visit_ts`` given), and count only
when strictly after the start day, so day 0 never counts.

Visit rows are met by a range join on day bins (``operators.ranges``): visits move once, as a
mask of days per user and bin, and only bins that a member's bands reach are met.

No list is exploded: the start days (one row per member) are left-joined to the list
rows, each list is reduced in place with higher-order functions (``filter`` /
``array_min`` / ``exists``), and the rows are grouped per member. The join leaves the
rows hash-partitioned by user, so the grouping adds no shuffle, and members without any
list stay in the base with a NULL result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import list_dates, pct
from cohortscope.operators.ranges import any_day, day_number, first_day, window_masks
from cohortscope.operators.timing import first_event
from cohortscope.plans.period import Period

# A band is (low, high, name); high None means "low or more".
Band = tuple[int, "int | None", str]

# Fixed bands of the analyses.
INTERVAL_BANDS: tuple[Band, ...] = (
    (1, 7, "revisit_d7"), (8, 14, "revisit_d14"), (15, 30, "revisit_d30"),
    (31, None, "revisit_d30_plus"),
)
CUMULATIVE_BANDS: tuple[Band, ...] = (
    (1, 7, "revisit_d7"), (1, 14, "revisit_d14"), (1, 30, "revisit_d30"),
    (31, None, "revisit_d30_plus"),
)
ANY_VISIT_BANDS: tuple[Band, ...] = (
    (1, 7, "revisit_d7"), (1, 14, "revisit_d14"), (1, 30, "revisit_d30"),
)


def start_days(
    events: DataFrame, user: str = "user_id", ts: str = "created_at", period: Period | None = None
) -> DataFrame:
    """(user, start_date): the day of each user's first event in the period."""
    return first_event(events, user, ts, period, as_date=True, name="start_date")


def _in_band(diff, lo: int, hi: int | None):
    return diff >= lo if hi is None else diff.between(lo, hi)


def _visit_in_band(lo: int, hi: int | None):
    def test(d):
        start = F.col("start_date")
        return (d > start) & _in_band(F.datediff(d, start), lo, hi)

    return test


def _visits(starts: DataFrame, visits: DataFrame, user: str, list_col: str) -> DataFrame:
    lists = visits.select(F.col(user), list_dates(list_col).alias("_dates"))
    return starts.join(lists, user, "left")


def first_revisit(
    starts: DataFrame, visits: DataFrame, user: str = "user_id",
    list_col: str = "attendance_date_list",
) -> DataFrame:
    """(user, start_date, first_revisit_date) for every member; NULL when no visit
    follows the start day."""
    later = F.array_min(F.filter("_dates", lambda d: d > F.col("start_date")))
    return (
        _visits(starts, visits, user, list_col)
        .groupBy(user, "start_date")
        .agg(F.min(later).alias("first_revisit_date"))
    )


def _reach(bands: Sequence[Band]) -> int:
    """Days after the start that a window must hold for ``bands``: up to every band's end,
    and up to the day before an open band."""
    return max(1, *[(hi if hi is not None else lo - 1) for lo, hi, _ in bands])


def _by_first(fr: DataFrame, hits, base_name: str) -> DataFrame:
    cols = [F.count(F.lit(1)).alias(base_name)]
    for name, condition in hits:
        hit = F.count_if(condition)
        cols += [hit.alias(name), pct(hit, F.count(F.lit(1))).alias(f"{name}_rate")]
    return fr.agg(*cols)


def retention_by_first_revisit(
    starts: DataFrame,
    visits: DataFrame,
    bands: Sequence[Band] = INTERVAL_BANDS,
    user: str = "user_id",
    list_col: str = "attendance_date_list",
    base_name: str = "total_voted_users",
    visit_ts: str | None = None,
) -> DataFrame:
    """R1 / R2: members whose *first* revisit falls in each band, with rates.

    Disjoint bands (R1) give the interval view, bands all starting at day 1 (R2) the
    cumulative view. ``visits`` holds one JSON list per user (``list_col``), or with
    ``visit_ts`` one row per visit; then a first revisit beyond every closed band is only
    known to be later, which is all that an open band asks.
    """
    if visit_ts is None:
        fr = first_revisit(starts, visits, user, list_col)
        diff = F.datediff("first_revisit_date", "start_date")
        return _by_first(fr, [(name, _in_band(diff, lo, hi)) for lo, hi, name in bands], base_name)
    days, is_open = _reach(bands), any(hi is None for _, hi, _ in bands)
    seen = window_masks(starts, visits, user, "start_date", visit_ts, days, last=is_open)
    diff = first_day(days)
    later = diff.isNull() & (F.col("_last") - day_number("start_date") > days) if is_open else None
    return _by_first(seen, [
        (name, F.coalesce(_in_band(diff, lo, hi), F.lit(False)) | (later if hi is None else F.lit(False)))
        for lo, hi, name in bands], base_name)


def retention_by_any_visit(
    starts: DataFrame,
    visits: DataFrame,
    bands: Sequence[Band] = ANY_VISIT_BANDS,
    user: str = "user_id",
    list_col: str = "attendance_date_list",
    base_name: str = "total_voted_users",
    visit_ts: str | None = None,
) -> DataFrame:
    """R3: members with *any* visit in each band (after the start day), with rates.

    A start without a user is no member (``COUNT(DISTINCT user_id)``). ``visits`` as for
    :func:`retention_by_first_revisit`.
    """
    if visit_ts is None:
        flags = []
        for lo, hi, name in bands:
            hit = F.exists("_dates", _visit_in_band(lo, hi))
            flags.append(F.max(hit.cast("int")).alias(f"_{name}"))
        flagged = _visits(starts, visits, user, list_col).groupBy(user, "start_date").agg(*flags)
        hits = [(name, F.col(f"_{name}") == 1) for _, _, name in bands]
    else:
        is_open = any(hi is None for _, hi, _ in bands)
        flagged = window_masks(starts, visits, user, "start_date", visit_ts, _reach(bands), last=is_open)
        hits = [(name, F.col("_last") - day_number("start_date") >= max(lo, 1) if hi is None else any_day(lo, hi))
                for lo, hi, name in bands]
    n = F.count(user)
    cols = [n.alias(base_name)]
    for name, condition in hits:
        hit = F.count_if(condition & F.col(user).isNotNull())
        cols += [hit.alias(name), pct(hit, n).alias(f"{name}_rate")]
    return flagged.agg(*cols)
