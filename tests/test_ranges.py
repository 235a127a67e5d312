"""Range joins by day bins and retention over visit rows, against brute force."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortscope.operators import ranges, retention
from cohortscope.plans import catalog
from cohortscope.plans.guards import physical_plan, plan_violations
from conftest import SF_SMALL, rows

DAY0 = dt.date(1969, 11, 20)  # bins before and after the epoch


def make(spark, seed=1, users=40, visits=1500):
    rnd = random.Random(seed)
    starts = [(u, DAY0 + dt.timedelta(rnd.randrange(120))) for u in range(users)] + [(None, DAY0), (900, None)]
    # User 0 has a third of all visits; some users have none; NULL users and days.
    vs = [(0 if k % 3 == 0 else rnd.randrange(users // 2, users + 5),
           dt.datetime.combine(DAY0, dt.time(rnd.randrange(24), 59)) + dt.timedelta(rnd.randrange(260)))
          for k in range(visits)]
    vs += [(None, dt.datetime(1970, 1, 1)), (3, None), (900, dt.datetime(1970, 1, 1))]
    a = spark.createDataFrame(starts, "user_id int, start_date date")
    b = spark.createDataFrame(vs, "user_id int, at timestamp_ntz")
    return a, b, starts, vs


def after(starts, visits):
    days = {}
    for u, at in visits:
        if u is not None and at is not None:
            days.setdefault(u, set()).add(at.date())
    return [(u, sorted((d - s).days for d in days.get(u, ()) if s is not None and d > s)) for u, s in starts]


@pytest.mark.parametrize("lo,hi,width", [(0, 0, None), (1, 30, None), (-5, 3, 2), (10, 40, 7), (1, 1, 100)])
def test_range_join_against_brute_force(spark, lo, hi, width):
    a, b, starts, visits = make(spark)
    got = rows(ranges.range_join(a, b, ["user_id"], "start_date", "at", lo, hi, width))
    want = [(u, s, at) for u, s in starts for v, at in visits
            if u is not None and u == v and s is not None and at is not None and lo <= (at.date() - s).days <= hi]
    assert sorted(got) == sorted(want) and want
    with pytest.raises(ValueError):
        ranges.range_join(a, b, ["user_id"], "start_date", "at", 2, 1)


@pytest.mark.parametrize("days", [1, 30, 31, 62, 63, 130])
def test_windows_against_brute_force(spark, days):
    a, b, starts, visits = make(spark, seed=days)
    got = ranges.window_masks(a, b, "user_id", "start_date", "at", days, last=True)
    lo = max(1, days - 40)
    out = {r.user_id: r for r in got.withColumn("first", ranges.first_day(days)).withColumn(
        "hit", ranges.any_day(lo, days)).collect()}
    assert len(out) == len(starts)
    for u, found in after(starts, visits):
        inside = [d for d in found if d <= days]
        assert out[u]["first"] == (min(inside) if inside else None), (u, found)
        assert out[u]["hit"] == any(lo <= d for d in inside)


def test_moved_masks(spark):
    rnd = random.Random(2)
    cases = [(rnd.getrandbits(32) | 1 << rnd.randrange(32), by) for by in range(-70, 71) for _ in range(3)]
    table = spark.createDataFrame(cases, "mask long, by long")
    low = F.lit((1 << 62) - 1).cast("long")
    for mask, by, got in rows(table.withColumn("got", ranges._moved(F.col("mask"), F.col("by")).bitwiseAND(low))):
        kept = mask << by if by >= 0 else mask >> -by
        assert got == (0 if by >= 62 else kept & (1 << 62) - 1), (mask, by)


@pytest.mark.parametrize("bands", [retention.INTERVAL_BANDS, retention.CUMULATIVE_BANDS, ((2, 3, "a"), (70, 80, "b"), (5, None, "c"))])
def test_retention_of_rows(spark, bands):
    a, b, starts, visits = make(spark, seed=7)
    found = after(starts, visits)
    inside = lambda d, lo, hi: d >= lo and (hi is None or d <= hi)
    first = rows(retention.retention_by_first_revisit(a, b, bands, visit_ts="at"))[0]
    assert first[0] == len(starts)
    assert list(first[1::2]) == [sum(bool(d) and inside(min(d), lo, hi) for _, d in found) for lo, hi, _ in bands]
    every = rows(retention.retention_by_any_visit(a, b, bands, visit_ts="at"))[0]
    assert every[0] == len(starts) - 1  # the NULL user is no member
    assert list(every[1::2]) == [sum(any(inside(x, lo, hi) for x in d) for _, d in found) for lo, hi, _ in bands]


def test_rows_and_lists_agree(spark):
    """The same visits as JSON lists and as rows."""
    for name in ("retention_interval", "retention_cumulative", "retention_any_visit"):
        lists, visits = (rows(catalog.queries()[n](spark, SF_SMALL)) for n in (name, f"{name}_visits"))
        assert lists == visits


def test_no_visits_and_no_starts(spark):
    a, b, starts, _ = make(spark)
    none = retention.retention_by_first_revisit(a, b.limit(0), visit_ts="at")
    assert rows(none)[0][:2] == (len(starts), 0)
    assert rows(retention.retention_by_first_revisit(a.limit(0), b, visit_ts="at"))[0][:2] == (0, 0)


def test_plan_shuffles_visits_once_and_builds_no_list(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["retention_any_visit_events"](spark, SF_SMALL)
        plan = physical_plan(df, "simple")
        assert plan_violations(df) == [] and "collect_" not in plan
        # Visits move on (user, bin) as masks, partially ORed before; the join adds no exchange of theirs.
        assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+L?, _groupingexpression", plan)) == 1
        assert "partial_bit_or" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
