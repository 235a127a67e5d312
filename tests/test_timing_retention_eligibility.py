import datetime as dt

from cohortscope.operators import eligibility, retention, timing
from conftest import rows

T, D = dt.datetime, dt.date


def test_time_to_event_rules(spark):
    starts = spark.createDataFrame(
        [(1, T(2024, 1, 1, 23)), (2, T(2024, 1, 5)), (3, T(2024, 1, 1)), (4, T(2024, 1, 1))],
        "user_id long, start_at timestamp_ntz",
    )
    ends = spark.createDataFrame(
        [(1, T(2024, 1, 2, 1)), (2, T(2024, 1, 4)), (3, T(2024, 1, 11))],
        "user_id long, end_at timestamp_ntz",
    )
    cal = rows(timing.time_to_event(starts, ends, unit="calendar", share=True))
    # user 2's first end precedes its start: dropped; user 4 has no end
    assert cal == [(2, 50.0, 5.5, 1, 10)]
    ela = rows(timing.time_to_event(starts, ends, unit="elapsed", avg_digits=None))
    assert ela == [(2, 5.0, 0, 10)]


def test_first_event(spark):
    ev = spark.createDataFrame(
        [(1, T(2024, 1, 3, 5)), (1, T(2024, 1, 2, 7)), (2, T(2024, 2, 1))], "user_id long, created_at timestamp_ntz"
    )
    assert sorted(rows(timing.first_event(ev, as_date=True))) == [(1, D(2024, 1, 2)), (2, D(2024, 2, 1))]


def _ret(spark):
    starts = spark.createDataFrame(
        [(1, D(2024, 1, 1)), (2, D(2024, 1, 1)), (3, D(2024, 1, 1)), (4, D(2024, 1, 1)), (5, D(2024, 1, 1))],
        "user_id long, start_date date",
    )
    visits = spark.createDataFrame(
        [(1, '["2023-12-30", "2024-01-01", "2024-01-09", "2024-01-03"]'),
         (2, '["2024-01-20"]'), (3, '["2024-03-01"]'), (4, "[]")],
        "user_id long, attendance_date_list string",
    )
    return starts, visits


def test_interval_and_cumulative_retention(spark):
    starts, visits = _ret(spark)
    r1 = rows(retention.retention_by_first_revisit(starts, visits, retention.INTERVAL_BANDS))
    # first revisits: u1 day 2, u2 day 19, u3 day 60, u4/u5 none
    assert r1 == [(5, 1, 20.0, 0, 0.0, 1, 20.0, 1, 20.0)]
    r2 = rows(retention.retention_by_first_revisit(starts, visits, retention.CUMULATIVE_BANDS))
    assert r2 == [(5, 1, 20.0, 1, 20.0, 2, 40.0, 1, 20.0)]
    r3 = rows(retention.retention_by_any_visit(starts, visits, retention.ANY_VISIT_BANDS))
    assert r3 == [(5, 1, 20.0, 1, 20.0, 2, 40.0)]


def test_any_visit_band_not_starting_at_day_one(spark):
    starts, visits = _ret(spark)
    bands = ((8, 14, "d8_14"),)
    # u1 visits day 2 and day 8: any-visit counts it, first-revisit does not
    assert rows(retention.retention_by_any_visit(starts, visits, bands)) == [(5, 1, 20.0)]
    assert rows(retention.retention_by_first_revisit(starts, visits, bands)) == [(5, 0, 0.0)]


def _elig(spark):
    users = spark.createDataFrame(
        [(1, 10), (2, 10), (3, 10), (4, 11), (5, 11), (6, 11), (7, 12), (8, 12), (9, 12), (10, None),
         (11, None), (12, None), (13, 13)],
        "id long, group_id long",
    )
    groups = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, 1)], "id long, school_id long")
    schools = spark.createDataFrame([(1, 40), (2, 39), (3, None)], "id long, student_count int")
    return users, groups, schools


def test_eligibility(spark):
    users, groups, schools = _elig(spark)
    q = dict(rows(eligibility.qualified_groups(users, min_members=3)))
    assert q == {10: 3, 11: 3, 12: 3, None: 3}
    assert rows(eligibility.qualified_group_count(users, min_members=3)) == [(4,)]
    assert rows(eligibility.eligible_population(users, groups, schools, 40, 3)) == [(6, 2)]
    voters = spark.createDataFrame([(1,), (7,), (13,)], "user_id long")
    assert rows(eligibility.eligible_conversion(users, groups, schools, voters, 40, 3)) == [(6, 2, 33.33)]
    assert rows(eligibility.members_in_large_parents(users, groups, schools, 40)) == [(7,)]
