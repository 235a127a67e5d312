"""The shared per-user rollup: equal results, no exchange by user."""

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortscope.operators import cohort
from cohortscope.plans import catalog
from cohortscope.plans.guards import physical_plan
from cohortscope.plans.period import Period, restrict
from cohortscope.sources import rollup
from cohortscope.sources.bindings import Bindings
from conftest import SF_SMALL, rows

READERS = ["voter_sender_share", "friend_requests_per_voter", "friend_requests_per_voter_alltime",
           "event_participation", "point_segments"]
MEMBERS = ["voter_candidate_overlap", "candidate_voter_overlap", "segment_active_members", "payer_vote_conversion",
           "attendance_vote_conversion", "friend_request_participation", "candidate_skip_rate", "eligible_conversion"]


@pytest.fixture(scope="module")
def table(spark):
    scratch = tempfile.mkdtemp(prefix="cohortscope-rollup-", dir="/tmp")
    events = Bindings(spark, SF_SMALL).event_rollup()
    early = events.filter("day < DATE'2024-01-20'")
    rollup.write_rollup(early, "event_rollup", f"{scratch}/rollup", "user_id", 8)
    rollup.write_rollup(events.exceptAll(early), "event_rollup", f"{scratch}/rollup", "user_id", 8, mode="append")
    yield "event_rollup"
    spark.sql("DROP TABLE IF EXISTS event_rollup")


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", READERS)
def test_queries_read_it_in_place(spark, table, no_broadcast, name):
    build = catalog.queries()[name]
    want = rows(build(spark, SF_SMALL))
    moved = lambda: re.findall(r"Exchange hashpartitioning\((?:user_id|_k)#", physical_plan(build(spark, SF_SMALL), "simple"))
    assert len(moved()) >= 2
    rollup.use_rollup(spark, table)
    try:
        assert rows(build(spark, SF_SMALL)) == want
        plan = physical_plan(build(spark, SF_SMALL), "simple")
        assert moved() == [] and "event_rollup" in plan and "events.parquet" not in plan
    finally:
        rollup.use_rollup(spark, None)


@pytest.mark.parametrize("name", MEMBERS)
def test_queries_take_their_members_from_it(spark, table, name):
    build = catalog.queries()[name]
    want = sorted(rows(build(spark, SF_SMALL)), key=str)
    rollup.use_rollup(spark, table)
    try:
        assert sorted(rows(build(spark, SF_SMALL)), key=str) == want
    finally:
        rollup.use_rollup(spark, None)


def test_it_is_smaller_than_the_log_and_adds_up(spark, table):
    log = Bindings(spark, SF_SMALL).events
    got = spark.table(table)
    assert got.count() < log.count()
    want = rows(log.groupBy("user_id", "event_type").agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")))
    own = rows(got.groupBy("user_id", "event_type").agg(F.sum("n"), F.min("created_at"), F.max("last_at")))
    assert sorted(own) == sorted(want)


@pytest.mark.parametrize("period,who,many", [
    (None, True, True), (Period.half_open("2024-01-01", "2024-01-04"), True, True),
    (Period.between("2024-01-01", "2024-01-04"), True, True),
    (Period.between("2024-01-01", "2024-01-04 06:00:00"), True, False),
    (Period.half_open("2024-01-01 00:00:00", "2024-01-04 00:00:00.000"), True, True),
    (Period.half_open("2024-01-01", "2024-01-04 12:00:00"), True, False),
    (Period.half_open("2024-01-01 08:00:00", "2024-01-04"), False, False),
])
def test_which_periods_it_answers(period, who, many):
    assert rollup.answers(period, counts=False) is who and rollup.answers(period, counts=True) is many


def test_membership_at_the_upper_bound(spark, table):
    """A closed period ends at the last day's midnight: an event then is in, one later is not."""
    at = lambda d, h=0, m=0, s=0: dt.datetime(2024, 1, d, h, m, s)
    log = spark.createDataFrame(
        [(1, "a", at(3)), (1, "a", at(3, 5)), (2, "a", at(3, 0, 0, 1)), (3, "a", at(2, 23)), (4, "a", None), (None, "a", at(2))],
        "user_id long, event_type string, ts timestamp_ntz")
    scratch = tempfile.mkdtemp(prefix="cohortscope-rollup-", dir="/tmp")
    rollup.write_rollup(rollup.user_days(log, "user_id", "ts", ["event_type"]), "edge_rollup", f"{scratch}/t", "user_id", 4)
    rollup.use_rollup(spark, "edge_rollup")
    try:
        for period in (Period.between("2024-01-01", "2024-01-03"), Period.half_open("2024-01-01", "2024-01-03"),
                       Period.half_open("2024-01-03", "2024-01-03 00:00:01"), None):
            got = rollup.rolled_up(spark, period, counts=False).select("user_id").distinct()
            want = cohort.cohort(log.filter("ts IS NOT NULL"), period=period, ts="ts")
            assert sorted(map(str, rows(got))) == sorted(map(str, rows(want))), period
            if rollup.answers(period, counts=True):
                n = rollup.rolled_up(spark, period, counts=True).agg(F.sum("n"))
                assert rows(n) == [(restrict(log.filter("ts IS NOT NULL"), period, "ts").count(),)], period
    finally:
        rollup.use_rollup(spark, None)
        spark.sql("DROP TABLE IF EXISTS edge_rollup")


def test_sums_and_a_hot_user(spark):
    log = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("user_id"), F.lit("x").alias("event_type"),
        F.timestamp_add("HOUR", (F.col("id") % 96).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") % 7).alias("v"))
    made = rollup.user_days(log, "user_id", "ts", sums={"total": "v"})
    assert "partial_count" in physical_plan(made)
    assert made.count() <= 2 * 50 * 4  # rows at midnight stand apart
    assert rows(made.agg(F.sum("n"), F.sum("total"))) == rows(log.agg(F.count(F.lit(1)), F.sum("v")))
