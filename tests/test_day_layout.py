"""Tables in folders by day: the same results, and periods prune folders."""

import glob
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortscope.plans import catalog
from cohortscope.plans.guards import physical_plan
from cohortscope.plans.period import Period, restrict
from cohortscope.sources.bindings import Bindings
from cohortscope.sources.layout import day_column, laid_out, plain, use_layout, write_by_day
from cohortscope.sources.tables import read_table
from conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def folder(spark):
    out = tempfile.mkdtemp(prefix="cohortscope-days-", dir="/tmp")
    write_by_day(read_table(spark, SF_SMALL, "events"), out, "events", "ts")
    return out


@pytest.fixture
def layout(spark, folder):
    use_layout(spark, folder)
    yield folder
    use_layout(spark, None)


# Operators of every family that read the log, with all three conventions of a period.
NAMES = [
    "voters_in_period", "lookup_user_events", "distinct_voters_in_period", "weekly_vote_intensity",
    "top_voted_questions_in_periods", "attendance_vote_conversion", "friend_request_participation",
    "voter_candidate_overlap", "event_participation", "point_segments", "segment_completion",
    "candidate_skip_rate", "time_vote_to_spend", "time_signup_to_vote", "retention_any_visit_events",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_results_from_the_layout(spark, folder, name):
    build = catalog.queries()[name]
    want = build(spark, SF_SMALL)
    want_rows, want_columns = sorted(map(str, rows(want))), want.columns
    use_layout(spark, folder)
    try:
        got = build(spark, SF_SMALL)
        assert got.columns == want_columns and sorted(map(str, rows(got))) == want_rows
    finally:
        use_layout(spark, None)


def scanned(df, spark):
    """The scans' partition filters and the number of files they read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan's leaves are the scans then
    try:
        df = df.select("*")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    leaves = plan.collectLeaves()
    files = [leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size())]
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan.toString()), files


def test_orders_and_lines_from_the_layout(spark):
    """Two more tables, cut to a few days so that the test writes few folders."""
    out, small = (tempfile.mkdtemp(prefix=f"cohortscope-{n}-", dir="/tmp") for n in ("days", "plain"))
    for name, ts in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        cut = read_table(spark, SF_SMALL, name).withColumn(ts, F.timestamp_add(
            "DAY", F.pmod(F.unix_date(F.col(ts).cast("date")), F.lit(9)).cast("int"), F.lit("1996-12-28").cast("timestamp_ntz")))
        cut.write.parquet(f"{small}/{name}.parquet")
        write_by_day(cut, out, name, ts)
    for name in ("region", "customer", "events", "supplier", "part"):
        read_table(spark, SF_SMALL, name).write.parquet(f"{small}/{name}.parquet")
    names = ["browse_payments", "preview_payments", "candidate_piece_top_users", "payer_vote_conversion",
             "segment_non_members", "time_first_to_second_action", "retention_interval_visits", "candidate_skip_split"]
    want = {n: (catalog.queries()[n](spark, small).columns, rows(catalog.queries()[n](spark, small))) for n in names}
    use_layout(spark, out)
    try:
        for n in names:
            got = catalog.queries()[n](spark, small)
            assert (got.columns, sorted(map(str, rows(got)))) == (want[n][0], sorted(map(str, want[n][1]))), n
    finally:
        use_layout(spark, None)


def test_period_prunes_folders(spark, layout):
    days = len(glob.glob(f"{layout}/events.parquet/ts_day=*"))
    assert days == 30
    df = catalog.queries()["voters_in_period"](spark, SF_SMALL)  # the first 20 days, midnight of the 20th in
    filters, files = scanned(df, spark)
    assert any("ts_day" in f and "2024-01-20" in f for f in filters)
    assert files and sum(files) == 20 < days
    (day, one) = scanned(restrict(Bindings(spark, SF_SMALL).votes(), catalog.VOTE_DAY, "created_at"), spark)
    assert sum(one) == 2  # the day, and the day that the open end names
    plan = physical_plan(catalog.queries()["voters_in_period"](spark, SF_SMALL))
    assert "PushedFilters" in plan and "PartitionFilters: [isnotnull(ts_day" in plan


def test_without_a_setting_or_a_table_the_plain_one_is_read(spark, folder):
    assert laid_out(spark, "events") is None
    use_layout(spark, folder)
    try:
        assert laid_out(spark, "customer") is None and laid_out(spark, "events") is not None
        assert "ts_day" in Bindings(spark, SF_SMALL).events.columns
        assert plain(Bindings(spark, SF_SMALL).events).columns == read_table(spark, SF_SMALL, "events").columns
    finally:
        use_layout(spark, None)
    assert "ts_day" not in Bindings(spark, SF_SMALL).events.columns


@pytest.mark.parametrize("period", [
    Period.between("2024-01-02", "2024-01-03"), Period.half_open("2024-01-02", "2024-01-03"),
    Period.half_open("2024-01-02 12:00:00", "2024-01-03 12:00:00"),
])
def test_days_never_lose_a_row(spark, period):
    at = F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    plainly = spark.range(0, 4 * 24 * 60).select(at.alias("created_at"))
    laid = plainly.withColumn(day_column("created_at"), F.col("created_at").cast("date"))
    got = restrict(laid, period, "created_at").select("created_at")
    assert sorted(rows(got)) == sorted(rows(restrict(plainly, period, "created_at"))) != []


def test_null_times_and_appended_days(spark):
    out = tempfile.mkdtemp(prefix="cohortscope-days-", dir="/tmp")
    day = lambda d: spark.createDataFrame([(1, d), (2, None)], "user_id int, t string").select(
        "user_id", F.col("t").cast("timestamp_ntz").alias("at"))
    write_by_day(day("2024-01-01 10:00:00"), out, "log", "at")
    write_by_day(day("2024-01-02 10:00:00"), out, "log", "at", mode="append")
    log = spark.read.parquet(f"{out}/log.parquet")
    assert log.count() == 4 and log.filter("at_day IS NULL").count() == 2
    assert rows(restrict(log, Period.half_open("2024-01-02", "2024-01-03"), "at").select("user_id")) == [(1,)]


def test_a_hot_day_is_written_in_bounded_files(spark):
    out = tempfile.mkdtemp(prefix="cohortscope-days-", dir="/tmp")
    at = F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    log = spark.range(6000).select("id", at.cast("timestamp_ntz").alias("at"))
    write_by_day(log, out, "log", "at", rows_per_file=500)
    assert len(glob.glob(f"{out}/log.parquet/at_day=2024-01-01/*.parquet")) >= 4
    assert spark.read.parquet(f"{out}/log.parquet").count() == 6000
