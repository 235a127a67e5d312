import datetime as dt

from cohortscope.plans.period import Period
from conftest import rows


def _ts(spark):
    return spark.createDataFrame(
        [(dt.datetime(2024, 5, 9, 0, 0, 0),), (dt.datetime(2024, 5, 9, 0, 0, 1),),
         (dt.datetime(2024, 5, 8, 23, 59),), (dt.datetime(2023, 4, 28),)],
        "t timestamp_ntz",
    )


def test_closed_period_on_timestamp_keeps_only_midnight_of_last_day(spark):
    out = _ts(spark).filter(Period.between("2023-04-28", "2024-05-09").mask("t"))
    got = sorted(r[0] for r in rows(out))
    assert dt.datetime(2024, 5, 9) in got and dt.datetime(2024, 5, 9, 0, 0, 1) not in got
    assert len(got) == 3


def test_half_open_period_excludes_upper_bound(spark):
    out = _ts(spark).filter(Period.half_open("2023-04-28", "2024-05-09").mask("t"))
    assert sorted(r[0] for r in rows(out)) == [dt.datetime(2023, 4, 28), dt.datetime(2024, 5, 8, 23, 59)]


def test_closed_period_on_dates_keeps_both_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 9),), (dt.date(2024, 5, 10),)], "d date")
    out = df.filter(Period.between("2023-04-28", "2024-05-09").mask("d", as_type="date"))
    assert rows(out) == [(dt.date(2024, 5, 9),)]


def test_period_reaches_the_scan(spark):
    from cohortscope.plans.guards import physical_plan
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = physical_plan(df.filter(Period.half_open("1996-01-01", "1997-01-01").mask("o_orderdate")).select("o_custkey"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
