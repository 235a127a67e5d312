import datetime as dt

from pyspark.sql import functions as F

from cohortscope.functions import exprs as X
from conftest import rows


def test_rounding_is_half_up_on_the_decimal_value(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (0.125,), (-1.005,)], "x double")
    assert [r[0] for r in rows(df.select(X.dround("x", 2)))] == [1.01, 2.68, 0.13, -1.01]


def test_pct_and_zero_denominator(spark):
    df = spark.createDataFrame([(41, 1293), (1, 0), (0, 5)], "a long, b long")
    out = rows(df.select(X.pct("a", "b"), X.div("a", "b"), X.pct_text("a", "b")))
    assert out == [(3.17, 0.0317, "3.17%"), (None, None, None), (0.0, 0.0, "0.00%")]


def test_pct_text_keeps_two_decimals(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert rows(df.select(X.pct_text("a", "b"))) == [("50.00%",)]


def test_safe_date_accepts_unpadded_and_rejects_junk(spark):
    df = spark.createDataFrame([("2023-5-7",), ("2023-05-27",), (" 2024-01-02 ",), ("zz",), (None,)], "s string")
    got = [r[0] for r in rows(df.select(X.safe_date("s")))]
    assert got == [dt.date(2023, 5, 7), dt.date(2023, 5, 27), dt.date(2024, 1, 2), None, None]


def test_iso_yearweek_at_new_year(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 12),), (dt.datetime(2021, 1, 3),)], "t timestamp_ntz")
    assert [r[0] for r in rows(df.select(X.iso_yearweek("t")))] == [202501, 202053]


def test_calendar_vs_elapsed_days(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))], "s timestamp_ntz, e timestamp_ntz"
    )
    out = rows(df.select(X.days_between("s", "e", "calendar"), X.days_between("s", "e", "elapsed")))
    assert out == [(1, 0)]


def test_parse_list_variants(spark):
    df = spark.createDataFrame(
        [('["2024-01-02","2024-01-03"]',), ('[\\"2024-01-02\\"]',), ("[]",), (None,), ("not json",),
         ('["2024-01-02", null, "bad"]',)],
        "s string",
    )
    got = [r[0] for r in rows(df.select(X.list_dates("s")))]
    assert got[0] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    assert got[1] == [dt.date(2024, 1, 2)]
    assert got[2] == []
    assert got[3] is None and got[4] is None
    assert got[5] == [dt.date(2024, 1, 2), None, None]


def test_list_length(spark):
    df = spark.createDataFrame([("[1,2,3]",), ("[]",), (None,), ("bad",)], "s string")
    assert [r[0] for r in rows(df.select(X.list_length("s")))] == [3, 0, None, None]


def test_flag_sum_null_on_empty(spark):
    df = spark.createDataFrame([(1,)], "x int").filter(F.col("x") > 5)
    assert rows(df.agg(X.flag_sum(F.col("x") == 1))) == [(None,)]


def test_pct_keep_rounds_twice_like_the_decimal_form(spark):
    # 1 * 100 / 2.0000000200000002 ~ 49.99499... : once -> 49.99, via 5 digits -> 49.995 -> 50.00
    df = spark.createDataFrame([(49.994999, 100.0)], "a double, b double")
    out = rows(df.select(X.pct("a", "b"), X.pct("a", "b", keep=5)))
    assert out == [(49.99, 50.0)]
