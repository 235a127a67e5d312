"""A NULL user id is never a user, but its rows stay where the definition keeps them."""

import pytest

from cohortscope.functions.exprs import days_between, dround, list_length, safe_timestamp
from cohortscope.operators import cohort, lists, profile, retention, segments, topk
from conftest import rows


def ids(spark, values, name="user_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_two_way_participation(spark):
    edges = spark.createDataFrame([(1, 9)], "send_user_id long, receive_user_id long")
    out = rows(cohort.two_way_participation(ids(spark, [1, 2, None]), edges))
    assert out == [(2, 1, 0, "50.00%", "0.00%")]


def test_per_member_activity(spark):
    facts = spark.createDataFrame([(1,), (1,), (1,)], "send_user_id long")
    # The mean runs over the NULL member's row too: 3 facts over 3 rows.
    assert rows(cohort.per_member_activity(ids(spark, [1, 2, None]), facts)) == [(2, 1.0, 3, 0)]


def test_participation_and_intensity(spark):
    out = rows(cohort.participation_and_intensity(ids(spark, [1, 2, None]), ids(spark, [1, 1])))
    assert out == [(2, 1, 50.0, 2.0)]


def test_compare_segments(spark):
    facts = spark.createDataFrame([(1, 5), (2, 5), (None, 7)], "user_id long, delta_point int")
    out = {r[0]: r[1:] for r in rows(segments.compare_segments(facts, ids(spark, [1])))}
    assert out["not_voted"] == (1, 2, 12, 2.0, 12.0)


def test_any_visit(spark):
    import datetime as dt

    starts = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1))], "user_id long, start_date date")
    visits = spark.createDataFrame([(1, '["2024-01-03"]')], "user_id long, attendance_date_list string")
    out = rows(retention.retention_by_any_visit(starts, visits, ((1, 7, "d7"),)))
    assert out == [(1, 1, 100.0)]


def test_item_with_unknown_users_only(spark):
    pay = spark.createDataFrame([("a", 1), ("b", None)], "productId string, user_id long")
    out = sorted(rows(segments.item_conversion(pay, ids(spark, [1]))))
    assert out == [("a", 1, 1, 100.0), ("b", 0, 0, None)]


def test_sum_does_not_depend_on_order(spark):
    facts = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 1e15), (1, -1e15)], "question_id long, opened_times double")
    dim = spark.createDataFrame([(1, "q")], "id long, question_text string")
    assert rows(topk.top_k_measures(facts, dim)) == [(1, "q", 0.3, 0.075, 4)]


def test_rounding_of_huge_values_does_not_fail(spark):
    df = spark.createDataFrame([(1e29,), (1.005,)], "x double")
    assert rows(df.select(dround("x", 2)))[0][0] == 1e29


def test_escaped_lists_have_a_length(spark):
    df = spark.createDataFrame([('[\\"1\\"]',), ("[]",), ("{",), (None,)], "l string")
    assert [r[0] for r in rows(df.select(list_length("l")))] == [1, 0, None, None]
    assert rows(profile.malformed_list_count(df, "l")) == [(1,)]


def test_lists_of_instants(spark):
    df = spark.createDataFrame(
        [(1, '["2024-1-3 10:00:00", "2024-01-02", "bad"]'), (2, "[]")], "user_id long, attendance_date_list string")
    got = rows(lists.first_timestamp_by_key(df))
    assert len(got) == 1 and str(got[0][1]) == "2024-01-02 00:00:00"
    one = spark.createDataFrame([("2024-1-3 9:30:00", "2024-01-03 12:00:00")], "a string, b string")
    assert rows(one.select(days_between(safe_timestamp("a"), safe_timestamp("b"), "hours"))) == [(2,)]


def test_preview_needs_a_size_and_browse_reads_all(spark):
    df = spark.range(50)
    with pytest.raises(TypeError):
        profile.preview(df)
    assert profile.browse(df).count() == 50
