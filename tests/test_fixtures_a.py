"""FIXTURES.md part A: hand-made logical tables with the listed edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortscope.operators import activity, cohort, profile, segments, timing, topk
from cohortscope.plans.period import Period
from conftest import rows

T = dt.datetime
P = Period.between("2024-01-01", "2024-01-31")  # closed: 01-31 00:00:00 is the last instant


@pytest.fixture(scope="module")
def vote(spark):
    return spark.createDataFrame(
        [
            (1, 10, 100, 3, "C", T(2024, 1, 2, 9)),
            (1, 10, 101, 1, "C", T(2024, 1, 3, 9)),
            (1, 11, 102, 0, None, T(2024, 1, 31, 0, 0, 0)),   # midnight of the last day: in
            (2, 11, 103, 5, "S", T(2024, 1, 31, 0, 0, 1)),    # one second later: out
            (3, 12, 104, 2, "C", T(2023, 12, 31, 23)),        # ISO week 2023-52 ...
            (3, 12, 105, 2, "C", T(2024, 1, 1, 1)),           # ... and 2024-01
        ],
        "user_id long, question_id long, question_piece_id long, opened_times int, "
        "status string, created_at timestamp_ntz",
    )


@pytest.fixture(scope="module")
def payment(spark):
    return spark.createDataFrame(
        [
            (1, "gem", T(2024, 1, 5)), (1, "gem", T(2024, 1, 6)),
            (3, "pass", T(2023, 12, 1)),          # payment before the first vote
            (9, "gem", T(2024, 1, 10)),           # payer who never voted
        ],
        "user_id long, productId string, created_at timestamp_ntz",
    )


def test_closed_period_counts_midnight_only(vote):
    got = rows(profile.distinct_count(vote, {"voters": "user_id"}, P))
    assert got == [(2,)]  # users 1 and 3 (user 3 via 2024-01-01); user 2's vote is 1 s late


def test_null_status_group_counts_zero(vote):
    got = dict(rows(profile.value_counts(vote, "status", count_col="status")))
    assert got == {None: 0, "C": 4, "S": 1}


def test_vote_to_payment_drops_payment_before_first_vote(vote, payment):
    starts = timing.first_event(vote)
    ends = timing.first_event(payment, name="end_at")
    got = rows(timing.time_to_event(starts, ends, unit="elapsed", strict=True, avg_digits=None))
    # user 1: 01-02 09:00 -> 01-05 00:00 = 2 whole days; user 3 paid before voting; 9 never voted
    assert got == [(1, 2.0, 2, 2)]


def test_payer_conversion_and_item_conversion(vote, payment):
    assert rows(cohort.conversion_rate(payment, vote)) == [(3, 2, 66.67)]
    got = sorted(rows(segments.item_conversion(payment, vote, keep=5)))
    assert got == [("gem", 2, 1, 50.0), ("pass", 1, 1, 100.0)]


def test_weekly_intensity_across_new_year(vote):
    # user 1: 3 votes in 2 ISO weeks (2024-01, 2024-05) = 1.5; user 2: 1; user 3: 2 weeks -> 1
    assert rows(activity.weekly_intensity(vote)) == [(1.17,)]


def test_top_k_with_two_ids_sharing_a_text(spark, vote):
    question = spark.createDataFrame(
        [(10, "same text"), (11, "same text"), (12, "other")], "id long, question_text string"
    )
    got = rows(topk.top_k_entities(vote, question, k=3))
    # ties (2 votes each) broken by key; the shared text stays two rows
    assert got == [(10, "same text", 2), (11, "same text", 2), (12, "other", 2)]


def test_point_history_signs(spark):
    ph = spark.createDataFrame([(1, 5), (1, -3), (2, 0), (2, 5)], "user_id long, delta_point int")
    assert rows(profile.value_counts(ph, "delta_point")) == [(-3, 1), (0, 1), (5, 2)]
    assert rows(profile.value_counts(ph, "delta_point", where=F.col("delta_point") > 0)) == [(5, 2)]


def test_session_property_id_stored_as_text(spark):
    props = spark.createDataFrame([("1527451", "a"), ("15274510", "b")], "user_id string, k string")
    assert rows(profile.lookup(props, "user_id", 1527451)) == [("1527451", "a")]


def test_candidates_repeated_pair_and_non_voter(spark, vote):
    cand = spark.createDataFrame(
        [(1, 100), (1, 100), (2, 103), (7, 104)], "user_id long, question_piece_id long"
    )
    pieces = spark.createDataFrame(
        [(100, 10, 1), (103, 11, 0), (104, 12, 1)], "id long, question_id long, is_skipped int"
    )
    # member pairs: (1,100) once after dedupe, (2,103); user 7 never voted
    assert rows(segments.flag_rate(cand, vote, pieces)) == [(2, 1, 50.0)]
    assert rows(activity.joined_item_counts(cand, vote, k=5)) == [(1, 2), (2, 1)]
