import datetime as dt

from pyspark.sql import functions as F

from cohortscope.operators import activity, topk
from cohortscope.plans.guards import physical_plan
from conftest import rows

T = dt.datetime

PAY = [
    (1, "A", T(2024, 1, 5)), (1, "A", T(2024, 1, 9)), (1, "B", T(2024, 2, 1)),
    (2, "A", T(2024, 2, 3)), (3, "C", T(2024, 2, 4)),
]


def pay(spark):
    return spark.createDataFrame(PAY, "user_id long, productId string, created_at timestamp_ntz")


def test_totals_and_ratio(spark):
    assert rows(activity.activity_totals(pay(spark))) == [(3, 5)]
    assert rows(activity.events_per_user(pay(spark))) == [(1.6667,)]


def test_monthly_and_histogram_and_items(spark):
    assert rows(activity.monthly_activity(pay(spark))) == [("2024-01", 2, 1), ("2024-02", 3, 3)]
    assert rows(activity.frequency_histogram(pay(spark))) == [(1, 2), (3, 1)]
    assert rows(activity.item_stats(pay(spark))) == [("A", 3, 2), ("B", 1, 1), ("C", 1, 1)]
    assert rows(activity.rank_users(pay(spark))) == [(1, 3), (2, 1), (3, 1)]


def test_weekly_intensity_counts_active_weeks_only(spark):
    votes = spark.createDataFrame(
        [(1, T(2024, 1, 1)), (1, T(2024, 1, 2)), (1, T(2024, 1, 15)), (2, T(2024, 12, 30)),
         (2, T(2025, 1, 1))],
        "user_id long, created_at timestamp_ntz",
    )
    # user 1: 3 votes / 2 weeks = 1.5; user 2: both in ISO week 2025-01 -> 2.0
    assert rows(activity.weekly_intensity(votes)) == [(1.75,)]


def test_joined_item_counts_semi_and_fanout(spark):
    facts = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "user_id long, question_piece_id long")
    cohort = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    assert rows(activity.joined_item_counts(facts, cohort, k=5)) == [(1, 2), (2, 1)]
    assert rows(activity.joined_item_counts(facts, cohort, k=5, fanout=True)) == [(1, 4), (2, 1)]


def _votes(spark):
    return spark.createDataFrame(
        [(1, 2.0), (1, 3.0), (2, 1.0), (2, 1.0), (3, 9.0), (4, 1.0)],
        "question_id long, opened_times double",
    )


def test_top_k_entities_tie_break_and_inner_join(spark):
    dim = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "id long, question_text string")
    out = topk.top_k_entities(_votes(spark), dim, k=2)
    assert rows(out) == [(1, "q1", 2), (2, "q2", 2)]
    assert "TakeOrderedAndProject" in physical_plan(out)


def test_top_k_measures(spark):
    dim = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "id long, question_text string")
    out = rows(topk.top_k_measures(_votes(spark), dim, k=2))
    assert out == [(3, "q3", 9.0, 9.0, 1), (1, "q1", 5.0, 2.5, 2)]


def test_top_k_with_periods_on_both_sides(spark):
    facts = spark.createDataFrame(
        [(1, T(2024, 1, 2)), (1, T(2024, 1, 3)), (2, T(2024, 1, 2)), (3, T(2023, 1, 1)), (3, T(2023, 1, 1))],
        "question_id long, created_at timestamp_ntz",
    )
    dim = spark.createDataFrame(
        [(1, "q1", T(2023, 6, 1)), (2, "q2", T(2024, 1, 1)), (3, "q3", T(2023, 6, 1))],
        "id long, question_text string, created_at timestamp_ntz",
    )
    from cohortscope.plans.period import Period
    out = topk.top_k_entities(
        facts, dim, k=5,
        facts_period=Period.half_open("2024-01-01", "2024-02-01"),
        dim_period=Period.between("2023-01-01", "2023-12-31"),
    )
    # q3's votes are outside the fact period; q2 is outside the question period
    assert rows(out) == [(1, "q1", 2)]


def test_top_measures_keep_values_beyond_the_decimal(spark):
    from cohortscope.operators.topk import top_k_measures

    facts = spark.createDataFrame(
        [(1, 1e21), (1, 2e21), (1, None), (2, 5.5), (2, 1.5), (3, float("inf")), (3, 1.0), (4, None)],
        "question_id long, opened_times double")
    dim = spark.createDataFrame([(k, f"q{k}") for k in (1, 2, 3, 4)], "id long, question_text string")
    got = [tuple(r) for r in top_k_measures(facts, dim).collect()]
    inf = float("inf")
    assert got == [(3, "q3", inf, inf, 2), (1, "q1", 3e21, 1.5e21, 3), (2, "q2", 7.0, 3.5, 2), (4, "q4", None, None, 1)]
