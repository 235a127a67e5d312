import datetime as dt

from pyspark.sql import functions as F

from cohortscope.operators import cohort, segments
from conftest import rows

T = dt.datetime


def ids(spark, values, name="user_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_conversion_rate_forms(spark):
    base = ids(spark, [1, 2, 3, 4, 4, None])
    target = ids(spark, [2, 2, 4, 9])
    assert rows(cohort.conversion_rate(base, target)) == [(4, 2, 50.0)]
    assert rows(cohort.conversion_rate(base, target, rate="ratio")) == [(4, 2, 0.5)]
    assert rows(cohort.conversion_rate(base, target, rate="text")) == [(4, 2, "50.00%")]
    assert rows(cohort.conversion_rate(base, target, rate_name=None)) == [(4, 2)]
    empty = base.filter(F.lit(False))
    assert rows(cohort.conversion_rate(empty, target)) == [(0, 0, None)]


def test_two_way_participation(spark):
    members = ids(spark, [1, 2, 3])
    edges = spark.createDataFrame(
        [(1, 2, T(2024, 1, 1)), (1, 3, T(2024, 1, 2)), (5, 1, T(2024, 1, 3)), (2, 7, T(2025, 1, 1))],
        "send_user_id long, receive_user_id long, created_at timestamp_ntz",
    )
    from cohortscope.plans.period import Period
    out = cohort.two_way_participation(members, edges, edge_period=Period.half_open("2024-01-01", "2024-02-01"))
    assert rows(out) == [(3, 1, 3, "33.33%", "100.00%")]


def test_per_member_activity_counts_zero(spark):
    members = ids(spark, [1, 2, 3])
    facts = spark.createDataFrame([(1,), (1,), (1,), (2,), (9,)], "send_user_id long")
    assert rows(cohort.per_member_activity(members, facts)) == [(3, 1.33, 3, 0)]


def test_overlap_participation_range(spark):
    a, b = ids(spark, [1, 2, 3, 3]), ids(spark, [3, 2, 8])
    assert rows(cohort.cohort_overlap([(a, "user_id"), (b, "user_id")])) == [(2,)]
    facts = spark.createDataFrame([(1,), (1,), (3,)], "user_id long")
    assert rows(cohort.participation_and_intensity(ids(spark, [1, 2]), facts)) == [(2, 1, 50.0, 2.0)]
    users = spark.createDataFrame(
        [(1, T(2023, 1, 1)), (2, T(2023, 6, 1)), (3, T(2024, 1, 1))], "id long, created_at timestamp_ntz"
    )
    assert rows(cohort.overlap_range(users, facts)) == [(T(2023, 1, 1), T(2024, 1, 1))]


def _users(spark):
    return spark.createDataFrame(
        [(1, "N"), (2, "N"), (3, "Y"), (4, "Y"), (5, None)], "id long, ban_status string"
    )


def _votes(spark):
    return spark.createDataFrame(
        [(1, "C"), (1, "C"), (1, "X"), (3, "X"), (5, None)], "user_id long, status string"
    )


def test_segment_members_nonmembers_complement(spark):
    act = dict(rows(segments.segment_members(_users(spark), _votes(spark))))
    non = dict(rows(segments.segment_non_members(_users(spark), _votes(spark))))
    assert act == {"N": 1, "Y": 1, None: 1}
    assert non == {"N": 1, "Y": 1}
    assert sum(act.values()) + sum(non.values()) == 5


def test_segment_completion_counts_votes(spark):
    out = rows(segments.segment_completion(_votes(spark), _users(spark)))
    assert out == [("N", 3, 2, 66.67), (None, 1, 0, 0.0), ("Y", 1, 0, 0.0)]


def test_compare_segments(spark):
    facts = spark.createDataFrame([(1, 5), (1, 7), (2, 3), (3, -1)], "user_id long, delta_point int")
    members = ids(spark, [1, 9])
    out = {r[0]: r[1:] for r in rows(segments.compare_segments(facts, members, where=F.col("delta_point") > 0))}
    assert out == {"voted": (1, 2, 12, 2.0, 12.0), "not_voted": (1, 1, 3, 1.0, 3.0)}


def test_item_conversion(spark):
    pay = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 3)], "productId string, user_id long")
    out = sorted(rows(segments.item_conversion(pay, ids(spark, [1, 1, 3]))))
    assert out == [("A", 2, 1, 50.0), ("B", 1, 1, 100.0)]


def test_flag_rate_weights_pairs(spark):
    links = spark.createDataFrame(
        [(1, 10), (1, 10), (1, 11), (2, 11), (3, 12)], "user_id long, question_piece_id long"
    )
    members = ids(spark, [1, 2])
    pieces = spark.createDataFrame(
        [(10, 100, 1), (11, 101, 0), (12, 102, 1)], "id long, question_id long, is_skipped int"
    )
    # member pairs: (1,10), (1,11), (2,11) -> 3 rows, one flagged
    assert rows(segments.flag_rate(links, members, pieces)) == [(3, 1, 33.33)]


def test_flag_rate_on_nothing_linked(spark):
    links = spark.createDataFrame([(7, 10)], "user_id long, question_piece_id long")
    pieces = spark.createDataFrame([(10, 100, 1)], "id long, question_id long, is_skipped int")
    assert rows(segments.flag_rate(links, ids(spark, [1]), pieces)) == [(0, None, None)]
    assert rows(segments.flag_split(links, ids(spark, [1]), pieces)) == [(None, None)]
