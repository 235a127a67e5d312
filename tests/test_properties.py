
import pytest
from pyspark.sql import functions as F

from cohortscope.operators import activity, cohort, lists, retention, segments
from cohortscope.plans.period import Period
from cohortscope.sources.bindings import Bindings
from conftest import SF_CHECK


@pytest.fixture(scope="module")
def b(spark):
    return Bindings(spark, SF_CHECK)


def one(df):
    return df.collect()[0].asDict()


def test_first_and_any_revisit_agree_on_bands_from_day_one(b):
    starts = retention.start_days(b.first_actions())
    r2 = one(retention.retention_by_first_revisit(starts, b.attendance(), retention.CUMULATIVE_BANDS))
    r3 = one(retention.retention_by_any_visit(starts, b.attendance(), retention.ANY_VISIT_BANDS))
    for k in ("total_voted_users", "revisit_d7", "revisit_d14", "revisit_d30"):
        assert r2[k] == r3[k]


def test_interval_bands_partition_the_base(b):
    p = Period.half_open("1996-01-01", "2000-01-01")
    starts = retention.start_days(b.first_actions(), period=p)
    r1 = one(retention.retention_by_first_revisit(starts, b.attendance(), retention.INTERVAL_BANDS))
    r2 = one(retention.retention_by_first_revisit(starts, b.attendance(), retention.CUMULATIVE_BANDS))
    assert r1["revisit_d7"] + r1["revisit_d14"] + r1["revisit_d30"] == r2["revisit_d30"]
    never = one(retention.first_revisit(starts, b.attendance())
                .agg(F.count_if(F.col("first_revisit_date").isNull()).alias("n")))["n"]
    bands = sum(r1[k] for k in ("revisit_d7", "revisit_d14", "revisit_d30", "revisit_d30_plus"))
    assert bands + never == r1["total_voted_users"]
    assert (r1["total_voted_users"], r1["revisit_d7"], r1["revisit_d14"], r1["revisit_d30"],
            r1["revisit_d30_plus"], r1["revisit_d7_rate"]) == (1293, 41, 39, 75, 1126, 3.17)


def test_per_member_stats_are_ordered(b):
    members = cohort.cohort(b.votes().filter(F.col("status") == "purchase"))
    r = one(cohort.per_member_activity(members, b.friend_requests()))
    assert r["max_send_cnt"] >= r["avg_send_cnt"] >= r["min_send_cnt"]


def test_segment_members_and_non_members_cover_users(b):
    act = segments.segment_members(b.users(), b.first_actions())
    non = segments.segment_non_members(b.users(), b.first_actions())
    total = one(act.agg(F.sum("ban_cnt").alias("n")))["n"] + one(non.agg(F.sum("user_cnt").alias("n")))["n"]
    assert total == b.users().count()


def test_histogram_and_monthly_sums(b):
    pay = b.payments()
    tot = one(activity.activity_totals(pay))
    assert one(activity.frequency_histogram(pay).agg(F.sum("user_cnt").alias("n")))["n"] == tot["paying_users"]
    assert one(activity.monthly_activity(pay).agg(F.sum("payment_cnt").alias("n")))["n"] == tot["total_payments"]


def test_semi_join_and_distinct_join_forms_agree(b):
    members = cohort.cohort(b.votes().filter(F.col("status") == "purchase"),
                            period=Period.half_open("2024-01-01", "2024-01-03"))
    users = b.users(with_lists=True)
    semi = one(lists.list_length_stats(users, members))
    joined = (users.join(members.withColumnRenamed("user_id", "id"), "id")
              .select("id", F.json_array_length("friend_id_list").alias("n")).distinct()
              .agg(F.max("n").alias("mx"), F.min("n").alias("mn"), F.avg("n").alias("avg")))
    j = one(joined)
    assert (semi["max_friend_count"], semi["min_friend_count"]) == (j["mx"], j["mn"])
    assert j["mx"] > j["mn"] and semi["avg_friend_count"] == pytest.approx(j["avg"], abs=1e-4)
