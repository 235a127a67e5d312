"""Bucketing by user removes the per-user shuffles from an operator's plan."""

import re
import tempfile

from cohortscope.operators import cohort
from cohortscope.plans.guards import physical_plan
from cohortscope.sources.bindings import Bindings
from cohortscope.sources.layout import read_table, write_bucketed
from conftest import SF_SMALL, rows


def _exchanges(df):
    return len(re.findall(r"\(\d+\) Exchange", physical_plan(df)))


def test_bucketed_inputs_need_fewer_shuffles(spark):
    b = Bindings(spark, SF_SMALL)
    scratch = tempfile.mkdtemp(prefix="cohortscope-layout-", dir="/tmp")
    votes = b.votes().select("user_id", "status", "created_at")
    requests = b.friend_requests().select("send_user_id", "created_at")
    write_bucketed(votes, "votes_by_user", "user_id", 8, f"{scratch}/votes")
    write_bucketed(requests, "requests_by_user", "send_user_id", 8, f"{scratch}/requests")

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the shuffle joins
    try:
        plain = cohort.per_member_activity(cohort.cohort(votes), requests)
        bucketed = cohort.per_member_activity(
            cohort.cohort(read_table(spark, "votes_by_user")), read_table(spark, "requests_by_user")
        )
        # planned shapes (before execution): plain shuffles votes by user, requests by
        # user and the final row; bucketed scans are already partitioned by user
        n_plain, n_bucketed = _exchanges(plain), _exchanges(bucketed)
        assert n_bucketed == 1 and n_bucketed < n_plain
        assert rows(plain) == rows(bucketed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS votes_by_user")
        spark.sql("DROP TABLE IF EXISTS requests_by_user")
