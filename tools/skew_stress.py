"""Stress check of the hot-key design on generated rows with one key holding a third of them.

Usage: python tools/skew_stress.py [rows]   (default 30,000,000)
Runs the skew-sensitive operators with broadcast joins off and 64 shuffle partitions, and
prints for each the wall time and, from Spark's event log (written to a scratch folder), the
longest task against the median task of its slowest stage. The data is generated in Spark,
never collected; this is a tool, not a registered query.
"""

import datetime as dt
import glob
import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from cohortscope.operators import cohort, eligibility, profile, retention, segments, timing  # noqa: E402
from cohortscope.session import build_session  # noqa: E402

N = int(sys.argv[1]) if len(sys.argv) > 1 else 30_000_000
LOG = tempfile.mkdtemp(prefix="run-events-")
spark = build_session("local[8]", shuffle_partitions=64, extra={
    "spark.driver.memory": "12g", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{LOG}",
    "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})


def hot(column, other):
    """``column``: 0 on every third row, else ``other``."""
    return F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(other).alias(column)


day = F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(secs=(F.col("id") % 2_000_000).cast("int"))
facts = spark.range(N).select(
    hot("user_id", F.col("id") % (N // 6)), (F.col("id") % 11).cast("int").alias("delta_point"),
    day.cast("timestamp_ntz").alias("created_at"))
members = spark.range(0, N // 6, 2).select(F.col("id").alias("user_id"))
# Links with a hot user, and links with a hot piece.
by_user = spark.range(N).select(hot("user_id", F.col("id") % (N // 6)), (F.col("id") % (N // 9)).alias("question_piece_id"))
by_piece = spark.range(N).select((F.col("id") % (N // 6)).alias("user_id"), hot("question_piece_id", F.col("id") % (N // 9)))
pieces = spark.range(N // 9).select("id", (F.col("id") % 1000).alias("question_id"), (F.col("id") % 3 == 0).cast("int").alias("is_skipped"))
users = spark.range(N).select("id", hot("group_id", F.col("id") % (N // 30)))
groups = spark.range(N // 30).select("id", (F.col("id") % 500).alias("school_id"))
schools = spark.range(500).select("id", (F.col("id") % 80).cast("int").alias("student_count"))

RUNS = {
    "per_member_activity": lambda: cohort.per_member_activity(members, facts, fact_user="user_id"),
    "conversion_rate": lambda: cohort.conversion_rate(members, facts),
    "compare_segments": lambda: segments.compare_segments(facts, members),
    "time_to_event": lambda: timing.time_to_event(
        timing.event_times(facts), timing.event_times(facts, where=F.col("delta_point") > 5, name="end_at")),
    "R1 over visit rows, hot user": lambda: retention.retention_by_first_revisit(
        retention.start_days(facts.filter("delta_point = 3")), facts, visit_ts="created_at"),
    "P6 distinct users": lambda: profile.distinct_count(facts, {"users": "user_id"}),
    "S6 flag_rate, hot user": lambda: segments.flag_rate(by_user, members, pieces),
    "S6 flag_rate, hot piece": lambda: segments.flag_rate(by_piece, members, pieces),
    "C5 overlap, hot link key": lambda: cohort.cohort_overlap(
        [(members, "user_id"), (cohort.linked_members(by_piece, pieces, distinct=False), "user_id")]),
    "E3 population, hot class": lambda: eligibility.eligible_population(users, groups, schools),
    "E4 conversion, hot class": lambda: eligibility.eligible_conversion(users, groups, schools, members),
}
spans = {}
for name, make in RUNS.items():
    start = time.time()
    result = make().collect()
    spans[name] = (start, time.time(), result[:1])
spark.stop()

tasks = defaultdict(lambda: defaultdict(list))
for path in glob.glob(f"{LOG}/*"):
    for line in open(path, errors="replace"):
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            at = event["Task Info"]["Launch Time"] / 1000
            for name, (a, b, _) in spans.items():
                if a <= at <= b:
                    tasks[name][event["Stage ID"]].append(event["Task Metrics"]["Executor Run Time"] / 1000)
for name, (a, b, result) in spans.items():
    worst = max((s for s in tasks[name].values() if len(s) >= 8), key=max)
    print(f"{name:26s} {b - a:6.1f} s; longest task {max(worst):.2f} s, median {statistics.median(worst):.2f} s {result}")
