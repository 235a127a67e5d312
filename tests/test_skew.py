"""A hot key holding a third of all rows: results stay exact (checked against a brute
force computation) and the per-user reductions are partially aggregated before the
shuffle."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cohortscope.operators import cohort, segments, skew, timing
from cohortscope.plans.guards import physical_plan
from conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    # 30,000 rows; user 0 holds every third row.
    return spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("user_id"),
        (F.col("id") % 11).cast("int").alias("delta_point"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(mins=F.col("id").cast("int")))
        .cast("timestamp_ntz").alias("created_at"),
    )


def test_hot_user_share(facts):
    n0 = facts.filter(F.col("user_id") == 0).count()
    assert n0 >= 10000


def test_per_member_activity_exact(spark, facts):
    pdf = facts.toPandas()
    members = spark.range(0, 1200, 2).select(F.col("id").alias("user_id"))
    got = rows(cohort.per_member_activity(members, facts, fact_user="user_id"))[0]
    counts = pdf.groupby("user_id").size()
    per = [int(counts.get(u, 0)) for u in range(0, 1200, 2)]
    assert got[0] == len(per) and got[2] == max(per) and got[3] == min(per)
    assert got[1] == pytest.approx(round(sum(per) / len(per), 2), abs=0.005)


def test_compare_segments_exact(spark, facts):
    pdf = facts.toPandas()
    members = spark.range(0, 500).select(F.col("id").alias("user_id"))
    got = {r[0]: r[1:4] for r in rows(segments.compare_segments(facts, members))}
    voted = pdf[pdf.user_id < 500]
    assert got["voted"] == (voted.user_id.nunique(), len(voted), int(voted.delta_point.sum()))


def test_first_event_exact_and_partial(spark, facts):
    pdf = facts.toPandas()
    got = dict(rows(timing.first_event(facts)))
    want = pdf.groupby("user_id").created_at.min()
    assert len(got) == len(want) and all(got[u] == want[u].to_pydatetime() for u in want.index[:50])
    plan = physical_plan(timing.first_event(facts))
    # partial aggregate below the shuffle: HashAggregate(partial_min) -> Exchange -> min
    assert "partial_min" in plan
    assert re.search(r"\+- Exchange \(\d+\)\n\s*\+- HashAggregate", plan)


def test_conversion_with_hot_key(spark, facts):
    base = spark.range(0, 2000).select(F.col("id").alias("user_id"))
    got = rows(cohort.conversion_rate(base, facts))[0]
    assert got[:2] == (2000, facts.select("user_id").distinct().count())


# --- skew is measured, not assumed -----------------------------------------------------


@pytest.fixture
def shuffled_joins(spark):
    """As at scale: no broadcast of members, no coalescing, 48 partitions."""
    want = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "48",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield 48
    for k, v in old.items():
        spark.conf.set(k, v)


def _links(spark, n=48_000):
    """Key 0 holds a third of all rows, key -1 a tenth; the others some five rows each."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 10 == 1, F.lit(-1)).otherwise(F.col("id") % 5003 + 1)
    return spark.range(n).select(key.cast("long").alias("user_id"), F.col("id").alias("item"))


def test_heavy_keys_and_their_salts(spark):
    links = _links(spark).unionByName(_links(spark).limit(100).select(F.lit(None).cast("long").alias("user_id"), "item"))
    counts = dict(rows(links.filter("user_id IS NOT NULL").groupBy("user_id").count()))
    total = sum(counts.values())
    for tasks in (12, 48, 200):
        got = dict(rows(skew.heavy_keys(links, "user_id", tasks)))
        for k, n in counts.items():
            share = n * tasks / total
            if share > 1.5:  # beyond the sketch's error
                assert abs(got[k] - share) <= max(2, 0.1 * share), (tasks, k)
        assert all(counts[k] * tasks / total > 0.5 for k in got) and len(got) <= tasks
        assert all(n >= 2 for n in got.values())


def test_only_heavy_members_are_copied(spark):
    links = _links(spark)
    heavy = skew.heavy_keys(links, "user_id", 48)
    members = spark.range(-1, 5004).select(F.col("id").alias("user_id"))
    copies = dict(rows(skew.salted(members, heavy, "user_id").groupBy("user_id").count()))
    salts = dict(rows(heavy))
    assert copies == {u: salts.get(u, 1) for u in range(-1, 5004)} and set(salts) == {0, -1}


def test_even_keys_take_no_salts(spark):
    even = spark.range(20_000).select((F.col("id") % 4000).alias("user_id"), F.col("id").alias("item"))
    assert rows(skew.heavy_keys(even, "user_id", 48)) == []
    empty = skew.heavy_keys(even.limit(0), "user_id", 48)
    assert rows(empty) == []


def test_hot_key_spreads_by_its_share(spark, shuffled_joins):
    """A key with a third of the rows takes about a third of the tasks, and no task over four
    times the median; unsalted, one task would hold a third of all rows."""
    links, n = _links(spark), 48_000
    members = spark.range(-1, 5004).select(F.col("id").alias("user_id"))
    out = skew.salted_semi_join(links, members, "user_id", "item")
    where = out.groupBy(F.spark_partition_id().alias("p"), (F.col("user_id") == 0).alias("hot")).count()
    held = {}
    for p, hot, c in rows(where):
        held.setdefault(p, {})[hot] = c
    sizes = sorted(sum(x.values()) for x in held.values())
    assert sum(sizes) == n
    assert sum(True in x for x in held.values()) >= 9  # 16 salts over 48 places
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2] < n / 10


def test_rates_and_overlap_with_measured_skew(spark, shuffled_joins):
    links = _links(spark, 9_000).withColumnRenamed("item", "question_piece_id")
    members = spark.range(0, 3000, 2).select(F.col("id").alias("user_id"))
    targets = spark.range(0, 9_000, 5).select(
        "id", (F.col("id") % 7).alias("question_id"), (F.col("id") % 2).cast("int").alias("is_skipped"))
    pairs = [(u, i) for u, i in rows(links.distinct()) if 0 <= u < 3000 and u % 2 == 0 and i % 5 == 0]
    got = rows(segments.flag_rate(links, members, targets))[0]
    assert got[:2] == (len(pairs), sum(i % 2 for _, i in pairs))
    users = {u for u, i in rows(links) if i % 5 == 0}
    linked = cohort.linked_members(links, targets, distinct=False)
    assert sorted(r[0] for r in rows(cohort.linked_members(links, targets))) == sorted(users)
    assert rows(cohort.cohort_overlap([(members, "user_id"), (linked, "user_id")])) == [
        (len({u for u in users if 0 <= u < 3000 and u % 2 == 0}),)]


# --- set intersection and first pairs ---------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 62, 63, 130])
def test_any_number_of_sets_in_one_shuffle(spark, k):
    """Set j leaves out the multiples of j + 2; rows repeat, NULL is no user."""
    base = spark.range(400).select(F.col("id").alias("u"))
    null = spark.range(1).select(F.lit(None).cast("long").alias("u"))
    sets = [(base.filter(F.col("u") % (j + 2) != 0).unionByName(base.limit(0)).unionByName(null), "u") for j in range(k)]
    sets[0] = (sets[0][0].unionByName(sets[0][0]), "u")
    want = sum(all(u % (j + 2) for j in range(k)) for u in range(400))
    assert rows(cohort.cohort_overlap(sets)) == [(want,)]
    plan = physical_plan(cohort.cohort_overlap(sets), "simple")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_no_set_is_an_error(spark):
    with pytest.raises(ValueError):
        cohort.cohort_overlap([])


def test_first_pair_of_raw_rows(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    starts = spark.createDataFrame(
        [(1, d(5)), (1, d(3)), (2, d(1)), (3, None), (None, d(2))], "user_id int, start_at timestamp_ntz")
    ends = spark.createDataFrame(
        [(1, d(9)), (1, d(4)), (3, d(8)), (4, d(1)), (None, d(7))], "user_id int, end_at timestamp_ntz")
    got = {r[0]: r[1:] for r in rows(timing.first_pair(starts, ends))}
    assert got == {1: (d(3), d(4)), 2: (d(1), None), 3: (None, d(8)), None: (d(2), None)}
    cut = timing.time_to_event(starts, ends, share=True, first_start=F.col("start_at") > F.lit(d(2)))
    assert rows(cut) == [(1, 100.0, 1.0, 1, 1)]
    plan = physical_plan(timing.time_to_event(starts, ends), "simple")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan
