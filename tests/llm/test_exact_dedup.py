import hashlib
import re

from cohortscope.llm import common, exact_dedup
from helpers import no_docs, odd_docs, shipped  # noqa: F401


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(docs, got):
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows_against_brute_force(spark):
    docs = odd_docs(spark)
    check(docs, exact_dedup.exact_dedup(docs))


def test_hot_group_takes_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'a hot  text', concat('t', id % 40)) AS text").repartition(7)
    check(docs, exact_dedup.exact_dedup(docs))


def test_hot_group_without_ids_is_spread(spark, monkeypatch):
    """A third of the rows share a text and have no id, another third share a text and an id."""
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    docs = spark.range(600, numPartitions=9).selectExpr(
        "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE id END AS doc_id",
        "CASE id % 3 WHEN 0 THEN 'no  id here' WHEN 1 THEN 'one id' ELSE concat('t', id % 70) END AS text")
    check(docs, exact_dedup.exact_dedup(docs))
    rows = docs.select("doc_id", exact_dedup.normalised(docs.text).alias("norm")).selectExpr("xxhash64(norm) AS hash")
    hot = exact_dedup.hot_hashes(rows, 600).collect()
    assert sorted(r.salts for r in hot) == [7, 7]  # 200 rows each, 30 at most a salt


def test_texts_move_once(spark):
    from cohortscope.plans.guards import physical_plan

    docs = spark.range(100).selectExpr("id AS doc_id", "concat('t', id % 9) AS text")
    plan = physical_plan(exact_dedup.duplicate_groups(docs), "simple")
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert sum("rangepartitioning" in line for line in moved) == 1
    assert sum("hashpartitioning(text_sha256" in line for line in moved) == 1
    assert sum("hashpartitioning(hash" in line for line in moved) == 1 and len(moved) == 3


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(no_docs(spark)).collect() == []
