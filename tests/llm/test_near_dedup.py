import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.llm import common, near_dedup
from helpers import no_docs, odd_docs, shipped, spaced_words  # noqa: F401


def shingles(text, width):
    w = spaced_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = sets.get(i, frozenset()) | shingles(t, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed):
    """Base texts with copies at all distances around the threshold, and loners."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    out = []
    for size in (40, 12, 6, 3, 2, 1, 1, 1):
        base = [word() for _ in range(rnd.randint(60, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += ["", "one two", "One  TWO", None, out[0], out[0].upper(), "x"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_families_against_brute_force(spark, seed, width, percent):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [1, 4])
def test_hot_buckets_and_hubs_take_the_way_apart(spark, monkeypatch, seed):
    """With a bound of two rows nearly every bucket, hub and class is hot."""
    monkeypatch.setattr(common, "HOT_SHARE", 2)
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_a_bucket_with_a_third_of_all_sets_is_spread(spark):
    """The members of the hot bucket meet its hub in many tasks, none with over four times the
    median; joined by the key alone they would be in one."""
    want = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        members = spark.range(30_000).selectExpr("IF(id % 3 = 0, -1, id DIV 4) AS key", "id AS doc")
        shared = near_dedup.shared_buckets(members)
        assert shared.filter("key = -1").count() == 10_000 and shared.filter("n < 2").count() == 0
        hubs = shared.groupBy("key").agg(F.min("doc").alias("hub"), F.max("n").alias("n"))
        met = common.join_hot(shared.select("key", "doc"), hubs, "key", "n", 30_000).filter("hub IS NOT NULL")
        placed = met.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key") == -1).alias("hot")).collect()
        sizes = sorted(r.rows for r in placed)
        assert len(sizes) == 24 and all(r.hot for r in placed) and sizes[-1] <= 4 * sizes[12]
        edges = near_dedup.star_edges(shared)
        assert edges.groupBy("hub").count().agg(F.max("count")).first()[0] >= 9_999
        labels = near_dedup.components(edges)
        assert labels.filter("component = 0").count() >= 10_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_cells_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_SHINGLES", 500)
    rows = families(4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_densified_bins_agree_as_often_as_sets_overlap():
    rnd = np.random.default_rng(3)
    for size, shared in ((5, 4), (40, 30), (600, 500)):
        hits, n = 0, 0
        for _ in range(60):
            common = rnd.integers(0, 2**63, shared).astype(np.uint64) * np.uint64(2)
            a, b = (np.unique(np.concatenate([common, rnd.integers(0, 2**63, size - shared).astype(np.uint64) * np.uint64(2)]))
                    for _ in range(2))
            hits += (near_dedup.signature(a) == near_dedup.signature(b)).sum()
            n += near_dedup.BINS
        assert abs(hits / n - shared / (2 * size - shared)) < 0.06


def test_band_width_follows_the_threshold():
    assert near_dedup.band_width(85) == 8 and near_dedup.band_width(80) == 6
    for p in (50, 70, 80, 85, 95):
        r = near_dedup.band_width(p)
        assert (1 - (p / 100) ** r) ** (near_dedup.BINS // r) < near_dedup.MISS


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.doc: r.component for r in near_dedup.components(spark.createDataFrame(edges, "hub long, doc long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


def test_stars_bound_the_pairs(spark):
    members = spark.range(500).selectExpr("1L AS key", "id AS doc").union(spark.range(3).selectExpr("id + 5 AS key", "id AS doc"))
    assert near_dedup.star_edges(near_dedup.shared_buckets(members)).count() == 499


def test_odd_and_empty_tables(spark):
    got = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 11
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0] and by_id[3].kept and by_id[4].kept
    assert by_id[2].component_id == 1 and by_id[None].component_id == 7 and not by_id[None].kept
    assert near_dedup.near_duplicates(no_docs(spark)).collect() == []
