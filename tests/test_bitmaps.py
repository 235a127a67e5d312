"""Exact distinct counts by bitmaps."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortscope.operators import profile
from cohortscope.plans import catalog
from cohortscope.plans.guards import physical_plan
from conftest import SF_SMALL, rows

EDGES = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 2**31, -2**31, 2**63 - 1, -2**63, -2**63 + 1]


def table(spark, values, kind="long"):
    return spark.createDataFrame([(v, (v or 0) % 5 if v is not None else None) for v in values], f"a {kind}, b {kind}")


def test_edges_negatives_and_nulls(spark):
    values = EDGES + [None, 5, 5, None] + EDGES[:4]
    df = table(spark, values).repartition(5)
    cols = {"x": "a", "y": "b"}
    assert rows(profile.distinct_count(df, cols)) == rows(profile.distinct_count(df, cols, bitmaps=False)) \
        == [(len({*values} - {None}), 5)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1), st.integers(-70_000, 70_000)), max_size=60))
def test_any_longs(spark, values):
    assert rows(profile.distinct_count(table(spark, values), {"x": "a"}, bitmaps=True)) == [(len({*values} - {None}),)]


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int"])
def test_other_integer_types(spark, kind):
    assert rows(profile.distinct_count(table(spark, [1, -7, None, 1], kind), {"x": "a"}, bitmaps=True)) == [(2,)]


def test_texts_are_an_error(spark):
    with pytest.raises(TypeError):
        profile.distinct_count(table(spark, [1]).select(F.col("a").cast("string").alias("a")), {"x": "a"}, bitmaps=True)


def test_texts_are_counted_without(spark):
    df = table(spark, [1, 2, 2]).select("a", F.col("a").cast("string").alias("t"))
    assert rows(profile.distinct_count(df, {"x": "a", "y": "t"})) == [(2, 2)]


def test_empty_table_counts_zero(spark):
    assert rows(profile.distinct_count(table(spark, [1]).limit(0), {"x": "a", "y": "b"}, bitmaps=True)) == [(0, 0)]


def test_states_of_days_merge_to_the_whole(spark):
    rnd = random.Random(4)
    days = [[0 if k % 3 == 0 else rnd.randrange(-50_000, 50_000) for k in range(500)] for _ in range(4)]
    state = None
    for values in days:
        day = profile.distinct_bitmaps(table(spark, values), {"x": "a", "y": "b"})
        state = day if state is None else profile.merge_bitmaps(state.unionByName(day))
    whole = {v for d in days for v in d}
    assert rows(profile.count_bitmaps(state, ["x", "y"])) == [(len(whole), len({v % 5 for v in whole}))]


@pytest.mark.parametrize("name", ["distinct_users_and_groups", "distinct_group_schools"])
def test_queries_plan_no_expand(spark, name):
    plan = physical_plan(catalog.queries()[name](spark, SF_SMALL), "simple")
    assert "Expand" not in plan and "partial_bit_or" in plan and "SortAggregate" not in plan
