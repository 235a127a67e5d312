from collections import Counter

import numpy as np
import pytest

from cohortscope.llm.sharding import invert, locate, permute, row_at, shard_documents
from helpers import no_docs, odd_docs, shipped  # noqa: F401


@pytest.mark.parametrize("n", [1, 2, 3, 24, 100, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    y = permute(x, n, 7)
    assert sorted(y.tolist()) == x.tolist()
    assert invert(y, n, 7).tolist() == x.tolist()
    shard, slot = locate(x, n, 24, 7)
    assert row_at(shard, slot, n, 24, 7).tolist() == x.tolist()


def test_seeds_differ_and_order_is_mixed():
    a, b = permute(np.arange(5000), 5000, 1), permute(np.arange(5000), 5000, 2)
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(np.arange(5000), a.astype(float))[0, 1]) < 0.05


def test_rows_law(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "repeat('é', CAST(id % 5 AS INT)) AS text").repartition(9)
    got = shard_documents(docs, 24, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1003 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == 2 * (r.doc_id % 5) + 8 and r.row_number == r.doc_id for r in got)
    again = shard_documents(docs.repartition(3), 24, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_and_empty_tables(spark):
    got = shard_documents(odd_docs(spark), 3).collect()
    assert sorted(r.row_number for r in got) == list(range(11))
    assert got and [r.size for r in got if r.doc_id == 4] == [8]
    assert [r.row_number for r in got if r.doc_id is None] == [0]
    assert shard_documents(no_docs(spark), 3).collect() == []


def test_a_third_without_an_id_and_a_third_with_one_id(spark):
    docs = spark.range(3000).selectExpr(
        "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN -5 ELSE id END AS doc_id", "concat('t', id % 50) AS text").repartition(7)
    got = shard_documents(docs, 24, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 3000 and set(sizes.values()) == {125}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(125)) for s in sizes)
    assert Counter(r.doc_id for r in got)[None] == Counter(r.doc_id for r in got)[-5] == 1000
