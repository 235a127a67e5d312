import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortscope.llm import mixing
from cohortscope.llm.mixing import exact_places, mix_sources, whole_weights
from helpers import no_docs, odd_docs, shipped  # noqa: F401


def ideal(blocks, whole, t):
    """Blocks that every source has sent in the ideal stream after ``t`` slots, exactly."""
    left = sorted((s for s in blocks if blocks[s]), key=lambda s: Fraction(blocks[s], whole[s]))
    sent, rate, v = 0, sum(whole[s] for s in left), Fraction(0)
    for s in left:
        end = Fraction(blocks[s], whole[s])
        if sent + rate * end >= t:
            v = (Fraction(t) - sent) / rate
            break
        sent, rate = sent + blocks[s], rate - whole[s]
    return {s: min(Fraction(blocks[s]), whole[s] * v) for s in blocks}


def check_places(blocks, weights, slots=None):
    whole = whole_weights(weights)
    have, order = dict.fromkeys(blocks, 0), []
    for t, (s, block, slot, release, deadline, _) in enumerate(exact_places(blocks, weights)):
        if t == slots:
            break
        assert slot == t and block == have[s] and release <= t < deadline
        have[s] += 1
        order.append((s, block))
        if slots is None or t % 7 == 0:
            sent = ideal(blocks, whole, t + 1)
            assert all(abs(have[x] - sent[x]) < 1 for x in blocks)
    if slots is None:
        assert have == blocks
    return order


@pytest.mark.parametrize("seed", range(25))
def test_less_than_one_block_off_until_the_last_source_runs_out(seed):
    rnd = random.Random(seed)
    blocks = {f"s{k}": rnd.choice([0, 1, 2, 5, 17, 60, 200]) for k in range(rnd.randrange(1, 12))}
    check_places(blocks, {s: rnd.choice([1, 1, 2.5, 0.1, 1e-6, rnd.random() + 1e-3, b ** 0.7 + 1e-9]) for s, b in blocks.items()})


@pytest.mark.parametrize("weights", [
    {"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1e-6}, {"a": 0.7, "b": 0.2, "c": 0.1},
    {**{"hot": 0.5}, **{f"s{k}": 0.025 for k in range(20)}}, {"a": 3 ** 0.7, "b": 17 ** 0.7, "c": 2.0 ** -40},
])
def test_target_weights_hold_over_many_blocks(weights):
    """Against the asked weights, in windows of exactly those weights."""
    exact = {s: Fraction(w) / sum(Fraction(x) for x in weights.values()) for s, w in weights.items()}
    blocks = dict.fromkeys(weights, 10 ** 9)
    check_places(blocks, weights, 20_000)
    for t, (s, block, _, release, deadline, share) in enumerate(exact_places(blocks, weights)):
        if t == 20_000:
            break
        assert release == block / exact[s] // 1 and abs(share - float(exact[s])) < 1e-12
        assert deadline == min(-(-(block + 1) / exact[s] // 1), mixing.LAST)


def test_a_hundred_thousand_sources():
    """Work in proportion to blocks and sources: every source runs out at a time of its own."""
    blocks = {f"s{k}": k % 7 + 1 for k in range(100_000)}
    have, n = dict.fromkeys(blocks, 0), 0
    for t, (s, block, slot, release, deadline, _) in enumerate(exact_places(blocks, {s: b ** 0.7 for s, b in blocks.items()})):
        assert slot == t and block == have[s] and release <= t < deadline
        have[s] += 1
        n += 1
    assert have == blocks and n == sum(blocks.values())


def test_stream_against_brute_force(spark):
    docs = spark.range(400).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 5) END AS source"
    ).repartition(6)
    got = mix_sources(docs, {"hot": 0.5, None: 0.1}, block_rows=4).orderBy("position").collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    of = {}
    for r in got:
        of.setdefault(r.source, []).append(r.doc_id)
    assert all(ids == sorted(ids) for ids in of.values())
    key = {s: "" if s is None else f"={s}" for s in of}
    counts = {key[s]: len(ids) for s, ids in of.items()}
    natural = {s: n ** 0.7 for s, n in counts.items()}
    scale = 0.3 / (sum(natural.values()) / len(natural))
    weights = {s: {"=hot": 0.5, "": 0.1}.get(s, natural[s] * scale) for s in counts}
    order = check_places({s: -(-n // 4) for s, n in counts.items()}, weights)
    assert list(dict.fromkeys((key[r.source], r.block) for r in got)) == order
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = mix_sources(docs, carry=["text", "n"], block_rows=2).collect()
    assert len(got) == docs.count() and sum(r.source is None for r in got) == 3
    assert sorted(str(r.text)[:9] for r in got) == sorted(str(r.text)[:9] for r in docs.collect())
    assert mix_sources(no_docs(spark)).collect() == []


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        mix_sources(spark.range(3).selectExpr("id AS doc_id", "CAST(id AS STRING) AS source"), {"1": 0})


def test_many_sources_of_a_table(spark):
    """More sources than any list made by hand; a third of the rows are one source's."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('web', id % 2500)) AS source")
    got = mix_sources(docs, block_rows=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000)) and len({r.position for r in got}) == 6000
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_equal_and_null_ids_spread_by_the_order_columns(spark):
    docs = spark.range(8000).select(
        F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(None)).alias("doc_id"), F.lit("one").alias("source"),
        F.col("id").alias("row"))
    placed = mix_sources(docs, carry=["row"], order=["row"])
    got = placed.orderBy("position").collect()
    assert [r.position for r in got] == list(range(8000)) and {r.row for r in got} == set(range(8000))
    nulls = [r.row for r in got if r.doc_id is None]
    assert nulls == sorted(nulls) and len(nulls) == 6000


def test_equal_weights_of_a_long_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 1 << 10)  # the plan is written in several pieces
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    got = mix_sources(docs, {"s0": 1, "s1": 1, "s2": 1}, block_rows=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(9000)) and sorted(r.doc_id for r in got) == list(range(9000))
    for t in range(0, 9000, 3):
        assert sorted(r.source for r in got[t:t + 3]) == ["s0", "s1", "s2"]
