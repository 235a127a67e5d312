import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortscope.llm import common, maxent_lm
from cohortscope.llm.catalog import op4_maxent_lm, table
from helpers import no_docs, odd_docs, shipped, spaced_words  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_counts_and_base_against_brute_force_and_gain_on_held_out(spark):
    got = {r.doc_id: r for r in op4_maxent_lm(spark, SF).collect()}
    texts = {r.doc_id: spaced_words(r.text) + [None] for r in table(spark, SF, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)
    assert np.mean([r.score > r.base_score for r in out]) > 0.8


def test_units_share_out_all_probability():
    rng = np.random.default_rng(2)
    classes = rng.normal(0, 3, (maxent_lm.CLASS_ROWS, 32)).astype(np.float32)
    members = rng.normal(0, 3, (maxent_lm.MEMBER_ROWS, 32)).astype(np.float32)
    last, before = np.array([maxent_lm.PAST, 5, 1000]), np.array([maxent_lm.PAST, 7, 3])
    total = np.zeros(3)
    for u in range(maxent_lm.UNITS):
        cls = np.full(3, u // 32)
        total += np.exp(maxent_lm._log_softmax_at(classes, maxent_lm._class_rows(last, before), cls)
                        + maxent_lm._log_softmax_at(members, maxent_lm._member_rows(last, before, cls), np.full(3, u % 32)))
    assert np.allclose(total, 1, atol=1e-4)


def test_tokens_of_a_bucket_share_out_its_probability(spark):
    """Known tokens of a bucket and the unseen one have shares that add up to one."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('w', id % 900, 'ab x', id % 700, 'cd') AS text")
    corpus = maxent_lm.count_corpus(docs, F.lit(False))
    share = Counter()
    for r in corpus.vocabulary.collect():
        if r.unit >= maxent_lm.OWN:
            share[r.unit - maxent_lm.OWN] += r.c + 1
    assert share and all(math.isclose(s + 1, corpus.bucket_mass[b]) for b, s in share.items())
    assert (corpus.tokens, corpus.types, corpus.ends) == (6000, 1601, 2000) and len(corpus.own) == maxent_lm.OWN - 1


def test_past_does_not_cross_texts():
    units, firsts = np.array([1, 2, 0, 0, 3, 0]), np.array([0, 3, 4, 6])
    last, before = maxent_lm._past(units, firsts)
    p = maxent_lm.PAST
    assert last.tolist() == [p, 1, 2, p, p, 3] and before.tolist() == [p, p, 1, p, p, p]


def test_buckets_by_ending():
    b = maxent_lm.bucket_of(pa.array(["running", "sing", "sing.", "x", "", "..."]))
    assert b[0] == b[1] and b.max() < maxent_lm.BUCKETS
    assert len(maxent_lm.bucket_of(pa.array([], pa.string()))) == 0


def test_learning_lowers_the_loss():
    units = np.arange(20_000) % 3 * 100  # each unit is told by the last one
    last, before = maxent_lm._past(units, np.array([0, len(units)]))
    learner = maxent_lm._Learner(np.zeros((maxent_lm.CLASS_ROWS, 32), np.float32), np.zeros((maxent_lm.MEMBER_ROWS, 32), np.float32))
    for a in range(0, len(units), 1000):
        learner.learn(units[a:a + 1000], last[a:a + 1000], before[a:a + 1000])
    cls = units // 32
    loss = -maxent_lm._log_softmax_at(learner.weights[0], maxent_lm._class_rows(last, before), cls)
    assert loss[-1000:].mean() < 0.2


def test_odd_and_empty_tables(spark):
    got = maxent_lm.score_documents(odd_docs(spark), common.fold_is(F.col("doc_id"), 7, 2)).collect()
    assert len(got) == 11 and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    none = maxent_lm.score_documents(odd_docs(spark), F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}
    assert all(r.base_score == 0 for r in none) and all(np.isfinite(r.score) for r in none)
    assert maxent_lm.score_documents(no_docs(spark), F.lit(False)).collect() == []


def test_score_against_a_slow_model(spark):
    """Every factor of every token's probability, token by token in plain Python."""
    texts = ["the cat sat on the mat. the end", "a dog, a cat and the mat", "", "unseen wordings only", "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus = maxent_lm.count_corpus(docs, F.col("doc_id") == 3)
    weights = maxent_lm.train_weights(corpus)
    got = {r.doc_id: r.score for r in maxent_lm.score_corpus(corpus, weights).collect()}
    counts = Counter(w for k, t in enumerate(texts) if k != 3 for w in t.split())

    def unit(word):
        return corpus.own.get(word) or maxent_lm.OWN + int(maxent_lm.bucket_of(pa.array([word]))[0])

    def log_softmax(table, rows, target):
        sums = [min(60.0, max(-60.0, sum(float(table[int(r[0])][c]) for r in rows))) for c in range(32)]
        return sums[target] - math.log(sum(math.exp(x) for x in sums))

    for k, text in enumerate(texts):
        total, last, before = 0.0, maxent_lm.PAST, maxent_lm.PAST
        for word in [*text.split(), None]:
            u = 0 if word is None else unit(word)
            x, y, cls = np.array([last]), np.array([before]), np.array([u // 32])
            total += log_softmax(weights.classes, maxent_lm._class_rows(x, y), u // 32) / math.log(10)
            total += log_softmax(weights.members, maxent_lm._member_rows(x, y, cls), u % 32) / math.log(10)
            if u >= maxent_lm.OWN:
                total += math.log10((counts[word] + 1) / corpus.bucket_mass[u - maxent_lm.OWN])
            last, before = u, last
        assert abs(got[k] - total) < 1e-4 * max(1, abs(total)), (text, got[k], total)


def test_trainers_grow_with_the_corpus():
    """A trainer's share of text is bounded, so more text trains on more tasks."""
    assert [maxent_lm.trainers_for(n) for n in (0, 1, 4096, 4097, 1_000_000)] == [256, 256, 256, 257, 62_500]
