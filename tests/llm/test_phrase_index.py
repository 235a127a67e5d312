import random

import pytest

from cohortscope.llm import phrase_index
from helpers import no_docs, odd_docs, plain_words, shipped  # noqa: F401


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(5)
    words = lambda n: [rnd.choice("the a of cat dog été naïve x1 run far".split()) for _ in range(n)]
    items = [(k, " ".join(words(rnd.choice([0, 1, 2, 5, 9])))) for k in range(6)] + [(k, " ".join(words(25))) for k in range(6, 12)]
    items += [(12, None), (13, "!!"), (6, items[6][1]), (14, items[7][1].upper())]
    docs = []
    for i in range(60):
        w = words(rnd.randint(0, 40))
        if i % 4 == 0:
            p = items[rnd.randrange(6, 12)][1].split()
            a = rnd.randrange(0, 12)
            w[5:5] = p[a:a + rnd.randint(5, 14)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(60, None), (61, ""), (62, docs[0][1]), (0, docs[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in phrase_index.contamination(d, b).collect()]
    assert sorted(got) == sorted(brute(docs, items, 10))


def test_no_match_across_documents_or_beyond_their_end(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "beta gamma"), (2, "gamma delta")], "item_id long, text string")
    for slop in (0, 3):
        got = {r.doc_id: r["items"] for r in phrase_index.contamination(docs, items, slop=slop).collect()}
        assert got == {1: [], 2: ["2"]}


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "red big fast car"), (2, "red car"), (3, "car x x x x red"), (4, "car red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red car")], "item_id long, text string")
    near = lambda s: {r.doc_id for r in phrase_index.contamination(docs, items, slop=s).collect() if r.n_hit}
    assert near(0) == {2} and near(2) == {1, 2, 4} and near(6) == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        near(64)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "a b c d a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "b c")], "item_id long, text string")
    r = phrase_index.contamination(docs, items).first()
    assert [(s.start, s.end) for s in r.spans] == [(0, 3), (4, 6)] and r.n_hit == 5


def test_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "der hund ist im haus"), (None, "one")], "item_id long, text string")
    got = phrase_index.contamination(odd_docs(spark), items).collect()
    assert len(got) == 11 and sorted(str(r.doc_id) for r in got if r.n_hit) == ["7", "9", "None"]
    assert [r["items"] for r in got if r.doc_id == 9] == [[""]]
    assert phrase_index.contamination(no_docs(spark), items).collect() == []
    assert not any(r.n_hit for r in phrase_index.contamination(odd_docs(spark), items.limit(0)).collect())
