import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortscope.llm import merkle
from helpers import no_docs, odd_docs, shipped  # noqa: F401


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    parts = [doc_id, source, lang, n_chars, text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(level, arity):
    """Root of a list of digests, and of each the steps (before, after) up to it."""
    ways, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, at in enumerate(place):
            first = at - at % arity
            ways[k].append((level[first:at], level[at + 1:first + arity]))
            place[k] = at // arity
        level = [h("".join(level[a:a + arity])) for a in range(0, len(level), arity)]
    return level[0], ways


def expected(rows, arity=3):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((leaf(*r), r))
    trees = {}
    for source, own in by.items():
        own.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[source] = tree([d for d, _ in own], arity)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, over = tree([trees[s][0] for s in sources], arity)
    out = []
    for s, top in zip(sources, over):
        for (digest, r), way in zip(by[s], trees[s][1]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(*r[:4], text)
            for before, after in way + top:
                folded = h("".join(before) + folded + "".join(after))
            proof = h("".join("".join(b) + "".join(a) for b, a in way + top))
            out.append((r[0], digest, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def tampered():
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def check(docs, arity=3):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = sorted(map(tuple, merkle.audit(docs, tampered(), arity).collect()), key=str)
    assert got == expected(rows, arity)
    return got


def test_odd_rows_against_brute_force(spark):
    """Null ids and sources, repeated rows, empty and very long texts, clashing columns."""
    check(odd_docs(spark))


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_sizes_around_full_runs(spark, arity):
    """Sources of 1 to 10, 27 and 28 leaves; one holds a third of all rows and more."""
    rows, n = [], 0
    for k, size in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 10, 27, 28, 90]):
        for _ in range(size):
            rows.append((n * 7 % 1009, f"s{k:02d}" if k else None, "en", n, f"line {n}\nnext\n" if n % 3 else None))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = check(docs.repartition(5), arity)
    assert {r[6] for r in got} == {True, False}


def test_one_row_is_leaf_subroot_and_root(spark):
    docs = spark.createDataFrame([(3, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = check(docs)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h("")


def test_a_changed_row_changes_the_root_and_no_proof_of_another_source(spark):
    docs = spark.range(60).selectExpr(
        "id AS doc_id", "concat('s', id % 4) AS source", "'en' AS lang", "id AS n_chars", "concat('t', id) AS text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text")))
    a = merkle.manifest(merkle.document_rows(docs, F.col("text")))
    b = merkle.manifest(merkle.document_rows(changed, F.col("text")))
    assert a.root != b.root
    keys = lambda m: {r.tree: bytes(r.digest) for r in m.subroots.collect()}
    assert {t for t, d in keys(a).items() if keys(b)[t] != d} == {"1s1"}


def test_empty_table(spark):
    assert merkle.audit(no_docs(spark), F.col("text")).collect() == []
