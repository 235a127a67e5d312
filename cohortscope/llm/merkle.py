"""Merkle manifest of a table: a tree per source, a tree over the sources, proofs of every row.

Levels are built from the leaves up by sibling-shift self-joins: each node computes the
indices of the other slots of its run and equijoins its own level on them, once per other
slot; the slot-zero rows, which then hold their whole run, emit the parents. Proofs are laid
from the root down: a node's path is its own step before its parent's path, so each level
moves only as many rows as it has nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import number_rows, stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed: the fields of a leaf, in order


def sha(column: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(column.cast("binary"), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_input(*columns: Column) -> Column:
    """Each value as UTF-8 byte count, ``:`` and value, or ``-`` if null, one after another."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts])


def tree_key(source: Column) -> Column:
    """A source as a key that is never null and sorts null first, then bytewise."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


@dataclass(frozen=True)
class Tree:
    """Trees of one forest. ``steps[k]``: the nodes of level k whose tree goes on
    (``tree, idx, n, digest, before, after`` and, at level 0, the caller's columns); ``roots``:
    ``tree, digest, height``; ``single``: leaves that are roots themselves."""

    arity: int
    steps: list[DataFrame]
    roots: DataFrame
    single: DataFrame


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """Trees over ``leaves``: ``tree`` (never null), ``idx`` (0, 1, ... in each tree), ``n``
    (leaves of the tree), ``digest`` (binary), and columns of the caller.

    While a tree has several nodes on a level, each ``arity`` consecutive ones (the last run:
    fewer, even one) become the SHA-256 of their joined hex digests. Every level is written to
    the shared folder, so lost executors never rebuild the levels below. Joins go by (tree,
    index), at most ``arity`` rows a key, whatever share of the rows a tree holds. The driver
    sees one number: the leaves of the largest tree. No leaves: no steps and no roots.
    """
    largest = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    level, steps, roots, height = leaves, [], [], 0
    while True:
        roots.append(level.filter("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        if largest <= 1:
            break
        slot = F.pmod("idx", F.lit(arity))
        runs = level.filter("n > 1")
        for k in range(arity - 1):
            other = level.select(
                F.col("tree").alias(f"_t{k}"), F.col("idx").alias(f"_i{k}"), F.col("digest").alias(f"_d{k}"))
            sibling = F.col("idx") - slot + F.lit(k) + F.when(slot <= k, F.lit(1)).otherwise(F.lit(0))
            runs = runs.join(other, (F.col("tree") == F.col(f"_t{k}")) & (sibling == F.col(f"_i{k}")), "left") \
                .drop(f"_t{k}", f"_i{k}")
        none = F.lit(b"")
        found = [F.coalesce(f"_d{k}", none) for k in range(arity - 1)]
        before = F.concat(none, *[F.when(slot > k, d).otherwise(none) for k, d in enumerate(found)])
        after = F.concat(none, *[F.when(slot <= k, d).otherwise(none) for k, d in enumerate(found)])
        runs = runs.withColumns({"before": before, "after": after}).drop(*[f"_d{k}" for k in range(arity - 1)])
        steps.append(stored(runs, f"merkle-{height}"))
        level = steps[-1].filter(F.pmod("idx", F.lit(arity)) == 0).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.unhex(sha(F.concat(hexed(F.col("digest")), hexed(F.col("after"))))).alias("digest"))
        largest = -(-largest // arity)
        height += 1
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return Tree(arity, steps, stored(whole, "merkle-roots"), leaves.filter("n = 1"))


_STEP = "array<struct<before:binary,after:binary>>"


def paths(tree: Tree, ends: DataFrame) -> DataFrame:
    """Every leaf with ``path`` (its steps up to the root, then those of ``ends``) and the
    other columns of ``ends`` (one row per tree: ``tree, height, path``, ...)."""
    carried = [c for c in ends.columns if c not in ("tree", "height")]
    taken = [F.col(c).alias(f"_e_{c}") for c in carried]
    above = None
    for height in range(len(tree.steps), 0, -1):
        parents = ends.filter(F.col("height") == height).select(
            F.col("tree").alias("_t"), F.lit(0).cast("long").alias("_i"), *taken)
        if above is not None:
            parents = parents.unionByName(above.select(
                F.col("tree").alias("_t"), F.col("idx").alias("_i"), *taken))
        nodes = tree.steps[height - 1]
        joined = nodes.join(
            parents, (F.col("tree") == F.col("_t")) & (F.expr(f"idx div {tree.arity}") == F.col("_i")))
        step = F.array(F.struct("before", "after")).cast(_STEP)
        own = [c for c in nodes.columns if c not in ("before", "after", *carried)] if height == 1 else ["tree", "idx"]
        joined = joined.select(*own, *[
            (F.concat(step, F.col("_e_path")) if c == "path" else F.col(f"_e_{c}")).alias(c) for c in carried])
        above = stored(joined, f"merkle-paths-{height - 1}") if height > 1 else joined
    alone = tree.single.join(
        ends.filter("height = 0").select(F.col("tree").alias("_t"), *taken), F.col("tree") == F.col("_t"))
    alone = alone.select(
        *[c for c in tree.single.columns if c not in carried], *[F.col(f"_e_{c}").alias(c) for c in carried])
    return alone if above is None else above.unionByName(alone)


def proof_sha256(path: Column) -> Column:
    """Digest of a path: the hex digests of all siblings, bottom up, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: hexed(F.concat(s["before"], s["after"]))), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and a path lead to."""
    return F.aggregate(path, leaf, lambda d, s: sha(F.concat(hexed(s["before"]), d, hexed(s["after"]))))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the caller's columns, ``idx``, ``digest``, ``path``, ``subroot``, ``root``
    (digests binary). ``subroots``: ``tree, digest``. ``nodes``: every inner node's children."""

    leaves: DataFrame
    subroots: DataFrame
    sources: Tree
    root: str | None


def manifest(rows: DataFrame, arity: int = ARITY) -> Manifest:
    """Manifest of ``rows``: ``tree`` (see :func:`tree_key`), ``doc_id``, ``digest`` and others.

    In each tree, leaves ascend by id (null first), rows of one id by digest. The trees' roots,
    in the order of their keys, are the leaves of the tree whose root names the whole table.
    An empty table has no root and no leaves.
    """
    leaves = number_rows(rows, ["tree"], ["doc_id", "digest"], "idx", total="n", few_groups=False)
    forest = build(stored(leaves, "merkle-leaves"), arity)
    tops = number_rows(
        forest.roots.withColumnRenamed("tree", "key"), [], ["key"], "idx", total="n", few_groups=False)
    top = build(stored(tops.withColumn("tree", F.lit("")), "merkle-sources"), arity)
    summit = top.roots.first()
    root = None if summit is None else summit["digest"].hex()
    peak = top.roots.withColumn("path", F.array().cast(_STEP)).select("tree", "height", "path")
    ends = stored(paths(top, peak).select(
        F.col("key").alias("tree"), "height", "path", F.col("digest").alias("subroot")), "merkle-ends")
    return Manifest(paths(forest, ends), forest.roots.select("tree", "digest"), top, root)


def document_rows(docs: DataFrame, tampered: Column, id_col: str = "doc_id") -> DataFrame:
    """Leaves of documents: ``tree, doc_id, digest`` and ``other`` (the digest with the text
    replaced by ``tampered`` where that differs, else null). Any column may be null; other
    columns are not read."""
    fields = [F.col(id_col if c == "doc_id" else c) for c in FIELDS]
    changed = ~tampered.eqNullSafe(F.col("text"))
    return stored(docs.select(
        tree_key(F.col("source")).alias("tree"), F.col(id_col).alias("doc_id"),
        F.unhex(sha(leaf_input(*fields))).alias("digest"),
        F.when(changed, F.unhex(sha(leaf_input(*fields[:-1], tampered)))).alias("other")), "merkle-rows")


def audit(docs: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """Prove every document against the manifest of ``docs`` with its text as ``tampered`` says.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. The manifest
    holds the untampered rows; ``folded_root`` starts from the tampered leaf. Nulls in any
    column, empty and very long texts and repeated rows are leaves like others; rows that repeat
    an id stand by digest. An empty table gives no rows.
    """
    made = manifest(document_rows(docs, tampered), arity)
    root = F.lit(made.root).cast("string")
    folded = made.leaves.withColumn("folded_root", fold(hexed(F.coalesce("other", "digest")), F.col("path")))
    return folded.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_sha256(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, text IS NOT NULL AND list_reduce(
               list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
               lambda r, b: list_reduce(list_prepend(xor(r, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                  lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) & 1 = 1 AS even,
           concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'),
                  coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head, text
    FROM documents
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN even THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''))
                ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM d
), up AS (
    SELECT source, 0 AS lvl, idx, n, leaf AS h FROM leaves
    UNION ALL
    SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM up WHERE n > 1 GROUP BY source, lvl, n, idx // 3
), subs AS (
    SELECT source, lvl AS height, h,
           row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
    SELECT 0 AS lvl, idx, n, h FROM subs
    UNION ALL
    SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM top WHERE n > 1 GROUP BY lvl, n, idx // 3
), sib AS (
    SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
    WHERE a.n > 1 GROUP BY ALL
), topsib AS (
    SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
    WHERE a.n > 1 GROUP BY ALL
), way AS (
    SELECT doc_id, source, 0 AS lvl, idx, false AS summit, seen AS h, '' AS proof, 0 AS steps FROM leaves
    UNION ALL
    SELECT w.doc_id, w.source,
           CASE WHEN w.summit OR s.lvl IS NOT NULL THEN w.lvl + 1 ELSE 0 END,
           CASE WHEN w.summit OR s.lvl IS NOT NULL THEN w.idx // 3 ELSE u.idx END,
           w.summit OR s.lvl IS NULL,
           CASE WHEN w.summit THEN sha256(t.l || w.h || t.r) WHEN s.lvl IS NOT NULL THEN sha256(s.l || w.h || s.r) ELSE w.h END,
           CASE WHEN w.summit THEN w.proof || t.l || t.r WHEN s.lvl IS NOT NULL THEN w.proof || s.l || s.r ELSE w.proof END,
           w.steps + 1
    FROM way w
    LEFT JOIN sib s ON NOT w.summit AND s.source IS NOT DISTINCT FROM w.source AND s.lvl = w.lvl AND s.idx = w.idx
    LEFT JOIN topsib t ON w.summit AND t.lvl = w.lvl AND t.idx = w.idx
    LEFT JOIN subs u ON NOT w.summit AND u.source IS NOT DISTINCT FROM w.source
    WHERE NOT w.summit OR t.lvl IS NOT NULL
), ended AS (
    SELECT doc_id, arg_max(h, steps) AS folded_root, arg_max(proof, steps) AS proof FROM way GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.folded_root,
       e.folded_root = r.h AS verified
FROM leaves l JOIN ended e USING (doc_id) JOIN subs s ON s.source IS NOT DISTINCT FROM l.source,
     (SELECT h FROM top WHERE n = 1) r
"""
