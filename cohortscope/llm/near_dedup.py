"""Near-duplicate classes by one-permutation MinHash with optimal densification.

A document's shingle hashes fall into bins by their top bits and each bin keeps its least
hash; an empty bin borrows from the first full bin in its own fixed order. Bands of bins
name buckets. In a bucket only star edges are drawn, from the hub to every other member;
the hub is the member whose buckets hold most documents in all, which in a family of copies
is the one nearest to the others. Edges are confirmed on whole shingle sets. A member that
ends up apart from the main class of one of its buckets is then compared, on whole sets and
in blocks of bounded size, with that class, so no link is lost for want of a hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import join_hot, stored
from cohortscope.llm.sharding import _mix
from cohortscope.llm.words import SPACED, blocks, lean, no_nulls, words_of

BINS = 256
BLOCK_BYTES = 4 << 20
MISS = 1e-4  # a pair at the threshold shares no bucket with less than this probability
CELL_SHINGLES = 200_000  # shingles of one side of a block comparison

_ORDERS = np.stack([np.random.default_rng([7, i]).permutation(BINS) for i in range(BINS)], axis=1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (a shorter text: one)."""
    firsts, words, terms = words_of(texts, SPACED)
    with np.errstate(over="ignore"):
        hashed = pd.util.hash_array(np.array(terms.to_pylist(), dtype=object), categorize=False) \
            if len(terms) else np.zeros(0, np.uint64)
        word = hashed[words]
        m = max(0, len(word) - width + 1)
        shingle = np.zeros(m, np.uint64)
        for k in range(width):
            shingle = _mix(shingle + word[k:k + m])
        out = []
        for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(shingle[a:b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in word[a:b]:
                    short = _mix(np.array([short + w]))[0]
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least hash of each bin of a sorted, non-empty set; empty bins are densified."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    full = np.zeros(BINS, bool)
    full[bins[head]] = True
    sig = np.zeros(BINS, np.uint64)
    sig[bins[head]] = hashes[head]
    empty = np.flatnonzero(~full)
    rows = 8
    while len(empty):  # a bin's order is a permutation, so every bin is served by the last row
        seen = full[_ORDERS[:rows, empty]]
        served = seen.any(axis=0)
        source = _ORDERS[seen.argmax(axis=0), empty]
        sig[empty[served]] = sig[source[served]]
        empty, rows = empty[~served], min(BINS, rows * 8)
    return sig


def band_width(percent: int) -> int:
    """Bins a band: the most that keep the chance to miss a pair below ``MISS`` (0.85: 8)."""
    share = percent / 100
    fits = [r for r in range(1, 17) if (1 - share ** r) ** (BINS // r) < MISS]
    return max(fits, default=1)


def band_keys(sig: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit bucket key a band of ``width`` bins."""
    bands = BINS // width
    with np.errstate(over="ignore"):
        rows = sig[:bands * width].reshape(bands, width)
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(width):
            key = _mix(key + rows[:, k])
    return key.view(np.int64)


def _profile(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, digest`` of the shingle set and ``keys``, its buckets."""
    bins = band_width(percent)

    @lean
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(no_nulls(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([band_keys(signature(s), bins) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["doc_id", "n", "digest", "keys"])

    return rows.mapInArrow(profile, "doc_id long, n long, digest binary, keys array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """``doc, shingles`` (sorted hashes as bytes)."""

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            made = shingle_sets(no_nulls(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.tobytes() for s in made], pa.binary())], ["doc", "shingles"])

    return rows.mapInArrow(sets, "doc long, shingles binary")


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def shared_buckets(members: DataFrame) -> DataFrame:
    """``key, doc, n``: the rows ``key, doc`` of buckets with ``n`` > 1 members, as a table.

    A bucket that a third of all sets share is a hot key: its members do not meet in one task
    (:func:`join_hot`), here and in the steps that follow.
    """
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    return stored(join_hot(members, sizes, "key", "n", _held(sizes)).filter("n IS NOT NULL"), "buckets")


def _held(sizes: DataFrame) -> int:
    """Rows in all buckets of ``key, n``."""
    return sizes.agg(F.sum("n").alias("n")).first()["n"] or 0


def star_edges(shared: DataFrame) -> DataFrame:
    """``hub, doc``: from ``key, doc, n`` (buckets), the hub of each bucket to its other members.

    At most one edge a member and bucket.
    """
    mass = shared.groupBy("doc").agg(F.sum("n").alias("mass"))
    weighed = shared.join(mass, "doc")
    hubs = stored(weighed.groupBy("key").agg(
        F.max(F.struct("mass", (-F.col("doc")).alias("least"))).alias("h"), F.max("n").alias("n"))
        .select("key", (-F.col("h.least")).alias("hub"), "n"), "hubs")
    starred = join_hot(shared.select("key", "doc"), hubs, "key", "n", _held(hubs))
    return starred.filter("hub <> doc").select("hub", "doc").distinct()


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``hub, doc`` edges whose whole sets are similar enough."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(a, b, percent) for a, b in
                  zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select(["hub", "doc"]).filter(pa.array(ok, pa.bool_()))

    both = edges.join(sets.withColumnsRenamed({"shingles": "a", "doc": "x"}), F.col("hub") == F.col("x")) \
        .join(sets.withColumnsRenamed({"shingles": "b", "doc": "y"}), F.col("doc") == F.col("y"))
    return both.select("hub", "doc", "a", "b").mapInArrow(check, "hub long, doc long")


def components(edges: DataFrame) -> DataFrame:
    """``doc, component`` (least document reachable) of every document that has an edge.

    Alternates large-star and small-star steps, each one grouping and one join of narrow
    rows, and writes the edges down after each round, until a round changes nothing.
    """

    def fingerprint(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))

    e = stored(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v"))
               .filter("u <> v").distinct(), "edges")
    before = fingerprint(e)
    while True:
        ends = 2 * before[0]  # a hub may hold a third of these: hot keys are joined apart
        both = e.union(e.select("v", "u"))
        large = join_hot(both, least_of(both), "u", "degree", ends).filter("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = join_hot(down, least_of(down), "u", "degree", ends).select("u", "v", "m")
        e = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        e = stored(e, "edges")
        after = fingerprint(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("doc")).distinct().withColumn("component", F.col("doc"))
    return e.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("component")).union(roots)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``main, doc``: members of a bucket outside the bucket's largest class."""
    named = members.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    counts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = stored(counts.groupBy("key").agg(
        F.max(F.struct("n", (-F.col("component")).alias("least"))).alias("top"), F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("n")).filter("classes > 1").select("key", (-F.col("top.least")).alias("main"), "n"), "main-classes")
    met = join_hot(named, main, "key", "n", _held(main))
    return met.filter("main IS NOT NULL AND component <> main").select("main", "doc").distinct()


def _block_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links found by comparing, cell by cell, each asking set with all listed sets."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        sets = [np.frombuffer(b, np.uint64) for b in rows.column("shingles").to_pylist()]
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        docs, classes = rows.column("doc").to_numpy(), rows.column("component").to_numpy()
        listed = np.flatnonzero(~asks)
        if not len(listed) or not asks.any():
            return schema.empty_table()
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([sets[k] for k in listed])
        owner = np.repeat(np.arange(len(listed)), size[listed])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(asks):
            low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
            span = high - low
            at = np.arange(span.sum()) + np.repeat(low - (np.cumsum(span) - span), span)
            both = np.bincount(owner[at], minlength=len(listed))
            near = 100 * both >= percent * (size[k] + size[listed] - both)
            near &= classes[listed] != classes[k]
            hit = listed[near]
            if len(hit):  # one link to each class that it meets
                _, one = np.unique(classes[hit], return_index=True)
                found += [(int(docs[k]), int(docs[h])) for h in hit[one]]
        return pa.Table.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], schema=schema)

    return cells.groupBy("main", "i", "j").applyInArrow(compare, "u long, v long")


def _late_links(apart: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members apart and the classes they came near to.

    Both sides of a class are cut into parts of about ``CELL_SHINGLES`` shingles and every
    part of the one meets every part of the other in a group of its own.
    """
    named = sets.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    asking = apart.join(named, "doc").withColumn("n", F.octet_length("shingles") / 8)
    wanted = apart.select("main").distinct()
    inside = named.join(wanted, F.col("component") == F.col("main")).withColumn("n", F.octet_length("shingles") / 8)
    columns = ["main", "doc", "component", "shingles", "n"]
    asking = stored(asking.select(*columns), "asking")
    listed = stored(inside.select(*columns).unionByName(asking), "listed")
    parts = lambda df, name: df.groupBy("main").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias(name))
    grid = stored(parts(asking, "a").join(parts(listed, "b"), "main"), "grid")
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    side = lambda df, own, other, own_name, other_name, asks: df.join(grid, "main").select(
        "main", part(own).alias(own_name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name),
        "doc", "component", "shingles", F.lit(asks).alias("asks"))
    cells = side(asking, "a", "b", "i", "j", True).unionByName(side(listed, "b", "a", "j", "i", False))
    return _block_links(cells, percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; a text of fewer
    words is one shingle). ``component_id`` is the smallest id reachable over links. Null,
    empty and wordless texts have the empty set and are linked with nothing.

    Rows with equal sets are merged first and only their smallest id goes on. Ids are taken
    to be unique: rows that repeat an id count as one document. A null id is never linked
    on its own account; it takes the class of rows with its set. Other columns of ``docs``
    are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = stored(_profile(rows, width, percent), "profiles")
    sized = profiles.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_rows"), F.min("keys").alias("keys"))
    classes = stored(sized, "classes")
    members = classes.filter("doc IS NOT NULL").select(F.explode("keys").alias("key"), "doc")
    shared = shared_buckets(members)
    edges = stored(star_edges(shared), "star-edges")
    near = stored(edges.select("hub").union(edges.select("doc")).distinct().toDF("doc"), "near-docs")
    sets = stored(_sets(rows.join(near, F.col("doc_id") == F.col("doc"), "left_semi"), width), "near-sets",
                  {"compression": "none"})
    links = stored(confirm(edges, sets, percent), "links")
    labels = stored(components(links), "labels")
    apart = stored(_apart(shared.select("key", "doc"), labels), "apart")
    late = stored(_late_links(apart, labels, sets, percent), "late-links")
    labels = components(links.toDF("u", "v").union(late)) if late.limit(1).count() else labels

    known = classes.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    known = stored(known.filter("n_rows > 1 OR component <> doc").select("digest", "component", "n_rows"), "known")
    placed = join_hot(profiles.select("doc_id", F.col("n").alias("n_shingles"), "digest"), known, "digest", "n_rows",
                      profiles.count())
    component = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, k + 1, k + 3), ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 2))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM words
    UNION
    SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM links UNION SELECT y, x FROM links) l ON l.x = r.y
), least AS (
    SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM words w JOIN least l ON l.doc_id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id
"""
