"""Distributed positional inverted index: exact phrase and proximity matches.

The index is cut by documents into blocks of bounded size. A block's posting list of a term
holds the term's positions in the block's word sequence (documents follow one another with
a gap between). Queries go the other way round: a window of words is sent, by its rarest
term, only to the blocks in which that term occurs, and is matched there by intersecting
offset-adjusted lists from the rarest term to the most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import stored
from cohortscope.llm.words import ALNUM, blocks, give_back, lean, no_nulls, words_of

GAP = 64  # empty positions between documents of a block; above any slop
BLOCK_BYTES = 4 << 20

_ROWS = ("block long, term string, n long, positions binary, "
         "local int, doc_id long, first int, n_words long")


@dataclass(frozen=True)
class PhraseIndex:
    """``postings`` (block, term, n, positions) and ``documents`` (block, local, doc_id, first, n_words)."""

    postings: DataFrame
    documents: DataFrame


def _delta(positions: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences within each list (the first position of a list as it is)."""
    out = positions.copy()
    out[1:] -= positions[:-1]
    out[firsts] = positions[firsts]
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PhraseIndex:
    """Index every word of every text, in tables in the shared folder.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. A null or empty
    text has no words but is listed. Rows that repeat an id are documents of their own. Other
    columns of ``docs`` are not read. An empty table gives an empty index. One block holds
    about ``BLOCK_BYTES`` of text, or one longer text.
    """

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK_BYTES):
            firsts, words, terms = words_of(no_nulls(batch.column("text")), ALNUM)
            sizes = np.diff(firsts)
            shift = GAP * np.arange(len(sizes))
            position = (np.arange(len(words)) + np.repeat(shift, sizes)).astype(np.int32)
            order = np.argsort(words, kind="stable")
            counts = np.bincount(words, minlength=len(terms)) if len(words) else np.zeros(len(terms), np.int64)
            ends = np.cumsum(counts)
            lists = _delta(position[order], (ends - counts)[counts > 0])
            none = lambda n, kind: pa.nulls(n, kind)
            t, d = len(terms), len(sizes)
            made = pa.BinaryArray.from_buffers(pa.binary(), t, [
                None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)),
                pa.py_buffer(np.ascontiguousarray(lists, "<i4"))])
            names = ["block", "term", "n", "positions", "local", "doc_id", "first", "n_words"]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(t, block)), terms, pa.array(counts), made, none(t, pa.int32()),
                none(t, pa.int64()), none(t, pa.int32()), none(t, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(d, block)), none(d, pa.string()), none(d, pa.int64()), none(d, pa.binary()),
                pa.array(np.arange(d, dtype=np.int32)), batch.column("doc_id"),
                pa.array((firsts[:-1] + shift).astype(np.int32)), pa.array(sizes)], names)
            block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = stored(rows.mapInArrow(index, _ROWS), "phrase-index")
    return PhraseIndex(
        table.filter("term IS NOT NULL").select("block", "term", "n", "positions"),
        table.filter("term IS NULL").select("block", "local", "doc_id", "first", "n_words"))


def windows_of(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, terms`` for every run of ``width`` words of an item (a shorter item: all of it).

    Null texts and texts without words have no window; a null id is the empty string.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            firsts, words, terms = words_of(no_nulls(batch.column("text")), ALNUM)
            names = np.array(terms.to_pylist(), dtype=object)
            for item, a, b in zip(batch.column("item").to_pylist(), firsts.tolist(), firsts[1:].tolist()):
                own = names[words[a:b]].tolist()
                found = [own[k:k + width] for k in range(max(1, len(own) - width + 1))] if own else []
                if found:
                    yield pa.RecordBatch.from_pydict({"item": [item] * len(found), "terms": found}, schema=pa.schema(
                        [("item", pa.string()), ("terms", pa.list_(pa.string()))]))

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, terms array<string>")


def _match(postings: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray,
           steps: list[dict], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions of one window in one block, numbers of their documents)."""
    lead = steps[0]
    starts = postings[lead["term"]] - lead["offset"]
    doc = np.searchsorted(first, starts + lead["offset"], "right") - 1
    if not slop:
        fits = (starts >= first[doc]) & (starts + len(steps) <= first[doc] + size[doc])
        starts, doc = starts[fits], doc[fits]
    for step in steps[1:]:
        if not len(starts):
            break
        listed = postings.get(step["term"])
        if listed is None:
            return starts[:0], doc[:0]
        low = np.maximum(starts + step["offset"] - slop, first[doc])
        high = np.minimum(starts + step["offset"] + slop, first[doc] + size[doc] - 1)
        at = np.searchsorted(listed, low)
        ok = (at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] <= high)
        starts, doc = starts[ok], doc[ok]
    return starts, doc


def search(index: PhraseIndex, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Match windows against all documents: one row per document of the index.

    Returns ``doc_id, n_words, n_hit`` (words inside an occurrence), ``items`` (sorted, of
    occurring windows) and ``spans`` (``start, end`` in words, merged). With ``slop`` 0 a
    window occurs where all its words follow one another (phrase); otherwise where each
    word lies within ``slop`` positions of its place relative to the rarest one, in the
    same document (proximity). ``slop`` is below the gap between documents.

    Only posting lists of terms that windows use are read on; a window goes to the blocks
    that hold its rarest term, so the pairs number at most (windows x blocks). Tables that
    Spark finds small are broadcast by its own threshold, larger ones are shuffled.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    asked = stored(windows.withColumn("win", F.monotonically_increasing_id()), "windows")
    terms = stored(asked.select(F.explode("terms").alias("term")).distinct(), "window-terms")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in
               (("local", "int"), ("doc_id", "long"), ("first", "int"), ("n_words", "long"))]
    used = index.postings.join(terms, "term", "left_semi").select("block", "term", "n", "positions", *nothing)
    listed = index.documents.select(
        "block", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("binary").alias("positions"), "local", "doc_id", "first", "n_words")
    used = stored(used.unionByName(listed), "used-postings")

    frequency = used.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("total"))
    words = asked.select("win", "item", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    plans = words.join(frequency, "term").groupBy("win", "item", "length").agg(
        F.array_sort(F.collect_list(F.struct("total", "term", "offset"))).alias("steps")
    ).filter(F.size("steps") == F.col("length"))  # a window with an unknown term occurs nowhere
    plans = stored(plans.select("item", "steps", F.col("steps")[0]["term"].alias("anchor")), "window-plans")
    held = used.filter("term IS NOT NULL").select(F.col("block").alias("at"), F.col("term").alias("anchor"))
    pairs = held.join(plans, "anchor").select("at", "item", "steps")

    def match(key: tuple, postings: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("n_hit", pa.int64()),
                            ("items", pa.list_(pa.string())),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        if not wanted.num_rows or not postings.num_rows:
            return schema.empty_table()
        is_doc = postings.column("term").is_null()
        docs = postings.filter(is_doc).sort_by("local")
        rest = postings.filter(pa.compute.invert(is_doc))
        lists = {t: np.cumsum(np.frombuffer(p, "<i4"), dtype=np.int64) for t, p in
                 zip(rest.column("term").to_pylist(), rest.column("positions").to_pylist())}
        first = docs.column("first").to_numpy().astype(np.int64)
        size = docs.column("n_words").to_numpy()
        cover = np.zeros(int(first[-1] + size[-1]) + 2, np.int32)
        items: dict[int, set[str]] = {}
        for item, steps in zip(wanted.column("item").to_pylist(), wanted.column("steps").to_pylist()):
            starts, doc = _match(lists, first, size, steps, slop)
            if len(starts):  # by proximity a window may reach beyond its document's ends
                np.add.at(cover, np.maximum(starts, first[doc]), 1)
                np.add.at(cover, np.minimum(starts + len(steps), first[doc] + size[doc]), -1)
                for d in np.unique(doc).tolist():
                    items.setdefault(d, set()).add(item)
        hit = np.cumsum(cover) > 0
        out: dict[str, list] = {f.name: [] for f in schema}
        for d in sorted(items):
            own = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[d]:first[d] + size[d]].view(np.int8), [0]])))
            spans = own.reshape(-1, 2)
            out["block"].append(key[0].as_py())
            out["local"].append(d)
            out["n_hit"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["items"].append(sorted(items[d]))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in spans])
        give_back()
        return pa.Table.from_pydict(out, schema=schema)

    found = used.groupBy("block").cogroup(pairs.groupBy("at")).applyInArrow(
        match, "block long, local int, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    return index.documents.join(found, ["block", "local"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Index ``docs`` and search the windows of ``items``; the result of :func:`search`."""
    return search(build_index(docs), windows_of(items, width), slop)


ORACLE_SQL = r"""
WITH lowered AS (
    SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), wins AS (
    SELECT DISTINCT id AS item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, k + 1, k + 10), ' ') AS win
    FROM (SELECT id, w, unnest(range(0, greatest(1, len(w) - 9))) AS k FROM words WHERE kind = 1 AND len(w) > 0)
), runs AS (
    SELECT id AS doc_id, size, k, array_to_string(list_slice(w, k + 1, k + size), ' ') AS win
    FROM (SELECT id, w, size, unnest(range(0, len(w) - size + 1)) AS k
          FROM words, (SELECT DISTINCT size FROM wins) WHERE kind = 0 AND len(w) >= size)
), found AS (
    SELECT doc_id, item_id, k, runs.size FROM runs JOIN wins ON runs.win = wins.win AND runs.size = wins.size
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, k + unnest(range(0, size)) AS p FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
    coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.id LEFT JOIN items i ON i.doc_id = w.id WHERE w.kind = 0
"""
