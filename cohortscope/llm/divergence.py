"""Source divergence audit: how the sources of a language differ in their words.

Two passes over the texts. The first counts, per language, the documents of every term and
keeps the frequent ones exactly. The kept terms become minimal perfect hashes in shards of a
few hundred terms, with the terms stored for verification; they are broadcast in rounds of
bounded size, and the second pass increments dense slots per (language, source). Distances
between sources are added up in blocks of sources by blocks of slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortscope.llm.common import join_hot, prepare, stored
from cohortscope.llm.perfect_hash import Shards, build
from cohortscope.llm.words import blocks, byte_table, lean, no_nulls, words_of

LETTERS = byte_table(lambda b: 0x61 <= b <= 0x7A)  # terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+, A-Z in lower case
UNIT = 1_000_000_000  # shares are whole billionths
SMOOTH = 5
SHARD_TERMS = 256  # terms a shard holds on average
ROUND_BYTES = 32 << 20  # hashes broadcast at a time
DENSE_SLOTS = 4 << 20  # slots a task holds at a time
SOURCE_BLOCK = 64  # sources of a side of a cell, on average
WIDE = 8  # shards of a cell


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


@lean
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term, n``: documents of a batch that hold the term."""
    for batch in blocks(batches, "text"):
        firsts, words, terms = words_of(no_nulls(batch.column("text")), LETTERS)
        lang, names = _codes(batch.column("lang"))
        width = max(1, len(terms))
        held = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(firsts)) * width + words)
        pairs, n = np.unique(lang[held // width].astype(np.int64) * width + held % width, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(pairs // width)), terms.take(pa.array(pairs % width)),
             pa.array(n.astype(np.int64))], ["lang", "term", "n"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """``lang, term`` of every term that at least ``min_docs`` documents of the language hold."""
    counts = _rows(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def perfect_shards(kept: DataFrame) -> DataFrame:
    """One row per shard: ``lang, v`` (terms of the language), ``n_shards, shard, seed, size,
    displaced, terms`` (in slot order) and ``bytes``. Terms are dealt by hash, so a language
    with most of the terms has most of the shards."""
    sizes = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "divergence-languages")
    rows = join_hot(kept, sizes, "lang", "v", kept.count())
    n_shards = F.ceil(F.col("v") / SHARD_TERMS)
    dealt = rows.withColumn("n_shards", n_shards).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("n_shards")))

    def hashed(table: pa.Table) -> pa.Table:
        terms = table.column("term").combine_chunks()
        seed, displaced, slot = build(terms.cast(pa.binary()).to_pylist())
        order = np.empty(len(slot), np.int64)
        order[slot] = np.arange(len(slot))
        size = 100 + 8 * len(displaced) + terms.nbytes
        one = {c: table.column(c).slice(0, 1) for c in ("lang", "v", "n_shards", "shard")}
        return pa.table({**one, "seed": pa.array([seed], pa.int64()), "size": pa.array([len(terms)], pa.int64()),
                         "displaced": pa.array([displaced], pa.list_(pa.int64())),
                         "terms": pa.array([terms.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
                         "bytes": pa.array([size], pa.int64())})

    return stored(dealt.groupBy("lang", "shard").applyInArrow(
        hashed, "lang string, v long, n_shards long, shard long, seed long, size long, displaced array<long>, "
                "terms array<string>, bytes long"), "divergence-hashes")


_COUNTED = "lang string, source string, shard long, slots array<int>, counts array<long>"


def _recount(hashes):
    """The second pass, as a function over batches; ``hashes``: a broadcast of language to
    :class:`Shards`."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes.value
        held: dict[tuple[str, str], np.ndarray] = {}
        slots = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in held.items():
                own = known[lang]
                at = np.flatnonzero(dense)
                shard = np.searchsorted(own.first, at, side="right") - 1
                begin = np.flatnonzero(np.diff(shard, prepend=-1))
                offsets = pa.array(np.append(begin, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(begin), pa.string()), pa.array([source] * len(begin), pa.string()),
                     pa.array(own.ids[shard[begin]]),
                     pa.ListArray.from_arrays(offsets, pa.array((at - own.first[shard]).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(dense[at]))],
                    ["lang", "source", "shard", "slots", "counts"])
            held.clear()

        for batch in blocks(batches, "text"):
            firsts, words, terms = words_of(no_nulls(batch.column("text")), LETTERS)
            lang, langs = _codes(batch.column("lang"))
            source, sources = _codes(batch.column("source"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            for k, name in enumerate(langs):
                if name not in known or not len(words):
                    continue
                own = known[name]
                mine = np.flatnonzero(lang[owner] == k)
                used = np.unique(words[mine])
                place = np.full(len(terms), -1, np.int64)
                place[used] = own.lookup(terms.take(pa.array(used)))
                at = place[words[mine]]
                pair = source[owner[mine]][at >= 0].astype(np.int64) * len(own) + at[at >= 0]
                pair, n = np.unique(pair, return_counts=True)
                group = pair // len(own)
                ends = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(pair))
                for a, b in zip(ends[:-1], ends[1:]):
                    key = (name, sources[group[a]])
                    if key not in held:
                        if slots + len(own) > DENSE_SLOTS:
                            yield from emit()
                            slots = 0
                        held[key] = np.zeros(len(own), np.int64)
                        slots += len(own)
                    held[key][pair[a:b] % len(own)] += n[a:b]
        yield from emit()

    return run


def _rounds(shards: DataFrame, round_bytes: int) -> Iterator[dict[str, Shards]]:
    """The hashes by language, about ``round_bytes`` at a time and never one shard more."""
    upto = Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = stored(shards.select("lang", "shard", "bytes").withColumn(
        "round", F.floor((F.sum("bytes").over(upto) - 1) / round_bytes)).select("lang", "shard", "round"),
        "divergence-rounds")
    last = dealt.agg(F.max("round").alias("r")).first()["r"]
    for k in range(0 if last is None else int(last) + 1):
        rows = shards.join(dealt.filter(F.col("round") == k), ["lang", "shard"]).orderBy("lang", "shard")
        table = rows.select("lang", "n_shards", "shard", "seed", "size", "displaced", "terms").toArrow().combine_chunks()
        names = table.column("lang").to_pylist()
        firsts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        found = {}
        for a, b in zip(firsts, [*firsts[1:], len(names)]):
            part = table.slice(a, b - a).combine_chunks()
            column = lambda c: part.column(c).to_numpy()  # noqa: E731, B023
            found[names[a]] = Shards(
                part.column("n_shards")[0].as_py(), column("shard"), column("seed"), column("size"),
                np.concatenate(part.column("displaced").to_pylist()).astype(np.int64),
                pa.concat_arrays(part.column("terms").chunks).flatten())
        if found:
            yield found


def recount(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``lang, source, shard, slot, n``: exact occurrences, where there are any.

    Hashes are broadcast ``round_bytes`` at a time, whatever the vocabulary; a larger one takes
    more rounds, and each round reads only the texts of its languages. A task holds at most
    ``DENSE_SLOTS`` dense slots and hands them on when they are full.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = []
    for found in _rounds(shards, round_bytes):
        hashes = spark.sparkContext.broadcast(found)
        texts = _rows(docs).filter(F.col("lang").isin(*found))
        rows = texts.mapInArrow(_recount(hashes), _COUNTED)
        rows = rows.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("c")).groupBy(
            "lang", "source", "shard", F.col("c.slots").alias("slot")).agg(F.sum("c.counts").alias("n"))
        parts.append(stored(rows, "divergence-counts"))
        hashes.unpersist()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, shard long, slot int, n long")
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1e9 (count + 5) / (total + 5 terms))``, exact: a long division in steps of a
    thousand, right while the denominator is below 9.2e15."""
    rest, whole = count + SMOOTH, F.lit(0).cast("long")
    below = total + SMOOTH * terms
    for _ in range(3):
        scaled = rest * 1000
        rest = scaled % below
        whole = whole * 1000 + F.call_function("div", scaled, below)
    return whole + 1


def _shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """:func:`share` of a matrix (sources by slots)."""
    rest, whole = counts + SMOOTH, np.zeros_like(counts)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, below[:, None])
        whole = whole * 1000 + part
    return whole + 1


@dataclass(frozen=True)
class Audit:
    """``groups``: ``lang, source, total, lang_total, v``; ``terms``: ``lang, shard, slot, term``;
    ``counts``: ``lang, source, shard, slot, n``; ``shards``: ``lang, shard, size``."""

    groups: DataFrame
    terms: DataFrame
    counts: DataFrame
    shards: DataFrame


def audit(docs: DataFrame, min_docs: int = 30, round_bytes: int = ROUND_BYTES) -> Audit:
    """Count the kept terms of every (lang, source) group of ``docs``.

    Null lang, source and text count as empty strings; repeated rows and ids are documents of
    their own; ids and other columns are not read. Very long texts are read whole. A language
    may keep no term. An empty table has no groups.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = stored(kept_terms(docs, min_docs), "divergence-terms")
    shards = perfect_shards(kept)
    counts = recount(docs, shards, round_bytes)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _rows(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left") \
        .select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    groups = stored(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_sources"))
    sizes = shards.groupBy("lang").agg(F.max("v").alias("v"))
    langs = stored(langs.join(sizes, "lang", "left").select(
        "lang", "lang_total", "n_sources", F.coalesce("v", F.lit(0).cast("long")).alias("v")), "divergence-totals")
    groups = stored(join_hot(groups, langs, "lang", "n_sources", groups.count()), "divergence-groups")
    terms = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
    return Audit(groups, terms, counts, shards.select("lang", "shard", "size"))


def source_distances(made: Audit) -> DataFrame:
    """``lang, source, item, value``: for each ordered pair of sources of a language the sum
    over all kept terms of the difference of their shares.

    Cells pair two blocks of about ``SOURCE_BLOCK`` sources over about ``WIDE`` shards of slots,
    so no task holds all sources or all terms; every source is in every cell of its blocks,
    also where it has none of the terms.
    """
    blocks_of = F.ceil(F.col("n_sources") / SOURCE_BLOCK)
    groups = made.groups.withColumn("n_blocks", blocks_of).withColumn(
        "block", F.pmod(F.xxhash64("source"), F.col("n_blocks"))).select(
        "lang", "source", "n_blocks", "block", (F.col("total") + SMOOTH * F.col("v")).alias("below"))
    wide = F.floor(F.col("shard") / WIDE)
    cells = made.shards.groupBy("lang", wide.alias("wide")).agg(
        F.sort_array(F.collect_list(F.struct("shard", "size"))).alias("sizes"))
    # Every block of sources meets every group of shards: by (language, block), so a language with
    # most of the sources and terms is as even as the others.
    langs = groups.select("lang", "n_blocks").distinct().join(cells, "lang", "left").select(
        "lang", F.coalesce("wide", F.lit(0)).alias("wide"), "sizes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    lists = made.counts.groupBy("lang", "source", wide.alias("wide")).agg(
        F.collect_list(F.struct("shard", "slot", "n")).alias("held"))
    rows = groups.join(langs, ["lang", "block"]).join(lists, ["lang", "source", "wide"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "lang", "wide", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
        "source", "below", "sizes", "held")

    def distances(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table.column("sizes")[0].as_py() or []
        first, n = {}, 0
        for s in sizes:
            first[s["shard"]] = n
            n += s["size"]
        counts = np.zeros((table.num_rows, n), np.int64)
        held = table.column("held").combine_chunks()
        flat = held.flatten()
        if len(flat):
            starts = np.zeros(max(first) + 1, np.int64)
            starts[list(first)] = list(first.values())
            lengths = pc.fill_null(pc.list_value_length(held), 0).to_numpy()
            at = starts[flat.field("shard").to_numpy()] + flat.field("slot").to_numpy()
            counts[np.repeat(np.arange(table.num_rows), lengths), at] = flat.field("n").to_numpy()
        shares = _shares(counts, np.maximum(table.column("below").to_numpy(), 1))
        block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b, value = [], [], []
        for k, at in enumerate(left):
            others = right[k + 1:] if i == j else right
            a.append(np.full(len(others), at))
            b.append(others)
            value.append(np.abs(shares[others] - shares[at]).sum(axis=1))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        names = table.column("source").combine_chunks()
        pick = lambda x: names.take(pa.array(join(x)))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(join(a)), pa.string()),
                         "a": pick(a), "b": pick(b), "value": pa.array(join(value), pa.int64())})

    found = rows.groupBy("lang", "wide", "i", "j").applyInArrow(distances, "lang string, a string, b string, value long")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    found = found.groupBy("lang", least.alias("a"), most.alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", "value", both.alias("p")).select("lang", "p.source", "p.item", "value")


def typical_terms(made: Audit) -> DataFrame:
    """``lang, source, item, value``: terms of a source whose share exceeds the language's."""
    key = ["lang", "shard", "slot"]
    whole = made.counts.groupBy(*key).agg(F.sum("n").alias("lang_n")).join(made.terms, key)
    rows = made.counts.join(whole, key).join(made.groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), above.alias("value")).filter("value > 0")


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources (part ``pair``) and the
    ``top`` typical terms of each source (part ``term``), by value descending, item ascending."""
    made = audit(docs, min_docs, round_bytes)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(made).withColumn("rank", F.row_number().over(order))
    terms = typical_terms(made).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents
), kept AS (
    SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ws)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30
), occ AS (
    SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(ws) AS t FROM d) GROUP BY ALL
), grp AS (
    SELECT DISTINCT lang, source FROM d
), v AS (
    SELECT g.lang, count(k.t) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k USING (lang) GROUP BY g.lang
), dense AS (
    SELECT g.lang, g.source, k.t, coalesce(o.c, 0)::HUGEINT AS c
    FROM grp g JOIN kept k USING (lang) LEFT JOIN occ o USING (lang, source, t)
), p AS (
    SELECT lang, source, t, c,
           1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, t) + 5)::HUGEINT)
             // (sum(c) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
    FROM dense JOIN v USING (lang)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
               FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) x
      ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, t AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""
