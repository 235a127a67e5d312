"""Token ids as Parquet list columns that support selective reads.

A token table has one row per document: ``doc_id, part, part_start, n_tokens, ids``. Rows
ascend over the files, ``part`` is the number of the file's task and ``part_start`` the ids
of the same part before the document, so metadata reads never touch the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortscope.llm.words import blocks, lean, no_nulls, ragged, split

END_ID = 2
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ENCODE_CHUNKS = 20_000  # chunks handed to the tokenizer at a time
CACHE_CHUNKS = 1_000_000  # distinct chunks a Python worker remembers before it starts afresh

# Ids fit two bytes as dictionary indices; the dictionary of 49k ids takes 200 kB a row group.
# Pages of at most 1000 documents with min/max in the page index let a reader skip to a doc_id.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
}


class ChunkEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never span white space.

    Texts are cut at white space, and between a letter and a final full stop or comma; each
    distinct chunk is encoded once and remembered. A chunk of letters only is one pre-token,
    so it goes to the tokenizer in its normal form without the steps that would find that
    out. A text that holds the start of a special token ("<|") is encoded as it stands. All
    ways give the ids that encoding the whole text gives; a tokenizer of another kind is
    used on whole texts only.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.words = Tokenizer(self.tokenizer.model)  # for a word that is one pre-token in normal form
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_chunk = self._chunks_alike()
        self._forget()

    def _chunks_alike(self) -> bool:
        """Whether the tokenizer lower-cases and drops white space, as the chunk way needs."""
        probe = "Ab, cD.\nef  x1.y é. "
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        cut = [i for c in "ab , cd . ef x1.y é .".split() for i in self.tokenizer.encode(c, add_special_tokens=False).ids]
        return whole == cut

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids in a row) of chunks not met before."""
        word = np.zeros(len(chunks), bool)
        forms = list(chunks)
        for k, c in enumerate(chunks):
            if c.isalpha() and "Σ" not in c and (c.isascii() or is_normalized("NFC", c)):
                low = c.lower()
                if low.isalpha():
                    word[k], forms[k] = True, low
        ids: list[list[int]] = [[]] * len(chunks)
        for tokenizer, picked in ((self.words, np.flatnonzero(word)), (self.tokenizer, np.flatnonzero(~word))):
            for a in range(0, len(picked), ENCODE_CHUNKS):
                part = picked[a:a + ENCODE_CHUNKS].tolist()
                for k, e in zip(part, tokenizer.encode_batch_fast([forms[k] for k in part], add_special_tokens=False)):
                    ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of distinct chunks in the store of known ones, which takes up new ones."""
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        found = pc.index_in(chunks, value_set=self.known)
        new = pc.is_null(found)
        fresh = chunks.filter(new)
        sizes, ids = self._encode_new(fresh.to_pylist())
        number = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        number[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids of all texts in a row), the end id after each text."""
        odd = np.ones(len(texts), bool) if not self.by_chunk else \
            pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), r"(\pL)([.,])( |\n|$)", r"\1 \2\3")
        firsts, words = split(plain)
        coded = words.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        size = self.sizes[number]
        ids = self.ids[ragged(self.starts[number], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[firsts]
        sizes = np.diff(upto) + 1
        whole = np.full(len(ids) + len(texts), END_ID, np.int32)
        place = np.ones(len(whole), bool)
        place[np.cumsum(sizes) - 1] = False
        whole[place] = ids
        ids = whole
        if odd.any():
            pieces = np.split(ids, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(odd):
                own = self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids
                pieces[k] = np.array([*own, END_ID], np.int32)
            sizes, ids = np.array([len(p) for p in pieces], np.int64), np.concatenate(pieces)
        return sizes, ids


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(file: str) -> ChunkEncoder:
    if file not in _encoders:
        _encoders[file] = ChunkEncoder(file)
    return _encoders[file]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, order: list | None = None,
                 id_col: str = "doc_id", text_col: str = "text",
                 options: dict[str, str] | None = None) -> DataFrame:
    """Encode every whole text and write the token table to ``path``; returns it as read back.

    ``order`` (columns of ``docs``; default: the id, then the text) is the order of the
    stream; rows are range-partitioned and sorted on it. Null texts are empty: only the end
    id. A null id sorts first. Rows that repeat an id are rows of their own. Other columns
    of ``docs`` are read only if ``order`` names them. An empty table writes an empty one.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[c.alias(f"_o{k}") if not isinstance(c, str) else F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])])
    keys = [f"_o{k}" for k in range(len(order or []))] + ["doc_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", 4 << 20):
            sizes, ids = encoder.encode(no_nulls(batch.column("text")))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)),
                pa.array(start + ends - sizes), pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
            ], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1])

    rows.mapInArrow(encode, SCHEMA).write.options(**{**WRITE_OPTIONS, **(options or {})}).parquet(path)
    return read_tokens(docs.sparkSession, path)


def stored_order(docs: DataFrame) -> list:
    """Columns that sort ``docs``, as read from Spark's Parquet files, in the order written.

    A table that was not read from files has no such order; its id decides.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return ["doc_id"]
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("int"), name, F.col("_metadata.row_index")]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token table at ``path``."""
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(tokens: DataFrame) -> DataFrame:
    """``part, before``: ids in all earlier parts. Reads two metadata columns, one row a part."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """Read a token table back: ``doc_id, start, n_tokens, ids_crc32`` of what the files hold."""

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"), batch.column("part_start"),
                pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()),
            ], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    read = tokens.select("doc_id", "part", "part_start", "ids").mapInArrow(
        digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    # Broadcast: one row of two numbers per written part.
    return read.join(F.broadcast(part_starts(tokens)), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
