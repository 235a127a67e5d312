"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import number_rows

ROUNDS = 6
_M1, _M2, _STEP = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB),
                   np.uint64(0x9E3779B97F4A7C15))  # fixed values: the SplitMix64 mixer


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        start = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        return _mix(start + _STEP * np.arange(1, ROUNDS + 1, dtype=np.uint64))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, once) -> np.ndarray:
    """Apply ``once`` until every value lies below ``n`` again (under 4 times on average)."""
    x = once(np.asarray(x, dtype=np.uint64))
    out = np.flatnonzero(x >= n)
    while len(out):
        x[out] = once(x[out])
        out = out[x[out] >= n]
    return x


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of row numbers ``x`` (each below ``n``) under the permutation of ``range(n)``."""
    half = np.uint64(_half_bits(n))
    mask, keys = (np.uint64(1) << half) - np.uint64(1), _round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        return _walk(x, n, once)


def invert(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers whose images under :func:`permute` are ``y``."""
    half = np.uint64(_half_bits(n))
    mask, keys = (np.uint64(1) << half) - np.uint64(1), _round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys[::-1]:
            left, right = right ^ (_mix(left + k) & mask), left
        return (left << half) | right

    with np.errstate(over="ignore"):
        return _walk(y, n, once)


def locate(row_numbers: np.ndarray, n: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of rows, from their numbers alone; no table is read."""
    place = permute(row_numbers, n, seed)
    return (place % np.uint64(n_shards)).astype(np.int64), (place // np.uint64(n_shards)).astype(np.int64)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, n_shards: int, seed: int) -> np.ndarray:
    """Row numbers that lie at (shard, slot): the inverse of :func:`locate`."""
    place = np.asarray(slot, dtype=np.uint64) * np.uint64(n_shards) + np.asarray(shard, dtype=np.uint64)
    return invert(place, n, seed).astype(np.int64)


def shard_rows(rows: DataFrame, order: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to ``rows``.

    Rows are numbered in ``order``; the permuted number modulo ``n_shards`` is the shard,
    its quotient the slot. Shard sizes differ by at most one and slots have no gaps. The
    same rows, order, seed and shard count give the same layout on any cluster. Rows equal
    in all of ``order`` share their places in no particular order. An empty table gives no
    rows. Columns named ``row_number``, ``shard`` or ``slot`` are replaced.
    """
    numbered = number_rows(rows.drop("row_number", "shard", "slot"), [], order, "row_number")
    n = numbered.count()

    @F.pandas_udf("struct<shard int, slot long>")
    def place(numbers: pd.Series) -> pd.DataFrame:
        shard, slot = locate(numbers.to_numpy(), n, n_shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return numbered.withColumn("_at", place("row_number")).select(
        *numbered.columns, F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 0,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, row_number, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: no bytes, crc32 of nothing). Rows
    are numbered by id, then crc32, then size; a null id sorts first. Other columns of
    ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], n_shards, seed)
