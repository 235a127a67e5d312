"""Splitting batches of texts into words with Arrow and numpy, whole batches at a time."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(function):
    """Decorator of a function over batches: memory goes back when its task ends."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def byte_table(is_word) -> np.ndarray:
    """256 bytes: A-Z in lower case, word bytes as they are, all others a space.

    ``is_word`` tells for a byte below 0x80 whether it belongs to words; the bytes of
    characters beyond ASCII always do.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for b in range(128):
        if not is_word(int(table[b])):
            table[b] = 32
    return table


# Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of texts with A-Z in lower case.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def _mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(table[raw]))


def no_nulls(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text and the end, all words) of texts whose words spaces part."""
    if not len(texts):
        return np.zeros(1, np.int64), pa.array([], pa.string())
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    firsts = lists.offsets.to_numpy().astype(np.int64)
    firsts -= firsts[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        firsts = np.concatenate([[0], np.cumsum(full)])[firsts]
        words = words.filter(pa.array(full))
    return firsts, words


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a batch: (first word of each text and the end, word numbers, distinct words)."""
    firsts, words = split(_mapped(texts, table)) if len(texts) else (np.zeros(1, np.int64), pa.array([], pa.string()))
    coded = words.dictionary_encode()
    return firsts, coded.indices.to_numpy(), coded.dictionary


def blocks(batches, text: str, max_bytes: int = 8 << 20):
    """Cut record batches into even pieces of about ``max_bytes`` of text (one long text: more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        parts = max(1, round(int(upto[-1]) / max_bytes))
        piece = np.maximum(upto - 1, 0) * parts // max(1, int(upto[-1]))
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of runs of the given sizes, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
