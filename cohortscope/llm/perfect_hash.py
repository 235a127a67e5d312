"""Minimal perfect hashes of sets of words, cut into shards, with the words stored beside them.

A shard holds a few hundred words. Its hash is hash-and-displace: words fall into small
buckets, largest bucket first each takes the smallest displacement that lands all its words
on free slots, and a bucket of one word names its slot outright. ``n`` words get the slots
0 to n - 1, one each. A word that is not in the set also gets some slot, so every lookup
compares the word with the one stored there: answers are exact.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PER_BUCKET = 4
TRIES = 64  # displacements tried at a time
SEED_OF_SHARDS = 42  # fixed: the seed of Spark's xxhash64
_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
# fixed values: the SplitMix64 mixer


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, displacement: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(hashes + displacement.astype(np.uint64) * _STEP) % np.uint64(n)
                if np.isscalar(n) else _mixed(hashes + displacement.astype(np.uint64) * _STEP) % n.astype(np.uint64)
                ).astype(np.int64)


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def shards_of(words: list[bytes], n_shards: int) -> np.ndarray:
    """Shard of each word: Spark's ``pmod(xxhash64(word), n_shards)``."""
    raw = np.fromiter((xxhash.xxh64_intdigest(w, SEED_OF_SHARDS) for w in words), np.uint64, len(words))
    return np.mod(raw.view(np.int64), np.int64(n_shards))


def buckets_for(n: int) -> int:
    return max(1, -(-n // PER_BUCKET))


def build(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacement of each bucket, slot of each word) of distinct words.

    A negative displacement ``-s - 1`` names slot ``s``. Seeds are tried until no two words
    share their 64-bit hash.
    """
    n = len(words)
    for seed in itertools.count():
        hashes = _hashes(words, seed)
        if len(np.unique(hashes)) == n:
            break
    m = buckets_for(n)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    first = np.cumsum(sizes) - sizes
    free, displaced, slot = np.ones(n, bool), np.zeros(m, np.int64), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[first[b]:first[b] + sizes[b]]
        for start in itertools.count(0, TRIES):
            tried = np.arange(start, start + TRIES)
            at = _slots(hashes[own][None, :], tried[:, None], n)
            lined = np.sort(at, axis=1)
            good = np.flatnonzero(free[at].all(axis=1) & (np.diff(lined, axis=1) > 0).all(axis=1))
            if len(good):
                break
        displaced[b], slot[own] = tried[good[0]], at[good[0]]
        free[at[good[0]]] = False
    alone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    displaced[alone], slot[order[first[alone]]] = -left - 1, left
    return seed, displaced, slot


@dataclass
class Shards:
    """Shards of one set, ready for lookups. Shard ``ids[k]`` of ``n_shards`` has the slots
    from ``first[k]`` on; ``words`` stand in slot order."""

    n_shards: int
    ids: np.ndarray
    seeds: np.ndarray
    sizes: np.ndarray
    displaced: np.ndarray
    words: pa.Array

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes
        self.buckets = np.array([buckets_for(int(n)) for n in self.sizes], np.int64)
        self.first_bucket = np.cumsum(self.buckets) - self.buckets

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Slot of each word, -1 for words that are not in the set."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.ids):
            return out
        raw = words.cast(pa.binary()).to_pylist()
        shard = shards_of(raw, self.n_shards)
        k = np.minimum(np.searchsorted(self.ids, shard), len(self.ids) - 1)
        here = np.flatnonzero(self.ids[k] == shard)
        k = k[here]
        hashes = np.zeros(len(here), np.uint64)
        for seed in np.unique(self.seeds[k]):
            own = np.flatnonzero(self.seeds[k] == seed)
            hashes[own] = _hashes([raw[i] for i in here[own]], int(seed))
        bucket = (hashes >> np.uint64(32)) % self.buckets[k].astype(np.uint64)
        moved = self.displaced[self.first_bucket[k] + bucket.astype(np.int64)]
        slot = np.where(moved < 0, -moved - 1, _slots(hashes, np.maximum(moved, 0), self.sizes[k])) + self.first[k]
        same = pc.equal(self.words.take(pa.array(slot)), words.take(pa.array(here))).to_numpy(zero_copy_only=False)
        out[here[same]] = slot[same]
        return out
