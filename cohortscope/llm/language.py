"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (made from its code point and a seed, so no
table is stored). A letter n-gram is the product of its letters' vectors, each rotated by
its place; a document is the sum of its n-grams' vectors; a language's prototype is the sum
of its training documents. A document gets the language whose prototype has the highest
cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.words import blocks, lean, no_nulls

UNDETERMINED = "und"
MAX_LANGUAGES = 4096
_ROWS = 1 << 13  # n-gram vectors held at a time (32 MB at 1024 dimensions)
_BLOCK_BYTES = 1 << 20  # text taken up at a time; its letters need some 50 times as much memory


@dataclass(frozen=True)
class Profiles:
    """Prototypes: ``languages`` in order, ``vectors`` (language x dim) of length one each."""

    languages: list[str]
    vectors: np.ndarray
    dim: int
    n: int
    seed: int


@lru_cache(maxsize=1 << 13)
def _letter(code: int, dim: int, seed: int) -> np.ndarray:
    bits = np.random.default_rng([seed, code]).integers(0, 2, dim, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


def _is_letter(code: int) -> bool:
    return unicodedata.category(chr(code))[0] in "LM"


def _ngrams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first n-gram of each text and the end, n-gram numbers, code points of each distinct
    n-gram, whether each text has a letter).

    Texts are in lower case; a run of other characters is one boundary (code 0), also
    before and after the text.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in lowered], dtype=np.int64)
    raw = ("\0" + "\0\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint32)
    present = np.zeros(0x110000, dtype=bool)
    present[codes] = True
    used = np.flatnonzero(present)
    letters = np.array([c for c in used.tolist() if c and _is_letter(c)], dtype=np.int64)
    number = np.zeros(0x110000, dtype=np.int32)
    number[letters] = np.arange(1, len(letters) + 1)
    symbols = number[codes]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[starts] = True
    symbols, doc = symbols[keep].astype(np.int64), doc[keep]
    base = len(letters) + 1
    m = max(0, len(symbols) - n + 1)
    gram = np.zeros(m, dtype=np.int64)
    for k in range(n):
        gram = gram * base + symbols[k:k + m]
    whole = doc[:m] == doc[n - 1:n - 1 + m]
    gram, doc = gram[whole], doc[:m][whole]
    if base ** n <= 1 << 24:
        seen = np.zeros(base ** n, dtype=bool)
        seen[gram] = True
        distinct = np.flatnonzero(seen)
        table = np.zeros(base ** n, dtype=np.int32)
        table[distinct] = np.arange(len(distinct))
        gram = table[gram]
    else:
        distinct, gram = np.unique(gram, return_inverse=True)
    firsts = np.searchsorted(doc, np.arange(len(texts) + 1))
    back = np.concatenate([[0], letters])
    parts = np.stack([back[distinct // base ** (n - 1 - k) % base] for k in range(n)], axis=1) \
        if len(distinct) else np.zeros((0, n), np.int64)
    proper = np.array([c != 0 and unicodedata.category(chr(c))[0] == "L" for c in back.tolist()])
    has = np.zeros(len(texts), dtype=bool)
    has[doc_of_letters(symbols, keep, sizes, proper)] = True
    return firsts, gram, parts, has


def doc_of_letters(symbols: np.ndarray, keep: np.ndarray, sizes: np.ndarray, proper: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which a letter (not just a mark) occurs."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[keep]
    return np.unique(doc[proper[symbols]])


def _vectors(parts: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors of n-grams: the product of the letters' vectors, rotated by place."""
    n = parts.shape[1]
    out = np.ones((len(parts), dim), dtype=np.int8)
    for k in range(n):
        codes, at = np.unique(parts[:, k], return_inverse=True)
        rows = np.stack([np.roll(_letter(c, dim, seed), n - 1 - k) for c in codes.tolist()])
        out *= rows[at]
    return out.astype(np.float32)


def _bundle(firsts: np.ndarray, gram: np.ndarray, parts: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Document vectors: sums of their n-grams' vectors."""
    out = np.zeros((len(firsts) - 1, dim), dtype=np.float32)
    for low in range(0, len(parts), _ROWS):
        rows = _vectors(parts[low:low + _ROWS], dim, seed)
        one = len(parts) <= _ROWS
        for d, (a, b) in enumerate(zip(firsts, firsts[1:])):
            own = gram[a:b] if one else gram[a:b][(gram[a:b] >= low) & (gram[a:b] < low + _ROWS)] - low
            counts = np.bincount(own, minlength=1)
            found = np.flatnonzero(counts)
            if len(found):
                out[d] += counts[found].astype(np.float32) @ rows[found]
    return out


def train_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                   dim: int = 1024, n: int = 3, seed: int = 11) -> Profiles:
    """Bundle the prototypes from all rows of ``docs`` with a language and a text.

    Every task adds up its rows' n-gram vectors per language; the sums meet by language and
    dimension. Only the prototypes, ``dim`` numbers a language, come to the driver; over
    ``MAX_LANGUAGES`` languages raise ValueError. No rows give no prototypes.
    """

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in blocks(batches, "text", _BLOCK_BYTES):
            firsts, gram, parts, _ = _ngrams(no_nulls(batch.column("text")).to_pylist(), n)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            size, weights = len(parts), {}
            for lang in sorted(set(langs.tolist())):
                counts = np.zeros(size, dtype=np.int64)
                for d in np.flatnonzero(langs == lang):
                    counts += np.bincount(gram[firsts[d]:firsts[d + 1]], minlength=size)
                weights[lang] = counts.astype(np.float32)
            for low in range(0, size, _ROWS):  # whole numbers below 2 ** 24: exact in 32 bits
                rows = _vectors(parts[low:low + _ROWS], dim, seed)
                for lang, counts in weights.items():
                    sums[lang] = sums.get(lang, 0.0) + (counts[low:low + _ROWS] @ rows).astype(np.float64)
        yield pa.RecordBatch.from_pydict(
            {"lang": list(sums), "v": [np.rint(v).astype(np.int64) for v in sums.values()]},
            schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(add, "lang string, v array<long>") \
        .select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")) \
        .limit(MAX_LANGUAGES + 1).collect()
    if len(whole) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    whole.sort(key=lambda r: r["lang"])
    vectors = np.array([[x["x"] for x in r["v"]] for r in whole], dtype=np.float64).reshape(len(whole), dim)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([r["lang"] for r in whole], (vectors / np.where(length > 0, length, 1)).astype(np.float32),
                    dim, n, seed)


def identify(docs: DataFrame, profiles: Profiles, carry: list[str] | list[Column],
             text_col: str = "text", text_in: str | None = None) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score`` of every row's whole text.

    ``text_in`` names a carried struct whose field ``text_col`` is the text, so that whole
    rows can be carried without sending their text twice.

    ``score`` is the best cosine (below 0: 0). Null texts, texts without a letter, and all
    texts if there are no prototypes get ``und`` and 0. Of equal cosines the language that
    sorts first wins. Carry names must not be ``_text``, ``lang_pred`` or ``score``.
    """
    rows = docs.select(*carry) if text_in else docs.select(*carry, F.col(text_col).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = pc.struct_field(whole.column(text_in), text_col) if text_in else whole.column("_text")
            carried = whole.select([f.name for f in kept])
            yield from judge(carried.append_column("_text", text))

    def judge(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.languages, UNDETERMINED], dtype=object)
        for batch in blocks([whole], "_text", _BLOCK_BYTES):
            firsts, gram, parts, has = _ngrams(no_nulls(batch.column("_text")).to_pylist(), profiles.n)
            best, cosine = np.full(len(has), len(names) - 1), np.zeros(len(has))
            if len(profiles.languages):
                made = _bundle(firsts, gram, parts, profiles.dim, profiles.seed)
                length = np.linalg.norm(made, axis=1)
                cos = (made @ profiles.vectors.T) / np.where(length > 0, length, 1)[:, None]
                best = np.where(has, cos.argmax(axis=1), best)
                cosine = np.where(has, np.clip(cos.max(axis=1).astype(np.float64), 0, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(names[best], pa.string()), pa.array(cosine)],
                [*[f.name for f in kept], "lang_pred", "score"])

    return rows.mapInArrow(score, schema)
