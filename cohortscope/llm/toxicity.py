"""Toxicity by noisy-channel deobfuscation: restore the text, then score the restored words.

A token that looks disguised becomes a lattice of readings: look-alike symbols may stand for
letters, a run of one letter for one or two, a separator inside a word for nothing, single
letters set apart for a word. The Viterbi path under a character trigram model of the corpus
and the channel's costs is the restored reading. A logistic model over the restored words
and their beginnings gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import stored
from cohortscope.llm.words import SPACED, blocks, lean, no_nulls, words_of

# Letters that a symbol can stand for. Fixed values.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h",
    "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
SEPARATORS = ".-_*~^`'·​‌‍­"
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"  # 0: boundary, last: other
SIZE = len(ALPHABET) + 2
_LETTER = {c: k + 1 for k, c in enumerate(ALPHABET)}
_EDGE = ".,;:?!%&*#\"'()[]{}<>«»“”‘’…-_~`^|/\\="

# Costs of the channel, in natural logarithms.
SUBSTITUTE, COLLAPSE, SKIP, MASK = 0.7, 3.0, 0.5, 3.5

FEATURE_BITS = 18
BLOCK_BYTES = 4 << 20
PREFIXES = (4, 5)

_LETTERS = re.compile(r"[^\W\d_]")
_SYMBOLS = re.compile(r"[0-9@$!|+(<{#€£¡*]")
_MARKS = re.compile(r"[0-9@$!|+(<{#€£¡*._~^`​-‍­·-]")
_FOREIGN = "".join(c for c in LOOKALIKES if c.isalpha() and not c.isascii())
_CYRILLIC = re.compile(rf"[а-я{_FOREIGN}]")
_UNLIKELY = re.compile(rf"([^\W\d_])\1|[{_FOREIGN}]")  # a doubled letter or a look-alike letter
_REPEATED = re.compile(r"(.)\1\1")
_NOISE = re.compile(r"([^\w\s])\1{2,}")  # runs of one symbol, as in decorations
_JOINTS = re.compile(r"[._~·-]+")  # separators that may also join whole words
_PLAIN_EDGE = ".,;:?!\"'()%&#"
KEPT_READINGS, KEPT_LENGTH = 1 << 17, 40  # readings a task remembers, and the longest token among them
_SPACED = re.compile(r"(?<!\S)[^\s.,;:]((?:[ ._*-][^\s.,;:]){2,})(?![^\s.,;:!?])")


@dataclass(frozen=True)
class CharModel:
    """Natural-log trigram probabilities, ``SIZE`` cubed."""

    logp: np.ndarray

    @cached_property
    def table(self) -> list[float]:
        return self.logp.ravel().tolist()

    @cached_property
    def readings(self) -> dict[str, str]:
        return {}

    def read(self, token: str) -> str:
        """The token's reading as one word and, where separators join longer pieces, theirs too.

        Readings of short tokens are remembered.
        """
        said = self.readings.get(token)
        if said is None:
            said = restore(token, self)
            pieces = [p for p in _JOINTS.split(token) if p]
            if sum(len(p) > 1 for p in pieces) > 1:
                said = " ".join([said, *[restore(p, self) for p in pieces if len(p) > 1]])
            if len(token) <= KEPT_LENGTH:
                if len(self.readings) >= KEPT_READINGS:
                    self.readings.clear()
                self.readings[token] = said
        return said


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters with two boundaries before and one after each word, word number of each)."""
    lengths = np.array([len(w) for w in words], np.int64) + 3
    raw = "".join("\0\0" + w + "\0" for w in words).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    table = np.full(0x110000, SIZE - 1, np.uint8)
    table[0] = 0
    for c, k in _LETTER.items():
        table[ord(c)] = k
    return table[codes].astype(np.int64), np.repeat(np.arange(len(words)), lengths)


def _bare(word: Column) -> Column:
    """A word with each run of a letter as one and look-alike letters as what they look like."""
    latin = "".join(LOOKALIKES[c][0] for c in _FOREIGN)
    return F.regexp_replace(F.translate(word, _FOREIGN, latin), r"(.)\1+", "$1")


def train_char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character trigrams of the words of ``docs`` that are letters only, smoothed.

    A word with a doubled or look-alike letter teaches nothing if the corpus also holds it
    bare (``iiddioott`` where there is ``idiot``): else a disguise that is repeated often
    enough would teach the model to take it as spelt. So disguises read alike however often
    they occur. Words are counted where they lie and added up by a shuffle on the word; counts
    are exact, so the layout of the rows changes nothing. At most ``SIZE`` cubed sums come to the
    driver, whatever the corpus. No rows: uniform.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            _, index, terms = words_of(no_nulls(batch.column("text")), SPACED)
            words = pc.utf8_lower(pc.utf8_trim(terms, _EDGE))
            kept = np.flatnonzero(pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False))
            weight = np.bincount(index, minlength=len(terms))[kept]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(kept)), pa.array(weight)], ["word", "n"])

    @lean
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            weight = batch.column("n").to_numpy()
            letters, owner = _coded(batch.column("word").to_pylist())
            whole = owner[2:] == owner[:-2]
            gram = (letters[:-2] * SIZE + letters[1:-1]) * SIZE + letters[2:]
            np.add.at(total, gram[whole], weight[owner[2:][whole]])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    words = stored(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")), "words")
    odd = words.filter(F.col("word").rlike("(?U)" + _UNLIKELY.pattern)).select(F.col("word").alias("odd"), _bare(F.col("word")).alias("bare"))
    told = odd.join(words.select(F.col("word").alias("bare")), "bare", "left_semi").select(F.col("odd").alias("word"))
    grams = stored(words.join(told, "word", "left_anti").mapInArrow(spell, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")), "letters")
    counts = np.zeros(SIZE ** 3)
    for r in grams.collect():
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return CharModel(np.log(p3).astype(np.float32))


def _readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of a symbol what it may stand for, with the cost."""
    lattice = []
    for symbol, run in groupby(token):
        n = len(list(run))
        options: list[tuple[str, float]] = []
        once = COLLAPSE if n == 2 else 0.0  # two are seldom meant as one; three or more often are
        for letter, price in [(symbol, 0.0)] * (symbol in _LETTER) + [(c, SUBSTITUTE) for c in LOOKALIKES.get(symbol, "")]:
            options += [(letter, price)] if n == 1 else [(letter * 2, price), (letter, price + once)]
        if symbol in SEPARATORS or (symbol in "!|+(<{#" and n < 4):
            options += [("", SKIP)]
        if symbol == "*" and n == 1:
            options += [(c, MASK) for c in ALPHABET[:26]]
        lattice.append(options or [("\0", 0.0)])
    return lattice


def restore(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest reading of a disguised token; with ``spaced`` words may be parted.

    Symbols without a reading stay as breaks. The literal letters are one of the readings.
    """
    logp = model.table
    # State: the last two letters. A path is its cost and its last character, linked to those before.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def step(a: int, b: int, cost: float, path: tuple | None, out: str) -> tuple[int, int, float, tuple | None]:
        for c in out:
            k = 0 if c in " \0" else _LETTER.get(c, SIZE - 1)
            cost += logp[(a * SIZE + b) * SIZE + k]
            a, b = (b, k) if k else (0, 0)
            path = (path, c if k else " ")
        return a, b, cost, path

    for options in _readings(token):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in paths.items():
            starts = [(a, b, cost, path)]
            if spaced and path and path[1] != " ":
                starts.append(step(a, b, cost, path, " "))
            for x, y, c, t in starts:
                for out, price in options:
                    p, q, total, said = step(x, y, c - price, t, out)
                    if (p, q) not in new or new[p, q][0] < total:
                        new[p, q] = (total, said)
        paths = new
    ends = [step(a, b, cost, path, " ")[2:] for (a, b), (cost, path) in paths.items()]
    best = max(cost for cost, _ in ends)
    return max(_spelt(path) for cost, path in ends if cost == best).strip()


def _spelt(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _disguised(word: str) -> bool:
    """Letters with marks behind them or symbols before them, Cyrillic letters, doubled
    letters: in linear time, and however often the word occurs."""
    letter, symbol = _LETTERS.search(word), _SYMBOLS.search(word)
    return bool(letter and _MARKS.search(word, letter.end()) or symbol and _LETTERS.search(word, symbol.end())
                or _CYRILLIC.search(word) or _UNLIKELY.search(word) or _REPEATED.search(word))


def _hash(words: list[str], salt: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int64)
    hashed = pd.util.hash_array(np.array([f"{salt}{w}" for w in words], dtype=object), categorize=False)
    return (hashed & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def _features(batch: pa.RecordBatch, model: CharModel) -> tuple[np.ndarray, np.ndarray, list[list[tuple[str, str]]]]:
    """(text number, feature) pairs, each once, and what was restored in each text."""
    texts = no_nulls(batch.column("text"))
    firsts, index, terms = words_of(texts, SPACED)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    seen = terms.to_pylist()
    clean = [w.strip(_EDGE).lower() for w in seen]
    read: dict[int, str] = {}
    for k, w in enumerate(clean):
        if w and (not w.isalpha() or w != seen[k].strip(_PLAIN_EDGE) or _UNLIKELY.search(w)):
            word = _NOISE.sub("", seen[k].lower()).strip(_PLAIN_EDGE)
            if _disguised(word):
                said = model.read(word)
                if said and said != w:
                    read[k] = said
    notes: list[list[tuple[str, str]]] = [[] for _ in range(len(texts))]
    extra_doc: list[int] = []
    extra: list[str] = []
    if read:
        held = np.zeros(len(seen), bool)
        held[list(read)] = True
        for at in np.flatnonzero(held[index]):
            k = int(index[at])
            notes[doc[at]].append((seen[k], read[k]))
            for w in read[k].split():
                extra_doc.append(int(doc[at]))
                extra.append(w)
    apart = pc.match_substring_regex(texts, r"(^|\s)[^\s.,;:]([ ._*-][^\s.,;:]){2,}").to_numpy(zero_copy_only=False)
    for d in np.flatnonzero(apart):
        for m in _SPACED.finditer(texts[int(d)].as_py().lower()):
            letters = re.sub(r"[ ._*-]", "", m.group(0))
            if len(letters) >= 3:
                said = restore(letters, model, spaced=True)
                notes[d].append((m.group(0), said))
                for w in said.split():
                    extra_doc.append(int(d))
                    extra.append(w)
    words = clean + extra
    columns = [_hash(words, 0)]
    owner = [np.concatenate([doc, np.array(extra_doc, np.int64)])]
    at = np.concatenate([index.astype(np.int64), np.arange(len(clean), len(words))])
    pairs = [owner[0] << FEATURE_BITS | columns[0][at]] if len(at) else []
    for p in PREFIXES:
        h = _hash([w[:p] for w in words], p)
        long = np.array([len(w) > p for w in words], bool)
        use = long[at] if len(at) else np.zeros(0, bool)
        if len(at):
            pairs.append(owner[0][use] << FEATURE_BITS | h[at[use]])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1), notes


@dataclass(frozen=True)
class ToxicityModel:
    chars: CharModel
    weights: np.ndarray
    bias: float


def _fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 500, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their smoothed log-odds.

    The log-odds are shrunk by support, so a word of one document says little; gradient
    steps with momentum on the scaled features then let strong words explain a label
    before words that merely occur beside them. Classes weigh alike.
    """
    weights = np.zeros(1 << FEATURE_BITS)
    if not len(rows) or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.0
        return weights.astype(np.float32), 20.0 * share - 10.0
    size = np.array([len(r) for r in rows])
    row, col = np.repeat(np.arange(len(rows)), size), np.concatenate(rows)
    n = np.bincount(col, minlength=1 << FEATURE_BITS)
    n1 = np.bincount(col, weights=labels[row], minlength=1 << FEATURE_BITS)
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    odds = np.log((n1 + 1) / (ones + 2)) - np.log((n - n1 + 1) / (zeros + 2))
    expected = np.log((n * ones / len(labels) + 1) / (ones + 2)) - np.log((n * zeros / len(labels) + 1) / (zeros + 2))
    odds = np.maximum(odds - expected, 0) * n / (n + 10)  # only what speaks for the label
    # Deviation beyond what chance gives a word that has nothing to do with the label.
    spread = np.sqrt(np.maximum(n, 1) * ones * zeros) / len(labels)
    odds[(n1 - n * ones / len(labels)) < 5 * spread] = 0
    value = odds[col]
    used = value > 0
    row, col, value = row[used], col[used], value[used]
    balance = np.where(labels == 1, 0.5 / ones, 0.5 / zeros)
    bias = speed_b = 0.0
    speed = np.zeros_like(weights)
    rate = 4.0 / max(1.0, np.bincount(row, weights=value ** 2, minlength=len(rows)).max() ** 0.5)
    for _ in range(rounds):
        ahead, ahead_b = weights + 0.9 * speed, bias + 0.9 * speed_b
        z = np.bincount(row, weights=value * ahead[col], minlength=len(rows)) + ahead_b
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.bincount(col, weights=value * err[row], minlength=len(weights)) + ridge * ahead
        speed, speed_b = 0.9 * speed - rate * grad, 0.9 * speed_b - rate * err.sum()
        weights, bias = weights + speed, bias + speed_b
    return (weights * odds).astype(np.float32), float(bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, chars: CharModel, per_class: int = 6000,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit the classifier on ``per_class`` labelled documents of either class at most.

    The bound is this parameter: the rows with the least hashed ids are taken, so the sample
    is the same everywhere. Null labels and labels without a document teach nothing; of
    several labels of a document the highest counts. Only labels of rows in ``docs`` are
    used. The sampled rows' feature numbers, not their texts, come to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    ids = docs.select(F.col(id_col).cast("long").alias("_have")).distinct()
    known = known.join(ids, F.col("_id") == F.col("_have"), "left_semi")
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # Broadcast: at most 2 * per_class rows of two numbers.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "y")

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            doc, feature, _ = _features(batch, chars)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            found = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y")], ["found", "y"])

    sample = rows.mapInArrow(extract, "found binary, y int").collect()
    distinct = sorted({(r["y"], bytes(r["found"])) for r in sample})  # copies teach once
    weights, bias = _fit([np.frombuffer(found, "<i4").astype(np.int64) for _, found in distinct],
                         np.array([y for y, _ in distinct], dtype=np.int64))
    return ToxicityModel(chars, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, carry: list[str | Column],
                   text_col: str = "text") -> DataFrame:
    """``carry`` columns (simple types) with ``score`` (0 to 1) and ``restored`` of every whole text.

    ``restored`` lists the disguised tokens as ``seen`` and ``read``. Null, empty and wordless
    texts get the score of no features. Rows that repeat an id or a text are scored one by one and
    alike: a score depends on the text and the model only. Carry names must not be ``text``, ``score`` or
    ``restored``. An empty table gives no rows.
    """
    rows = docs.select(*carry, F.col(text_col).alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    pair = pa.list_(pa.struct([("seen", pa.string()), ("read", pa.string())]))

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            doc, feature, notes = _features(batch, model.chars)
            z = np.bincount(doc, weights=model.weights[feature], minlength=batch.num_rows) + model.bias
            said = [[{"seen": a, "read": b} for a, b in n] for n in notes]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(said, pair)],
                [*[f.name for f in kept], "score", "restored"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["score double", "restored array<struct<seen:string,read:string>>"])
    return rows.mapInArrow(score, schema)
