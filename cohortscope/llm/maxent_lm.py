"""Hashed maximum-entropy language model with class-factored softmax.

Every token has an output unit: the most frequent tokens one of their own, all others a
bucket by word ending. Units come in classes, so
``P(token | past) = P(class | past) * P(unit | class, past) * P(token | unit)``
sums to one over all tokens. The first two factors are log-linear in hashed features of the
past (the last unit, the last two as a pair, the one before the last as a skip); the third is
the token's smoothed share of its bucket. Weights are learned by distributed gradient
updates and averaged; documents are scored in sparse numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import stored
from cohortscope.llm.words import SPACED, blocks, give_back, lean, no_nulls, words_of

CLASSES, MEMBERS = 32, 32
UNITS = CLASSES * MEMBERS
OWN = UNITS // 2  # units of single tokens; unit 0 is the end of a text
BUCKETS = UNITS - OWN
CLASS_ROWS, MEMBER_ROWS = 1 << 14, 1 << 15  # hashed weight rows of the two softmaxes
PAST = UNITS  # stands for what comes before a text
CHUNK = 1 << 13  # weights that are averaged together
STEP = 4_096  # tokens of one gradient update
LIMIT = 60.0  # scores are cut to +-LIMIT, so their exponentials never overflow
RATE = 0.5
LEAST_TRAINERS, TRAINER_BLOCKS = 256, 16

_BLOCK = ("block long, ids array<long>, held array<boolean>, firsts array<int>, words binary, "
          "terms array<string>, trained array<long>, buckets array<int>")


def bucket_of(terms: pa.Array) -> np.ndarray:
    """Bucket of a token that has no unit of its own, from its last two letters and whether a
    stop follows."""
    bare = pc.utf8_rtrim(terms, ".,;:!?")
    stop = pc.not_equal(pc.binary_length(bare), pc.binary_length(terms))
    ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, -2), pc.if_else(stop, ".", ""), " ")
    coded = ends.dictionary_encode()
    buckets = np.array([int.from_bytes(_digest(e), "little") % BUCKETS for e in coded.dictionary.to_pylist()], np.int64)
    return buckets[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()


def token_blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """The corpus as blocks of about 8 MB: words as numbers of the block's own vocabulary."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text"):
            firsts, words, terms = words_of(no_nulls(batch.column("text")), SPACED)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            of_training = np.repeat(~held, np.diff(firsts))
            trained = np.bincount(words[of_training], minlength=len(terms)).astype(np.int64)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                one(held, pa.bool_()), one(firsts.astype(np.int32), pa.int32()),
                pa.array([words.astype("<i4").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                one(trained, pa.int64()), one(bucket_of(terms).astype(np.int32), pa.int32()),
            ], ["block", "ids", "held", "firsts", "words", "terms", "trained", "buckets"])
            block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(cut, _BLOCK), "token-blocks")


@dataclass(frozen=True)
class Corpus:
    """Token blocks and counts: ``vocabulary`` (term, c, unit), training tokens and types."""

    blocks: DataFrame
    vocabulary: DataFrame
    tokens: int
    types: int
    ends: int
    own: dict[str, int]
    bucket_mass: np.ndarray  # per bucket: counts + types + 1, the share of an unseen token


def count_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Count every training token. The table of counts stays distributed; the driver gets the
    ``OWN`` most frequent tokens and one sum a bucket."""
    made = token_blocks(docs, held_out, id_col, text_col)
    rows = made.select(F.explode(F.arrays_zip("terms", "trained", "buckets")).alias("t"))
    counts = stored(rows.select("t.terms", "t.trained", "t.buckets").filter("trained > 0").groupBy("terms").agg(
        F.sum("trained").alias("c"), F.min("buckets").alias("bucket")).withColumnRenamed("terms", "term"), "counts")
    top = counts.orderBy(F.desc("c"), "term").limit(OWN - 1).collect()
    own = {r["term"]: k + 1 for k, r in enumerate(top)}
    mass = np.ones(BUCKETS)
    words = types = 0
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        mass[r["bucket"]] += r["c"] + r["n"]
        words, types = words + r["c"], types + r["n"]
    for r in top:
        mass[r["bucket"]] -= r["c"] + 1
    ends = made.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    spark = docs.sparkSession
    units = spark.createDataFrame([(t, u) for t, u in own.items()], "own_term string, own_unit int")
    # Broadcast: at most OWN - 1 rows.
    vocabulary = counts.join(F.broadcast(units), F.col("term") == F.col("own_term"), "left").select(
        "term", "c", F.coalesce("own_unit", F.col("bucket") + OWN).cast("int").alias("unit"))
    return Corpus(made, vocabulary, words + ends, types + (1 if ends else 0), ends, own, mass)


def _past(units: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last unit and the one before it, at every token of texts that start at ``firsts``."""
    last = np.concatenate([[PAST], units[:-1]])
    before = np.concatenate([[PAST, PAST], units[:-2]])[:len(units)]
    starts = firsts[:-1]
    last[starts] = PAST
    before[starts] = PAST
    before[starts[starts + 1 < firsts[1:]] + 1] = PAST
    return last, before


def _hashed(a: np.ndarray, b: np.ndarray | int, size: int) -> np.ndarray:
    mixed = (a.astype(np.uint32) * np.uint32(2654435761)) ^ (np.asarray(b).astype(np.uint32) * np.uint32(2246822519))
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(3266489917)) >> np.uint32(8)).astype(np.int64) % size


def _class_rows(last: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    single = UNITS + 1
    pair = 2 * single + _hashed(last, before + 7, CLASS_ROWS - 2 * single)
    return [last, single + before, pair]


def _member_rows(last: np.ndarray, before: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    rest = MEMBER_ROWS - CLASSES
    return [cls, CLASSES + _hashed(last * CLASSES + cls, 1, rest), CLASSES + _hashed(before * CLASSES + cls, 2, rest)]


def _scores(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    score = weights[rows[0]]
    for r in rows[1:]:
        score += weights[r]
    return np.clip(score, -LIMIT, LIMIT, out=score)


def _softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    share = _scores(weights, rows)
    np.exp(share, out=share)
    share /= (share @ np.ones(share.shape[1], np.float32))[:, None]
    return share


def _log_softmax_at(weights: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    score = _scores(weights, rows)
    picked = score[np.arange(len(target)), target].astype(np.float64)
    np.exp(score, out=score)
    return picked - np.log((score @ np.ones(score.shape[1], np.float32)).astype(np.float64))


class _Learner:
    """Gradient updates of one task, with a step size a row that falls as it is used."""

    def __init__(self, classes: np.ndarray, members: np.ndarray):
        self.weights = [classes.copy(), members.copy()]
        self.used = [np.full(len(classes), 1e-3, np.float32), np.full(len(members), 1e-3, np.float32)]
        self.tokens = 0

    def _descend(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows)
        found = rows[order]
        heads = np.flatnonzero(np.diff(found, prepend=-1))
        sums = np.add.reduceat(grad[order], heads, axis=0)
        at = found[heads]
        self.used[which][at] += (sums ** 2).mean(axis=1)
        self.weights[which][at] -= (RATE / np.sqrt(self.used[which][at]))[:, None] * sums

    def learn(self, units: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        cls, member = units // MEMBERS, units % MEMBERS
        for which, rows, target in ((0, _class_rows(last, before), cls), (1, _member_rows(last, before, cls), member)):
            grad = _softmax(self.weights[which], rows)
            grad[np.arange(len(target)), target] -= 1
            for r in rows:
                self._descend(which, r, grad)
        self.tokens += len(units)


def _units_of_block(block, k: int, local_units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of all tokens with an end after each text, starts of texts and the end, word
    number or -1) of row ``k`` of a batch or table of blocks."""
    words = np.frombuffer(block.column("words")[k].as_buffer(), "<i4")
    firsts = block.column("firsts")[k].values.to_numpy().astype(np.int64)
    shift = np.arange(len(firsts))
    at = np.insert(words.astype(np.int64), firsts[1:], -1)
    units = np.where(at < 0, 0, local_units[at] if len(local_units) else 0)
    return units, firsts + shift, at


@dataclass(frozen=True)
class Weights:
    classes: np.ndarray
    members: np.ndarray


def trainers_for(blocks: int) -> int:
    """Trainers of a corpus of so many blocks: a trainer learns from 16 blocks (some 128 MB of
    text) once there are more than ``LEAST_TRAINERS`` such pieces, so training spreads as the
    corpus grows."""
    return max(LEAST_TRAINERS, -(-blocks // TRAINER_BLOCKS))


def train_weights(corpus: Corpus, trainers: int | None = None, rounds: int = 1) -> Weights:
    """Learn the weights from every training token.

    In each round every trainer (a task; at most ``trainers``, by default :func:`trainers_for`
    the corpus) starts from the shared weights
    and makes gradient updates over its blocks; the results are averaged by tokens, piece by
    piece, in as many groups as there are pieces. What a trainer sends is the size of the
    model; what the driver gets is one model.
    """
    spark = corpus.blocks.sparkSession
    shape = (CLASS_ROWS * MEMBERS, MEMBER_ROWS * MEMBERS)
    flat = np.zeros(sum(shape), np.float32)
    own = pa.array(list(corpus.own), pa.string())  # in order of their units, from 1
    if trainers is None:
        trainers = trainers_for(corpus.blocks.count())
    rows = corpus.blocks.select("held", "firsts", "words", "terms", "buckets").coalesce(trainers)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        @lean
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = shared.value
            learner = _Learner(start[:shape[0]].reshape(CLASS_ROWS, CLASSES), start[shape[0]:].reshape(MEMBER_ROWS, MEMBERS))
            for batch in batches:
                for k in range(batch.num_rows):
                    units = OWN + batch.column("buckets")[k].values.to_numpy().astype(np.int64)
                    found = pc.fill_null(pc.index_in(batch.column("terms")[k].values, value_set=own), -1).to_numpy()
                    units = np.where(found >= 0, found + 1, units)
                    token, firsts, _ = _units_of_block(batch, k, units)
                    last, before = _past(token, firsts)
                    held = batch.column("held")[k].values.to_numpy(zero_copy_only=False)
                    use = np.flatnonzero(np.repeat(~held, np.diff(firsts)))
                    for a in range(0, len(use), STEP):
                        part = use[a:a + STEP]
                        learner.learn(token[part], last[part], before[part])
            if learner.tokens:
                found = np.concatenate([w.ravel() for w in learner.weights])
                pieces = [found[a:a + CHUNK].astype(np.float16).tobytes() for a in range(0, len(found), CHUNK)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([learner.tokens] * len(pieces), pa.int64()),
                    pa.array(pieces, pa.binary())], ["piece", "tokens", "weights"])

        def average(table: pa.Table) -> pa.Table:
            tokens = table.column("tokens").to_numpy().astype(np.float64)
            total = np.zeros(0)
            for t, w in zip(tokens, table.column("weights").to_pylist()):
                part = np.frombuffer(w, np.float16).astype(np.float64) * (t / tokens.sum())
                total = part if not len(total) else total + part
            return pa.Table.from_arrays([table.column("piece")[:1], pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                                        names=["piece", "weights"])

        sent = rows.mapInArrow(learn, "piece int, tokens long, weights binary")
        for r in sent.groupBy("piece").applyInArrow(average, "piece int, weights binary").collect():
            part = np.frombuffer(r["weights"], np.float32)
            flat = flat.copy()
            flat[r["piece"] * CHUNK:r["piece"] * CHUNK + len(part)] = part
        shared.unpersist()
    return Weights(flat[:shape[0]].reshape(CLASS_ROWS, CLASSES), flat[shape[0]:].reshape(MEMBER_ROWS, MEMBERS))


def score_corpus(corpus: Corpus, weights: Weights) -> DataFrame:
    """Score every text of the corpus: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` (log10).

    A block's vocabulary is joined with the counts term by term, so no table of counts is
    ever held in one place; its rows then meet the block's words in one group of bounded
    size.
    """
    spark = corpus.blocks.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    total, mass, ends = corpus.tokens + corpus.types + 1, corpus.bucket_mass, corpus.ends
    n_train = corpus.tokens
    words = corpus.blocks.select("block", F.posexplode("terms").alias("local", "term"))
    known = words.join(corpus.vocabulary, "term").select(F.col("block").alias("at"), "local", "c", "unit")

    def score(block: pa.Table, counted: pa.Table) -> pa.Table:
        model = shared.value
        units = OWN + block.column("buckets")[0].values.to_numpy().astype(np.int64)
        c = np.zeros(len(units))
        local = counted.column("local").to_numpy()
        c[local] = counted.column("c").to_numpy()
        units[local] = counted.column("unit").to_numpy()
        inner = np.where(units < OWN, 0.0, np.log10((c + 1) / mass[np.maximum(units - OWN, 0)]))
        base = np.log10((c + 1) / total)
        token, firsts, at = _units_of_block(block, 0, units)
        last, before = _past(token, firsts)
        end = at < 0
        value = np.where(end, 0.0, inner[at] if len(inner) else 0.0)
        plain = np.where(end, np.log10((ends + 1) / total), base[at] if len(base) else 0.0)
        seen = np.where(end, ends > 0, (c > 0)[at] if len(c) else False)
        for a in range(0, len(token), STEP):
            u, x, y = token[a:a + STEP], last[a:a + STEP], before[a:a + STEP]
            cls = u // MEMBERS
            outer = _log_softmax_at(model.classes, _class_rows(x, y), cls)
            outer += _log_softmax_at(model.members, _member_rows(x, y, cls), u % MEMBERS)
            value[a:a + STEP] += outer / np.log(10)
        starts, n = firsts[:-1], np.diff(firsts)
        give_back()
        return pa.Table.from_arrays([
            block.column("ids")[0].values, block.column("held")[0].values, pa.array(n),
            pa.array(np.add.reduceat(seen.astype(np.int64), starts)), pa.array(np.full(len(n), n_train, np.int64)),
            pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat(value, starts))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return corpus.blocks.select("block", "ids", "held", "firsts", "words", "buckets").groupBy("block").cogroup(
        known.groupBy("at")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows of ``docs`` that are not ``held_out`` and score all rows.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end a text; a null
    or empty text is an end only. Repeated rows count as often as they occur; a null id is
    scored like any. Without training rows all counts are 0 and the model is uniform. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    corpus = count_corpus(docs, held_out, id_col, text_col)
    return score_corpus(corpus, train_weights(corpus))
