"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only)."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.llm.common import number_rows, run_path

CHUNK = 64  # blocks of a source whose places lie in one row of the plan
PIECE = 1 << 18  # blocks whose places are written together
LAST = 1 << 62  # the table of places holds longs: later deadlines (weights under 1e-18) are given as this


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


class Fluid:
    """The ideal stream: at each moment every source that is not used up flows at its weight
    over the weights of all that are not.

    In virtual time ``v`` a source has sent ``min(blocks, weight * v)``, so the slot of ``v`` is
    the sum of that over the sources: straight between the moments at which sources run out.
    All in whole numbers, made once from one sort of the sources.
    """

    def __init__(self, blocks: Mapping[str, int], whole: Mapping[str, int]):
        order = sorted(blocks, key=lambda s: (Fraction(blocks[s], whole[s]), s))
        self.whole = whole
        self.ends = [(blocks[s], whole[s]) for s in order]  # virtual end of each source, ascending
        self.near = [blocks[s] / whole[s] for s in order]
        self.sent, self.rate = [0], [sum(whole[s] for s in order)]
        for s in order:  # blocks of used-up sources, weight of the others
            self.sent.append(self.sent[-1] + blocks[s])
            self.rate.append(self.rate[-1] - whole[s])

    def phase(self, i: int, w: int) -> int:
        """Number of sources used up before the virtual time ``i / w``."""
        k = bisect_left(self.near, i / w)
        while k < len(self.ends) and self.ends[k][0] * w < i * self.ends[k][1]:
            k += 1
        while k and self.ends[k - 1][0] * w >= i * self.ends[k - 1][1]:
            k -= 1
        return k

    def released(self, s: str, i: int) -> tuple[int, float]:
        """Slot from which block ``i`` of a source may run, and the source's share there."""
        w = self.whole[s]
        k = self.phase(i, w)
        return self.sent[k] + self.rate[k] * i // w, w / self.rate[k]

    def due(self, s: str, i: int) -> int:
        """Slot before which block ``i`` of a source has to be done."""
        w = self.whole[s]
        k = self.phase(i + 1, w)
        return self.sent[k] - (-self.rate[k] * (i + 1) // w)


Place = tuple[str, int, int, int, int, float]  # source, block, slot, release, deadline, weight


def exact_places(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[Place]:
    """The schedule slot by slot: of the released blocks the earliest deadline runs.

    A block is released in the slot in which the ideal stream starts on it and due by the end
    of the slot in which that has sent it. Such windows always fit, and earliest deadline
    first keeps them all, so every source is less than one block from the ideal stream at
    any moment, sources that run out included. Holds one block of each source at a time.
    """
    blocks = {s: b for s, b in blocks.items() if b}
    fluid = Fluid(blocks, whole_weights({s: weights[s] for s in blocks})) if blocks else None
    waiting = [(0, s, 0, fluid.released(s, 0)[1]) for s in blocks]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int, float]] = []
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            start, s, i, share = heapq.heappop(waiting)
            heapq.heappush(ready, (fluid.due(s, i), s, i, start, share))
        due, s, i, start, share = heapq.heappop(ready)
        yield s, i, t, start, min(due, LAST), share
        if i + 1 < blocks[s]:
            start, share = fluid.released(s, i + 1)
            heapq.heappush(waiting, (start, s, i + 1, share))


_PLAN = T.StructType([
    T.StructField("_s", T.StringType()), T.StructField("_chunk", T.LongType()),
    T.StructField("_slot", T.ArrayType(T.LongType())), T.StructField("_release", T.ArrayType(T.LongType())),
    T.StructField("_deadline", T.ArrayType(T.LongType())), T.StructField("_weight", T.ArrayType(T.DoubleType())),
])
_ARROW = pa.schema([
    ("_s", pa.string()), ("_chunk", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("_slot", "_release", "_deadline")],
    ("_weight", pa.list_(pa.float64()))])


def _stored_plan(spark: SparkSession, places: Iterator[Place]) -> DataFrame:
    """The places as a table in the shared folder, a row for ``CHUNK`` blocks of a source.

    Written piece by piece: the driver holds ``PIECE`` places and one row of each source.
    """
    path = run_path(spark, "plan")
    opened: dict[str, tuple[int, array, array, array, array]] = {}
    full: list[tuple] = []
    wrote = False

    def write() -> None:
        made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), _ARROW)], schema=_ARROW)
        spark.createDataFrame(made, _PLAN).coalesce(1).write.mode("append").option("compression", "zstd").parquet(path)
        full.clear()

    for s, block, *place in places:
        if block % CHUNK == 0:
            if s in opened:
                full.append((s, *opened[s]))
            opened[s] = (block // CHUNK, array("q"), array("q"), array("q"), array("d"))
            if len(full) * CHUNK >= PIECE:
                write()
                wrote = True
        for column, value in zip(opened[s][1:], place):
            column.append(value)
    full += [(s, *row) for s, row in opened.items()]
    if full:
        write()
        wrote = True
    return spark.read.schema(_PLAN).parquet(path) if wrote else spark.createDataFrame([], _PLAN)


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None,
                temperature: float = 0.7, block_rows: int = 16,
                source_col: str = "source", id_col: str = "doc_id",
                carry: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Place every row of ``docs`` in a stream that interleaves sources by target weight.

    Returns ``doc_id, source``, the ``carry`` columns, ``block`` (number within the source),
    ``weight`` (the source's share when the block is released), ``release``, ``deadline`` and
    ``slot`` (in blocks) and ``position`` (sort key of the stream, slot by slot). No row is
    dropped or repeated: when a source is used up, the rest go on with its weight shared out in
    proportion. At any moment each source is less than one block from its exact target.

    ``weights`` maps sources (``None``: rows without a source) to target weights; sources
    it leaves out, and all sources if it is ``None``, weigh their row count to the power of
    ``temperature`` (scaled to the mapping's mean). Within a source rows stand by id, then by
    the ``order`` columns (which should name rows where ids may be null or repeated, so that
    equal ids spread over tasks). Repeated ids are rows of their own. An empty table gives no
    rows. The driver holds one row a source and makes the schedule block by block; its time
    grows with blocks and sources (README), so a very large table takes a larger ``block_rows``.
    """
    spark, carry, order = docs.sparkSession, list(carry or []), list(order or [])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)],
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_key"))
    counts = {r["_key"]: r["count"] for r in rows.groupBy("_key").count().collect()}
    natural = {s: float(n) ** temperature for s, n in counts.items()}
    if weights:
        asked = {"" if s is None else f"={s}": float(w) for s, w in weights.items()}
        if any(not w > 0 for w in asked.values()):
            raise ValueError("weights must be positive")
        mean = sum(asked.values()) / len(asked)
        scale = mean / (sum(natural.values()) / len(natural)) if natural else 1.0
        target = {s: asked.get(s, natural[s] * scale) for s in counts}
    else:
        target = natural
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    planned = _stored_plan(spark, exact_places(blocks, target))

    numbered = number_rows(rows, ["_key"], ["doc_id", *[f"_o{k}" for k in range(len(order))]], "_n", few_groups=False)
    block = F.floor(F.col("_n") / block_rows).cast("long")
    # One row of the plan meets CHUNK * block_rows rows at most, so no source is hot here.
    placed = numbered.withColumn("block", block).withColumn("_at", F.expr(f"block div {CHUNK}")).join(
        planned, (F.col("_key") == F.col("_s")) & (F.col("_at") == F.col("_chunk")))
    of = lambda name: F.get(F.col(name), (F.col("block") % CHUNK).cast("int"))
    return placed.select(
        "doc_id", "source", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], "block",
        of("_weight").alias("weight"), of("_release").alias("release"), of("_deadline").alias("deadline"),
        of("_slot").alias("slot"), (of("_slot") * block_rows + F.col("_n") % block_rows).alias("position"))
