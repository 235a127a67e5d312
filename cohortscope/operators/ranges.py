"""Range joins of two event tables by day (J5, J6): key equality plus a span of days.

Days are cut into bins. Each left row takes the few bins its span touches, each right row
the one bin its day is in, and the join is an equijoin on (key, bin) with the span as a
residual test. So a key with a third of all rows is spread over its bins, rows outside every
span never meet a left row, and no list per key is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_DAYS = 32  # days of a bin; a day mask of a bin fits a long with room to shift
WORD_DAYS = 62  # days that one mask column of a window holds


def day_number(day: str | Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp, as long."""
    c = F.col(day) if isinstance(day, str) else day
    return F.unix_date(c.cast("date")).cast("long")


def _bin(day: Column, width: int) -> Column:
    return F.floor(day / F.lit(width)).cast("long")


def _spanned(left: DataFrame, day: Column, lo: int, hi: int, width: int) -> DataFrame:
    """``left`` once per bin that ``[day + lo, day + hi]`` touches, as ``_bin`` (NULL day: once)."""
    return left.withColumn("_bin", F.explode_outer(F.sequence(_bin(day + lo, width), _bin(day + hi, width))))


def range_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_day: str,
    right_day: str,
    lo: int,
    hi: int,
    width: int | None = None,
) -> DataFrame:
    """Pairs of rows equal in ``on`` with ``lo <= right_day - left_day <= hi`` in days.

    Both days may be dates or timestamps (then their dates count). Every pair comes out once:
    a right row has one bin. NULL keys and days match nothing. The columns are those of
    ``left``, then those of ``right`` without ``on``; they must not clash. ``width`` defaults
    to the span, so a left row takes at most two bins.
    """
    if hi < lo:
        raise ValueError("an empty span of days")
    width = width or max(1, hi - lo + 1)
    start, day = day_number(left_day), day_number(right_day)
    a = _spanned(left.withColumn("_from", start).filter(F.col("_from").isNotNull()), F.col("_from"), lo, hi, width)
    b = right.withColumn("_day", day).withColumn("_bin", _bin(F.col("_day"), width))
    apart = F.col("_day") - F.col("_from")
    return a.join(b, [*on, "_bin"]).filter(apart.between(lo, hi)).select(
        *left.columns, *[c for c in right.columns if c not in on])


def day_masks(events: DataFrame, user: str, ts: str) -> DataFrame:
    """(user, ``_bin``, ``_mask``): the days with an event, one bit a day, ``BIN_DAYS`` a row.

    The masks are ORed, so they are partially aggregated before the one shuffle, on
    (user, bin), and two tables of masks merge by OR as well.
    """
    days = events.select(F.col(user), day_number(ts).alias("_day")).filter(
        F.col("_day").isNotNull() & F.col(user).isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_day", F.lit(BIN_DAYS)).cast("int"))
    return days.groupBy(user, _bin(F.col("_day"), BIN_DAYS).alias("_bin")).agg(F.bit_or(bit).alias("_mask"))


def _moved(mask: Column, by: Column) -> Column:
    """``mask`` with its bits moved up by ``by`` (down where negative), 0 once they are all out."""
    up = F.call_function("shiftleft", mask, F.greatest(by, F.lit(0)).cast("int"))
    down = F.call_function("shiftright", mask, F.greatest(-by, F.lit(0)).cast("int"))
    return F.when((by >= WORD_DAYS) | (by <= -BIN_DAYS), F.lit(0).cast("long")).when(by >= 0, up).otherwise(down)


def window_masks(
    starts: DataFrame, events: DataFrame, user: str, start_day: str, ts: str, days: int,
    last: bool = False,
) -> DataFrame:
    """Each user and start day of ``starts`` with the user's event days after the start.

    Bit ``d - 1`` of word ``_w0`` tells of an event ``d`` days after the start day, for the
    first ``days`` days; ``_w1``, ``_w2``, ... hold ``WORD_DAYS`` further days each. With ``last``,
    ``_last`` is the day number of the user's last event (NULL: none). The events are shuffled once, as day
    masks on (user, bin); starts take the two or so bins of their days and meet only those.
    A start with a NULL user or day has no events.
    """
    words = range(-(-days // WORD_DAYS))
    masks = day_masks(events, user, ts)
    own = starts.select(user, start_day).withColumn("_from", day_number(start_day))
    met = _spanned(own, F.col("_from"), 1, days, BIN_DAYS).join(masks, [user, "_bin"], "left")
    offset = F.col("_bin") * BIN_DAYS - F.col("_from") - 1
    kept = []
    for w in words:
        bits = F.lit((1 << min(WORD_DAYS, days - w * WORD_DAYS)) - 1).cast("long")
        word = F.coalesce(_moved(F.col("_mask"), offset - w * WORD_DAYS).bitwiseAND(bits), F.lit(0).cast("long"))
        kept.append(F.bit_or(word).alias(f"_w{w}"))
    seen = met.groupBy(user, start_day).agg(*kept)
    if not last:
        return seen
    top = F.length(F.bin("_mask")) - 1  # the highest bit set
    return seen.join(masks.groupBy(user).agg(F.max(F.col("_bin") * BIN_DAYS + top).alias("_last")), user, "left")


def first_day(days: int) -> Column:
    """Days from the start to the first event in a window of :func:`window_masks` (NULL: none)."""
    found = [F.when(F.col(f"_w{w}") != 0, F.bit_count(F.expr(f"(_w{w} & -_w{w}) - 1")).cast("long") + w * WORD_DAYS + 1)
             for w in range(-(-days // WORD_DAYS))]
    return F.coalesce(*found)


def any_day(lo: int, hi: int) -> Column:
    """Whether a window of :func:`window_masks` has an event ``lo`` to ``hi`` days after the start."""
    hit, lo = F.lit(False), max(lo, 1)
    for w in range((lo - 1) // WORD_DAYS, (hi - 1) // WORD_DAYS + 1):
        a, b = max(lo - 1 - w * WORD_DAYS, 0), min(hi - w * WORD_DAYS, WORD_DAYS)
        hit = hit | (F.col(f"_w{w}").bitwiseAND(F.lit((1 << b) - (1 << a)).cast("long")) != 0)
    return hit
