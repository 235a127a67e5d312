"""Table profiling (P1-P9): previews, NULL and empty-list counts, distinct counts and
frequency tables. Every result is an aggregate or a bounded top-k; nothing unbounded
reaches the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortscope.functions.exprs import list_length, null_count
from cohortscope.plans.period import Period, restrict
from cohortscope.sources.layout import plain

WORD_SHIFT = 6  # a word of a bitmap holds 2^6 bits


def browse(df: DataFrame) -> DataFrame:
    """P1 / IO2 ``SELECT * FROM t``: the whole table, lazily (nothing is collected)."""
    return plain(df)


def preview(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """P1 ``SELECT * ... LIMIT n``: a preview of ``n`` rows.

    With ``order_by`` the preview is a top-n on those columns (TakeOrderedAndProject, one
    bounded heap per partition), so it is a function of the data; without it, any n rows.
    """
    df = plain(df)
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def completeness(df: DataFrame, cols: Sequence[str], total_name: str = "total_rows") -> DataFrame:
    """P3 total rows and NULLs per column (``null_<col>``), in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias(total_name), *[null_count(c).alias(f"null_{c}") for c in cols]
    )


def empty_list_count(df: DataFrame, col: str, name: str = "empty_cnt") -> DataFrame:
    """P4 rows whose list text is exactly ``[]``."""
    return df.filter(F.col(col) == "[]").agg(F.count(F.lit(1)).alias(name))


def malformed_list_count(df: DataFrame, col: str, name: str = "malformed_cnt") -> DataFrame:
    """Rows whose list text is present but is no JSON array (list operators skip them)."""
    bad = F.col(col).isNotNull() & list_length(col).isNull()
    return df.agg(F.count_if(bad).alias(name))


def row_count(
    df: DataFrame, col: str | None = None, where: Column | None = None, name: str = "cnt"
) -> DataFrame:
    """P5 ``COUNT(*)`` or ``COUNT(col)`` (non-NULL), optionally under a predicate."""
    if where is not None:
        df = df.filter(where)
    target = F.lit(1) if col is None else F.col(col)
    return df.agg(F.count(target).alias(name))


def distinct_count(
    df: DataFrame,
    cols: Mapping[str, str],
    period: Period | None = None,
    ts_col: str = "created_at",
    bitmaps: bool | None = None,
) -> DataFrame:
    """P6 exact ``COUNT(DISTINCT col)`` for each ``{output name: column}``.

    Integer columns are counted through :func:`distinct_bitmaps`: one scan, no Expand, and
    bits move, not values. Where another type is among them (or ``bitmaps=False``), the counts
    plan as Spark's two-level aggregate, several as one Expand; each level is partially
    aggregated. Either way a hot value does not land in one task.
    """
    df = restrict(df, period, ts_col)
    if bitmaps is None:
        bitmaps = all(isinstance(df.schema[c].dataType, IntegralType) for c in cols.values())
    if bitmaps:
        return count_bitmaps(distinct_bitmaps(df, cols), list(cols))
    return df.agg(*[F.countDistinct(c).alias(name) for name, c in cols.items()])


def distinct_bitmaps(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Mergeable state of exact distinct counts: ``name, word, bits`` for each
    ``{name: integer column}``.

    A word stands for 64 neighbouring ids, ``bits`` (long) has a bit per id. One scan stacks
    the columns; words are ORed in a hash table where the rows lie and again after the shuffle
    by (name, word), so densely numbered ids move a 64th of their number, a hot id one word a
    task, and thinly spread ids (hashes) no more than their values would. States of parts of a
    table (days, say) union to the state of the whole; :func:`merge_bitmaps` makes them small
    again. NULLs are not counted.

    Words of a long were measured against Spark's 4 kB bitmaps (``bitmap_construct_agg``):
    those cannot be updated in a hash table, so every row is sorted first, and each lone id
    costs 4 kB.
    """
    for col in cols.values():
        kind = df.schema[col].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"{col} is {kind.simpleString()}, bitmaps count integers")
    pairs = [(F.lit(k).alias("_name"), F.col(col).cast("long").alias("_id")) for k, col in enumerate(cols.values())]
    ids = df.select(*pairs[0]) if len(pairs) == 1 else df.select(F.inline(F.array(*[F.struct(*p) for p in pairs])))
    ids = ids.filter(F.col("_id").isNotNull())
    place = F.col("_id").bitwiseAND(F.lit((1 << WORD_SHIFT) - 1).cast("long")).cast("int")
    words = ids.select(
        "_name", F.shiftright("_id", WORD_SHIFT).alias("word"),  # a shift floors negative ids too
        F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("_bit"))
    state = words.groupBy("_name", "word").agg(F.bit_or("_bit").alias("bits"))
    return state.select(F.element_at(F.array(*map(F.lit, cols)), F.col("_name") + 1).alias("name"), "word", "bits")


def merge_bitmaps(states: DataFrame) -> DataFrame:
    """One row per (name, word) of united :func:`distinct_bitmaps` states."""
    return states.groupBy("name", "word").agg(F.bit_or("bits").alias("bits"))


def count_bitmaps(state: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct counts of a merged state, one column per name (0 where it has no id)."""
    ones = F.bit_count("bits").cast("long")
    return state.agg(*[
        F.coalesce(F.sum(F.when(F.col("name") == n, ones)), F.lit(0).cast("long")).alias(n) for n in names])


def _folded(col: str, collation: str | None) -> Column:
    """The column under ``collation`` (e.g. ``UNICODE_CI_AI``: case and accents folded),
    or as is. Text equality is binary by default."""
    return F.col(col) if collation is None else F.collate(F.col(col), collation)


def distinct_values(df: DataFrame, col: str, collation: str | None = None) -> DataFrame:
    """P7 the domain of a column (one NULL kept).

    With ``collation``, values equal under it are one value, shown by its smallest
    spelling in binary order (so the result does not depend on row order).
    """
    if collation is None:
        return df.select(col).distinct()
    return df.groupBy(_folded(col, collation).alias("_key")).agg(F.min(col).alias(col)).select(col)


def value_counts(
    df: DataFrame,
    col: str,
    count_col: str | None = None,
    where: Column | None = None,
    order: str | None = "key",
    k: int | None = None,
    name: str = "cnt",
    collation: str | None = None,
) -> DataFrame:
    """P8 frequency table of ``col``.

    ``count_col=None`` counts rows (``COUNT(*)``); ``count_col=col`` counts non-NULL
    values, so the NULL group gets 0. ``order=None`` leaves the rows unordered (no range
    shuffle), ``order='key'`` sorts by the value, ``order='count'`` by count descending with
    the key as tie-break; ``k`` keeps the top k (a top-k report). ``collation`` groups
    values equal under it (shown by their smallest spelling).
    """
    if order not in (None, "key", "count"):
        raise ValueError(order)
    if where is not None:
        df = df.filter(where)
    target = F.lit(1) if count_col is None else F.col(count_col)
    if collation is None:
        out = df.groupBy(col).agg(F.count(target).alias(name))
    else:
        out = (
            df.groupBy(_folded(col, collation).alias("_key"))
            .agg(F.min(col).alias(col), F.count(target).alias(name))
            .select(col, name)
        )
    if order == "count":
        out = out.orderBy(F.col(name).desc(), F.col(col).asc_nulls_first())
    elif order == "key":
        out = out.orderBy(F.col(col).asc_nulls_first())
    if k is not None:
        out = out.limit(k)
    return out


def value_totals(
    df: DataFrame, col: str, measure: str, k: int | None = None, name: str = "total",
) -> DataFrame:
    """Per value of ``col`` the SUM of an integer measure, largest first (``k``: top k)."""
    out = df.groupBy(col).agg(F.sum(measure).cast("long").alias(name))
    out = out.orderBy(F.col(name).desc_nulls_last(), F.col(col).asc_nulls_first())
    return out if k is None else out.limit(k)


def lookup(df: DataFrame, col: str, value, collation: str | None = None) -> DataFrame:
    """P9 all rows with ``col = value``; the literal is cast to the column's type (never a
    mixed-type comparison), and the binary equality is pushed to the scan. With
    ``collation`` (text columns) the comparison folds as that collation does."""
    df = plain(df)
    dtype = df.schema[col].dataType.simpleString()
    literal = F.lit(value).cast(dtype)
    if collation is None:
        return df.filter(F.col(col) == literal)
    return df.filter(_folded(col, collation) == F.collate(literal, collation))
