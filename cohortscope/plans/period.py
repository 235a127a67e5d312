"""Explicit analysis periods.

The analyses use three conventions side by side and they give different numbers, so
the convention is part of the period rather than an accident of how it is written:

* ``half_open``  ``lo <= x < hi``.
* ``closed``     ``x BETWEEN lo AND hi``. On a timestamp column a date-only ``hi`` is
  midnight of that day, so the rest of that day is *outside* the period.
* ``closed`` on a date column (``as_type="date"``) keeps both days whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortscope.sources.layout import day_column


@dataclass(frozen=True)
class Period:
    lo: str
    hi: str
    closed: bool = False

    @classmethod
    def half_open(cls, lo: str, hi: str) -> "Period":
        return cls(lo, hi, closed=False)

    @classmethod
    def between(cls, lo: str, hi: str) -> "Period":
        return cls(lo, hi, closed=True)

    def mask(self, column: str | Column, as_type: str = "timestamp_ntz") -> Column:
        """Predicate for ``column`` with typed literals, so it reaches the parquet scan."""
        c = F.col(column) if isinstance(column, str) else column
        lo = F.lit(self.lo).cast(as_type)
        hi = F.lit(self.hi).cast(as_type)
        if self.closed:
            return c.between(lo, hi)
        return (c >= lo) & (c < hi)

    def sql(self, column: str, as_type: str = "TIMESTAMP") -> str:
        """The same predicate as SQL text (used by the DuckDB oracle)."""
        lo = f"CAST('{self.lo}' AS {as_type})"
        hi = f"CAST('{self.hi}' AS {as_type})"
        if self.closed:
            return f"{column} BETWEEN {lo} AND {hi}"
        return f"{column} >= {lo} AND {column} < {hi}"


    def days(self, column: str | Column) -> Column:
        """Predicate on the day of a time column that holds for every time in the period: what
        a table partitioned by day prunes by. The bounds are whole days, so it keeps a little
        more than :meth:`mask` and never less."""
        c = F.col(column) if isinstance(column, str) else column
        return c.between(F.lit(self.lo).cast("timestamp_ntz").cast("date"), F.lit(self.hi).cast("timestamp_ntz").cast("date"))


def restrict(df, period: Period | None, column: str, as_type: str = "timestamp_ntz"):
    """Filter ``df`` to ``period`` on ``column``; no period means all rows.

    Where ``df`` comes from a table in the day layout, it holds ``<column>_day`` and the period
    also selects days, so the scan prunes whole folders.
    """
    if period is None:
        return df
    day = day_column(column)
    if day in df.columns:
        df = df.filter(period.days(day))
    return df.filter(period.mask(column, as_type))
