"""Column-expression helpers that pin down the SQL semantics the analyses depend on.

All are built-in Spark expressions (JVM side, inside whole-stage codegen); none is a
Python UDF.

Rounding: the analyses round exact decimals half up. A double such as 1.005 sits just
below the tie in binary, so rounding the double directly can give 1.00 where the exact
answer is 1.01. ``dround`` rounds through DECIMAL, which goes through the shortest
decimal text of the double and then rounds half up, and returns a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's semantics:
#   date text format accepted in date lists: year-month-day, month and day with or
#     without a leading zero
#   month label: year-month with two-digit month
#   extra decimal digits a division of integers keeps: 4
#   the server's default text comparison folds case and accents: UNICODE_CI_AI
DATE_TEXT_FORMAT = "yyyy-M-d"
TIMESTAMP_TEXT_FORMAT = "yyyy-M-d H:mm:ss"
MONTH_FORMAT = "yyyy-MM"
DIV_EXTRA_DIGITS = 4
CASE_ACCENT_INSENSITIVE = "UNICODE_CI_AI"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dround(x: str | Column, digits: int) -> Column:
    """Half-up rounding of the exact decimal value, returned as double.

    A value too large for the decimal (1e28 and beyond, which has no digits after the
    point as a double) is returned as it is.
    """
    exact = _c(x).try_cast("decimal(38,10)")
    return F.coalesce(F.round(exact, digits).cast("double"), _c(x).cast("double"))


def sql_dround(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def div(num: str | Column, den: str | Column) -> Column:
    """Integer division as the SQL dialect does it: a decimal with 4 extra digits.

    Division by zero gives NULL instead of failing the job.
    """
    return dround(F.try_divide(_c(num).cast("double"), _c(den)), DIV_EXTRA_DIGITS)


def sql_div(num: str, den: str) -> str:
    return sql_dround(f"CAST({num} AS DOUBLE) / NULLIF({den}, 0)", DIV_EXTRA_DIGITS)


def mean(x: str | Column) -> Column:
    """AVG of an integer column: a decimal with 4 extra digits."""
    return dround(F.avg(_c(x)), DIV_EXTRA_DIGITS)


def sql_mean(expr: str) -> str:
    return sql_dround(f"avg({expr})", DIV_EXTRA_DIGITS)


def pct(num: str | Column, den: str | Column, digits: int = 2, keep: int | None = None) -> Column:
    """Percentage rounded half up to ``digits``; NULL when ``den`` is 0.

    ``ROUND(num / den * 100, 2)`` rounds once (the division keeps 4 decimals, which is
    rounding the percentage at 2). ``ROUND(num * 100.0 / den, 2)`` divides a 1-decimal
    value, which keeps 5 decimals first: pass ``keep=5`` for that form.
    """
    x = F.try_divide(_c(num).cast("double") * F.lit(100.0), _c(den))
    if keep is not None:
        x = dround(x, keep)
    return dround(x, digits)


def sql_pct(num: str, den: str, digits: int = 2, keep: int | None = None) -> str:
    x = f"CAST({num} AS DOUBLE) * 100 / NULLIF({den}, 0)"
    if keep is not None:
        x = sql_dround(x, keep)
    return sql_dround(x, digits)


# Decimals kept by ``count * 100.0 / count`` before an outer ROUND (1 + 4).
PCT_DECIMAL_KEEP = 5


def pct_text(num: str | Column, den: str | Column) -> Column:
    """``CONCAT(ROUND(num / den * 100, 2), '%')``: two decimals always, NULL stays NULL."""
    share = F.try_divide(_c(num).cast("double") * F.lit(100.0), _c(den))
    value = F.round(share.try_cast("decimal(38,10)"), 2).try_cast("decimal(20,2)")
    return F.concat(value.cast("string"), F.lit("%"))


def sql_pct_text(num: str, den: str) -> str:
    inner = f"CAST({num} AS DOUBLE) * 100 / NULLIF({den}, 0)"
    return (
        f"CAST(CAST(round(CAST({inner} AS DECIMAL(38,10)), 2) AS DECIMAL(20,2)) AS VARCHAR)"
        " || '%'"
    )


def flag_sum(condition: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: long, NULL on no rows."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("long")


def null_count(x: str | Column) -> Column:
    """``SUM(x IS NULL)``."""
    return F.sum(_c(x).isNull().cast("int")).cast("long")


def safe_date(text: str | Column) -> Column:
    """Date text to DATE; blanks are trimmed and unparsable text gives NULL."""
    return F.try_to_date(F.trim(_c(text)), DATE_TEXT_FORMAT)


def safe_timestamp(text: str | Column) -> Column:
    """Date or date-time text (``yyyy-M-d[ H:mm:ss]``) to TIMESTAMP_NTZ; else NULL."""
    t = F.trim(_c(text))
    with_time = F.try_to_timestamp(t, F.lit(TIMESTAMP_TEXT_FORMAT)).cast("timestamp_ntz")
    return F.coalesce(with_time, safe_date(t).cast("timestamp_ntz"))


def month_label(x: str | Column) -> Column:
    return F.date_format(_c(x), MONTH_FORMAT)


def iso_yearweek(ts: str | Column) -> Column:
    """ISO year * 100 + ISO week (weeks start on Monday; 2024-12-30 -> 202501)."""
    c = _c(ts)
    return (F.extract(F.lit("YEAROFWEEK"), c) * 100 + F.weekofyear(c)).cast("long")


def days_between(start: str | Column, end: str | Column, unit: str = "calendar") -> Column:
    """Difference ``end - start`` as long, in days or hours.

    ``calendar``: difference of the calendar dates (23:00 -> 01:00 next day is 1).
    ``elapsed``: whole 24-hour units between the instants (same example is 0).
    ``hours``: whole hours between the instants (same example is 2).
    """
    s, e = _c(start), _c(end)
    if unit == "calendar":
        return F.datediff(e.cast("date"), s.cast("date")).cast("long")
    if unit in ("elapsed", "hours"):
        return F.timestamp_diff(
            "DAY" if unit == "elapsed" else "HOUR",
            s.cast("timestamp_ntz"), e.cast("timestamp_ntz"),
        ).cast("long")
    raise ValueError(f"unknown unit {unit!r}")


def sql_days_between(start: str, end: str, unit: str = "calendar") -> str:
    if unit == "calendar":
        return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"
    part = "hour" if unit == "hours" else "day"
    return f"date_sub('{part}', CAST({start} AS TIMESTAMP), CAST({end} AS TIMESTAMP))"


def _clean_list(text: str | Column) -> Column:
    """List text with its escaped quotes made plain (the one cleaning rule of lists)."""
    return F.replace(_c(text), F.lit('\\"'), F.lit('"'))


def _checked(text: str | Column, value: Column, kind: str, strict: bool) -> Column:
    """``value``; with ``strict``, text that is no JSON at all fails the job and is named."""
    if not strict:
        return value
    cleaned = _clean_list(text)
    bad = cleaned.isNotNull() & F.try_parse_json(cleaned).isNull()
    told = F.concat(F.lit("invalid JSON text in a list: "), F.left(cleaned, F.lit(100)))
    return F.when(bad, F.raise_error(told).cast(kind)).otherwise(value)


def parse_list(text: str | Column, strict: bool = False) -> Column:
    """JSON array text (possibly with escaped quotes) to ``array<string>``.

    NULL and malformed text give NULL; ``[]`` gives an empty array. ``strict`` fails the job on
    text that is no JSON, as the analysed server does; JSON that is no array gives NULL in
    both modes.
    """
    return _checked(text, F.from_json(_clean_list(text), "array<string>"), "array<string>", strict)


def list_dates(text: str | Column, strict: bool = False) -> Column:
    """JSON date list text to ``array<date>``; unparsable entries become NULL."""
    return F.transform(parse_list(text, strict), lambda v: safe_date(v))


def list_timestamps(text: str | Column, strict: bool = False) -> Column:
    """JSON list of dates or date-times to ``array<timestamp_ntz>``; bad entries are NULL."""
    return F.transform(parse_list(text, strict), lambda v: safe_timestamp(v))


def list_length(text: str | Column, strict: bool = False) -> Column:
    """Number of elements of a JSON array text as long; NULL for NULL or bad text."""
    return _checked(text, F.json_array_length(_clean_list(text)).cast("long"), "bigint", strict)
