"""The lateral JSON source (IO4 / J10): a table row per element of a JSON array text.

``JSON_TABLE(list, '$[*]' ...)`` joined to its row becomes ``explode(from_json(..))``.
Like the inner lateral join, a NULL, malformed or empty list yields no rows; with ``strict``
text that is no JSON fails the job instead, as on the analysed server.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import list_dates, parse_list


def explode_list(df: DataFrame, key: str, list_col: str, value_name: str = "value", strict: bool = False) -> DataFrame:
    """(key, value string) per element."""
    return df.select(F.col(key), F.explode(parse_list(list_col, strict)).alias(value_name))


def explode_dates(df: DataFrame, key: str, list_col: str, date_name: str = "att_date", strict: bool = False) -> DataFrame:
    """(key, date) per element; an unparsable element gives a NULL date."""
    return df.select(F.col(key), F.explode(list_dates(list_col, strict)).alias(date_name))
