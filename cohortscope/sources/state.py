"""Mergeable states kept as one folder per load: a new day adds a folder and re-reads nothing.

A state is a table whose rows add up (counts per user and week, distinct-count words, ...).
Each load writes its part under its own name; writing a load again replaces that part only, so a
load that failed or ran twice is simply run again. Readers see the union of the loads and merge
as they aggregate. ``compact`` folds many loads into one without changing what readers see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD = "load"  # partition column: the name of the load


def write_load(part: DataFrame, path: str, load: str) -> None:
    """Write one load's part of a state, in place of an earlier run of the same load.

    Only that load's folder is replaced (dynamic partition overwrite, moved in by the job's
    commit); a load without rows leaves an earlier run's folder as it was.
    """
    part.withColumn(LOAD, F.lit(load)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(LOAD).parquet(path)


def read_loads(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame:
    """The parts of all loads (with ``upto``: of names up to it, other folders pruned), without
    the load's name."""
    rows = spark.read.option("recursiveFileLookup", "false").schema(_with_text_load(spark, path)).parquet(path)
    return (rows if upto is None else rows.filter(F.col(LOAD) <= upto)).drop(LOAD)


def _with_text_load(spark: SparkSession, path: str):
    """The stored schema with the load's name as text, whatever it looks like (2024-01-05)."""
    found = spark.read.parquet(path).schema
    kept = [f for f in found.fields if f.name != LOAD]
    made = spark.createDataFrame([], "load string").schema
    return type(found)([*kept, *made.fields])


def compact(spark: SparkSession, path: str, to: str, merge: Callable[[DataFrame], DataFrame], load: str = "base") -> None:
    """Write the merged state of all loads of ``path`` as one load of a new folder ``to``."""
    write_load(merge(read_loads(spark, path)), to, load)
