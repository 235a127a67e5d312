"""Storage layout for the logical tables: bucketing by user for co-located joins.

Almost every analysis reduces a fact table per user and then joins per-user relations.
Written as tables bucketed (and sorted) by the user key with the same bucket count, the
scans already carry that hash partitioning, so those per-user aggregations and the joins
between them need no shuffle at all.

For periods there is the day layout: a table partitioned into folders by the day of its time
column. A period on the time column then also names days, so the scan lists only the folders
of the period (``PartitionFilters`` in the plan) and reads no other file. Point the session at
a folder of such tables (:func:`use_layout`), and every binding that scans one of them reads
it from there; without the setting the plain tables are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "cohortscope.layout"  # session setting: the folder of tables in the day layout
DAY_SUFFIX = "_day"  # a day-partitioned time column ``ts`` has its folders named by ``ts_day``


def write_bucketed(
    df: DataFrame,
    table: str,
    key: str,
    buckets: int,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Save ``df`` as an external parquet table at ``path``, bucketed and sorted by ``key``.

    Use one bucket count for all tables that are joined on the same key. ``path`` must be
    shared storage on a cluster.
    """
    writer = df.write.mode(mode).format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """Read a table written by ``write_bucketed``; its scan keeps the bucket partitioning."""
    return spark.table(table)


def day_column(ts: str) -> str:
    return ts + DAY_SUFFIX


def plain(df: DataFrame) -> DataFrame:
    """``df`` without the day columns of the layout: the columns of the plain table."""
    return df.drop(*[day_column(c) for c in df.columns if day_column(c) in df.columns])


def write_by_day(
    df: DataFrame, folder: str, name: str, ts: str, mode: str = "overwrite", rows_per_file: int = 0,
) -> None:
    """Write ``df`` as ``folder/name.parquet``, one folder per day of ``ts`` (a NULL time has a
    folder of its own).

    Rows are shuffled by day and a salt that grows with the day's share, so each day is
    written by as many tasks as it needs and not by all: Spark's rebalance splits large days and
    joins small ones at run time. ``rows_per_file`` bounds a file's rows (0: no bound).
    ``mode="append"`` adds days to a table, as a daily load does.
    """
    by_day = df.withColumn(day_column(ts), F.col(ts).cast("date"))
    writer = by_day.hint("rebalance", day_column(ts)).write.mode(mode).partitionBy(day_column(ts))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def use_layout(spark: SparkSession, folder: str | None) -> None:
    """Read tables of ``folder`` instead of the plain ones from now on (None: no longer)."""
    if folder is None:
        spark.conf.unset(LAYOUT)
    else:
        spark.conf.set(LAYOUT, folder)


def laid_out(spark: SparkSession, name: str) -> DataFrame | None:
    """The table in the session's layout folder, or None where there is no such folder or table."""
    folder = spark.conf.get(LAYOUT, None)
    if not folder:
        return None
    path = f"{folder.rstrip('/')}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)
