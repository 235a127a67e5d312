"""Helpers shared by the training-data operators: shared storage, folds, row numbers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session leaves it unset (tests), a scratch folder is made once and
    kept as the session's checkpoint folder. A cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def prepare(spark: SparkSession) -> None:
    """Ready a session for operators that run Python on the executors, once a session.

    Sends this package to the workers (as ``--py-files`` would), so the code runs wherever an
    executor starts, and bounds Arrow batches by bytes: texts may be very long, and a batch
    lies in memory on both sides. A bound the user set stays.
    """
    if spark.conf.get(BATCH_SETTING, None) in (None, "64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    sent = spark.conf.get("cohortscope.sent", None)
    if sent == spark.sparkContext.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "cohortscope.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("cohortscope.sent", spark.sparkContext.applicationId)


RUN = uuid.uuid4().hex  # names this driver process's tables in the shared folder


def run_path(spark: SparkSession, name: str) -> str:
    """A new place for a table of this run in the shared folder."""
    return f"{shared_dir(spark)}/tables/{RUN}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession, run: str = RUN) -> bool:
    """Delete the tables that a run (default: this driver process) left in the shared folder.

    Call it when the results of the operators have been written or are no longer needed: a
    DataFrame that an operator returned reads these tables. Tells whether there was anything.
    """
    folder = f"{shared_dir(spark)}/tables/{run}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing ``df``,
    and values such as partition numbers are fixed from here on. The table stays until
    :func:`cleanup`.
    """
    spark = df.sparkSession
    path = run_path(spark, name)
    df.write.options(**{"compression": "zstd", **(options or {})}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILE_ROWS = 33  # bits of a row key for the place in the file; above them the file's number


def _file_numbers(df: DataFrame) -> bool:
    """Whether ``df`` was read from Parquet files whose names hold different numbers."""
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return False
    names = [os.path.basename(f) for f in df.inputFiles()]
    if len(names) == 1:
        return True
    found = [re.match(r"part-(\d{1,6})(?:\D.*?)?(?:-c(\d{3}))?(?:\.|$)", n) for n in names]
    return all(found) and len({(int(m[1]), int(m[2] or 0)) for m in found}) == len(names)


def with_row_key(df: DataFrame, out: str) -> DataFrame:
    """``df`` with a long that names each row alike in every reading of the table.

    The key is the number in the name of the row's file (of the task that wrote it, and of the
    file within the task) and the row's place in the file. So it is the same for any cut of
    the files into tasks, on any number of executors. The driver looks at the file names,
    which it holds anyway. A table that was not read from such files is written once
    (:func:`stored`), which gives it them.
    """
    if not _file_numbers(df):
        df = stored(df, "keyed")
    name = F.col("_metadata.file_name")
    part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    piece = F.coalesce(F.regexp_extract(name, r"-c(\d{3})\.", 1).try_cast("long"), F.lit(0))
    return df.withColumn(out, F.shiftleft(part * 1000 + piece, FILE_ROWS) + F.col("_metadata.row_index"))


def fold_is(doc_id: Column, parts: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``remainder`` (null id: false)."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(parts)) == remainder, F.lit(False))


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, total: str | None = None,
                few_groups: bool = True) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in ``order`` within each ``group`` (``[]``: all rows).

    ``total`` names a further column for the number of rows of the group.

    No group passes through one task: rows are range-partitioned on group and order, so a
    hot group spreads over many partitions; each (partition, group) piece is numbered where
    it lies and shifted by the sizes of the group's earlier pieces. The table of pieces has
    at most (partitions + groups) rows. Where groups are of a bounded number (sources), it is
    broadcast and the rows are not moved again; with ``few_groups=False`` Spark chooses the
    join by the table's size, and a shuffled one deals by piece, which is even. Rows equal in
    all of ``group`` and ``order`` are numbered in no particular order among themselves.
    """
    keys = [*group, *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = stored(laid.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumn("_piece", F.shiftright("_mid", _ROW_BITS))
    named = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    pieces = laid.groupBy(F.col("_piece").alias("_p"), *named).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    gs = [f"_g{k}" for k in range(len(group))]
    earlier = (Window.partitionBy(*gs) if gs else Window.partitionBy(F.lit(0))).orderBy("_p") \
        .rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if total:
        pieces = pieces.withColumn(total, F.sum("_rows").over(Window.partitionBy(*gs) if gs else Window.partitionBy(F.lit(0))))
    same = F.col("_piece") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return laid.join(F.broadcast(pieces) if few_groups else pieces, same).withColumn(
        out, F.col("_shift") + F.col("_mid") - F.col("_first")
    ).drop("_mid", "_piece", "_p", "_first", "_rows", "_shift", *gs)


HOT_SHARE = 1000  # a key is hot when it holds over 1/1000 of all rows: at most 1000 are


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``) when a few keys are hot.

    ``size`` is the table's column with the number of rows that hold the key. Keys of over
    1/1000 of the ``n_rows`` rows, at most 1000 of them, are broadcast; their rows take a
    key of their own, so they spread evenly over the shuffled join of all other keys.
    """
    limit = max(HOT_SHARE, n_rows // HOT_SHARE)
    values = [c for c in table.columns if c != key]
    renamed = lambda t, tag: t.select(*[F.col(c).alias(f"_{tag}_{c}") for c in t.columns])
    hot = renamed(table.filter(F.col(size) > limit), "hot")
    rest = renamed(table.filter(F.col(size) <= limit), "rest")
    is_hot = F.col(f"_hot_{size}").isNotNull()
    spread = F.struct(F.when(~is_hot, F.col(key)).alias("k"), F.when(is_hot, F.xxhash64(*rows.columns)).alias("s"))
    rest = rest.withColumn("_key", F.struct(F.col(f"_rest_{key}").alias("k"), F.lit(None).cast("long").alias("s")))
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col(f"_hot_{key}"), "left") \
        .withColumn("_at", F.xxhash64(spread)) \
        .join(rest.withColumn("_at2", F.xxhash64("_key")),
              (F.col("_at") == F.col("_at2")) & (F.col(key) == F.col(f"_rest_{key}")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values])
