"""Exact dedup by content sort: equal texts end up next to each other and are compared whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortscope.llm import common
from cohortscope.llm.common import join_hot, stored

SPACE = r"[\x20\x09-\x0D]+"
LEAD = 32  # characters of a text that splitters hold


def normalised(text: Column) -> Column:
    """Null as empty text; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def hot_hashes(rows: DataFrame, n_rows: int) -> DataFrame:
    """``hot_hash, salts`` of text hashes that over 1/1000 of the rows share (at most 1000), with
    as many salts as leave each no more than that share. Moves one pair of numbers a hash and task."""
    limit = max(common.HOT_SHARE, n_rows // common.HOT_SHARE)
    return rows.groupBy(F.col("hash").alias("hot_hash")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > limit).select("hot_hash", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     n_rows: int | None = None) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, group_size``.

    The content sort: Spark samples splitters, range-partitions on them and sorts each range
    externally; texts move once. The splitters are the first ``LEAD`` characters, a hash of
    the text and a salt, so the sample that the driver sees has keys of bounded size, texts
    that share a long beginning still spread, and a text that a third of the rows share is
    spread as well: its rows take salts by the task that reads them. The window needs no
    further exchange; it walks the sorted range and compares each text in full with its
    neighbour. What is left, a digest and two numbers per text and salt, is added up.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn(
        "hash", F.xxhash64("norm"))
    hot = hot_hashes(rows, docs.count() if n_rows is None else n_rows)
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.spark_partition_id(), F.col("salts"))).otherwise(F.lit(0))
    # Broadcast: at most 1000 rows of two numbers.
    keyed = rows.join(
        F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left").select(
        F.substring("norm", 1, LEAD).alias("lead"), "hash", salt.alias("salt"), "norm", "doc_id")
    equal = Window.partitionBy("lead", "hash", "salt", "norm").orderBy(F.asc_nulls_last("doc_id"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = (
        keyed.repartitionByRange("lead", "hash", "salt")
        .withColumn("rank", F.row_number().over(equal))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .filter("rank = 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), F.col("doc_id").alias("least"), "n")
    )
    return sorted_rows.groupBy("text_sha256").agg(
        F.min("least").alias("keep_id"), F.sum("n").cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts the smallest id is kept. Null text counts as empty; empty
    texts form one group. Null ids never win against an id (a group of null ids only has
    ``keep_id`` null and keeps them). Rows that repeat an id are marked alike. Other
    columns of ``docs``, whatever their names, are not read. An empty table gives no rows.

    The marks return to the rows through the digest, hot groups apart from the others.
    """
    n_rows = docs.count()
    groups = stored(duplicate_groups(docs, id_col, text_col, n_rows).filter("group_size > 1"), "copies")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    marked = join_hot(rows, groups, "text_sha256", "group_size", n_rows)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return marked.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
    FROM documents
), g AS (
    SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
