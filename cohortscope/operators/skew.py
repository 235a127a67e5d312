"""Membership joins that stay even when one key holds a large share of the rows.

The skew is measured, not assumed: one mergeable sketch of the key column finds the keys that
hold more than one task's share of the rows, and each of them gets as many salts as its share
asks for. All other keys keep one place, so nothing is copied for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_TRACKED, TRACKED_A_TASK = 10_000, 8


def heavy_keys(facts: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(``key``, ``_salts``) of the keys that hold more than 1/``tasks`` of the rows.

    ``_salts`` is a key's share times ``tasks`` (default: the session's shuffle partitions),
    rounded up, and at least 2. The counts come from one global aggregate: a frequent-items
    sketch per task, merged, so the keys themselves are not shuffled and at most ``tasks`` rows
    come out. The sketch counts within 1/(2 ``tasks``) of the rows; an estimate only moves
    rows between tasks, never in or out of a result. NULL keys are left out. A key of a type
    that the sketch does not take (an array, say) is an error.
    """
    if tasks is None:
        tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = max(LEAST_TRACKED, TRACKED_A_TASK * tasks)
    rows = facts.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull())
    found = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"approx_top_k(_k, {max(1, tasks)}, {tracked})").alias("_top"),
    ).select("_n", F.explode("_top").alias("_t"))
    salts = F.ceil(F.col("_t.count") * F.lit(tasks) / F.col("_n")).cast("int")
    return found.select(F.col("_t.item").alias(key), salts.alias("_salts")).filter(F.col("_salts") > 1)


def salted(df: DataFrame, heavy: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """``df`` with ``_salt``: of a heavy key's rows one of its salts, else 0.

    With ``spread`` (the fact side) a row's salt comes from that column; without (the member
    side) a row of a heavy key appears once per salt. ``heavy`` has at most one row per task
    of the job (see :func:`heavy_keys`), which is why it may be broadcast.
    """
    marked = df.join(F.broadcast(heavy), key, "left")
    n = F.coalesce(F.col("_salts"), F.lit(1))
    if spread is not None:
        salt = F.when(n > 1, F.pmod(F.xxhash64(spread), n).cast("int")).otherwise(F.lit(0))
    else:
        salt = F.explode(F.sequence(F.lit(0), n - 1))
    return marked.withColumn("_salt", salt).drop("_salts")


def salted_semi_join(
    facts: DataFrame, members: DataFrame, key: str, spread: str, tasks: int | None = None
) -> DataFrame:
    """Distinct (``key``, ``spread``) pairs of ``facts`` whose ``key`` is in ``members``
    (one row per key, same column name).

    Rows of a heavy key go to as many places as its share of the rows asks for, by a salt from
    ``spread``; the member keys among them appear once per salt, all others once. The exchange
    on (key, salt) serves both the semi-join and the distinct: facts are shuffled once. NULL
    keys match nothing.
    """
    pairs = facts.select(key, spread)
    heavy = heavy_keys(pairs, key, tasks)
    kept = salted(pairs, heavy, key, spread).join(
        salted(members.select(key), heavy, key), [key, "_salt"], "left_semi")
    return kept.groupBy(key, "_salt", spread).agg(F.count(F.lit(1)).alias("_n")).select(key, spread)
