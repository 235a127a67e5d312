"""Cohorts, conversion and participation (C1-C7).

Pattern throughout: reduce each side to one row per user (distinct keys or a per-user
count, both partially aggregated) *before* joining, so every join is 1:1 on the user
key and no user's raw rows meet another table's raw rows. Distinct counts after such a
join are plain counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import dround, mean, pct, pct_text
from cohortscope.operators.skew import salted_semi_join
from cohortscope.plans.period import Period, restrict


def cohort(
    df: DataFrame, user: str = "user_id", period: Period | None = None, ts: str = "created_at",
    name: str | None = None,
) -> DataFrame:
    """C1 distinct users active in a period (one column, named ``name`` or ``user``)."""
    return restrict(df, period, ts).select(F.col(user).alias(name or user)).distinct()


def _facts(weight: str | None) -> Column:
    """How many facts a group of rows stands for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def conversion_rate(
    base: DataFrame,
    target: DataFrame,
    base_key: str = "user_id",
    target_key: str = "user_id",
    base_name: str = "base_cnt",
    converted_name: str = "converted_cnt",
    rate_name: str | None = "rate",
    rate: str = "pct",
    keep: int | None = None,
) -> DataFrame:
    """C2 size of ``base``, how many of its keys appear in ``target``, and the rate.

    ``rate='pct'`` is ``ROUND(converted * 100 / base, 2)``, ``rate='ratio'`` is
    ``ROUND(converted / base, 4)``, ``rate='text'`` is the percentage as ``%`` text,
    ``rate=None`` gives the two counts only; ``keep`` is passed to ``pct`` (5 for the
    ``converted * 100.0 / base`` form). NULL keys are not counted (``COUNT(DISTINCT)``
    skips them).
    """
    b = base.select(F.col(base_key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    t = (
        target.select(F.col(target_key).alias("_k"))
        .filter(F.col("_k").isNotNull())
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    joined = b.join(t, "_k", "left")
    n_base = F.count(F.lit(1))
    n_conv = F.count(F.col("_hit"))
    cols = [n_base.alias(base_name), n_conv.alias(converted_name)]
    if rate_name is not None:
        if rate == "pct":
            cols.append(pct(n_conv, n_base, keep=keep).alias(rate_name))
        elif rate == "ratio":
            cols.append(dround(F.try_divide(n_conv.cast("double"), n_base), 4).alias(rate_name))
        elif rate == "text":
            cols.append(pct_text(n_conv, n_base).alias(rate_name))
        else:
            raise ValueError(rate)
    return joined.agg(*cols)


def two_way_participation(
    members: DataFrame,
    edges: DataFrame,
    src: str = "send_user_id",
    dst: str = "receive_user_id",
    member_key: str = "user_id",
    edge_period: Period | None = None,
    ts: str = "created_at",
    names: Sequence[str] = (
        "total_voters", "sender_cnt", "receiver_cnt", "sender_rate", "receiver_rate",
    ),
) -> DataFrame:
    """C3 members who sent an edge, members who received one, both rates as ``%`` text.

    Senders and receivers are reduced to distinct keys, then each is left-joined 1:1.
    A NULL member key is no member (``COUNT(user_id)``).
    """
    m = members.select(F.col(member_key).alias("_k")).distinct()
    e = restrict(edges, edge_period, ts)
    senders = e.select(F.col(src).alias("_k")).distinct().withColumn("_s", F.lit(1))
    receivers = e.select(F.col(dst).alias("_k")).distinct().withColumn("_r", F.lit(1))
    joined = m.join(senders, "_k", "left").join(receivers, "_k", "left")
    n, s, r = F.count("_k"), F.count("_s"), F.count("_r")
    return joined.agg(
        n.alias(names[0]), s.alias(names[1]), r.alias(names[2]),
        pct_text(s, n).alias(names[3]), pct_text(r, n).alias(names[4]),
    )


def per_member_activity(
    members: DataFrame,
    facts: DataFrame,
    fact_user: str = "send_user_id",
    member_key: str = "user_id",
    fact_period: Period | None = None,
    ts: str = "created_at",
    prefix: str = "send_cnt",
    members_name: str = "total_voters",
    stats: Sequence[str] = ("avg", "max", "min"),
    weight: str | None = None,
) -> DataFrame:
    """C4 average / max / min fact count per member; members without facts count 0.

    With ``weight`` a row of ``facts`` stands for that many facts (a rollup).

    The number of members leaves a NULL key out (``COUNT(user_id)``); the mean, maximum and
    minimum run over all joined rows, the NULL key's too.
    """
    m = members.select(F.col(member_key).alias("_k")).distinct()
    counts = (
        restrict(facts, fact_period, ts)
        .groupBy(F.col(fact_user).alias("_k"))
        .agg(_facts(weight).alias("_n"))
    )
    joined = m.join(counts, "_k", "left").select("_k", F.coalesce("_n", F.lit(0)).alias("_n"))
    cols = [F.count("_k").alias(members_name)]
    if "avg" in stats:
        cols.append(dround(mean("_n"), 2).alias(f"avg_{prefix}"))
    if "max" in stats:
        cols.append(F.max("_n").alias(f"max_{prefix}"))
    if "min" in stats:
        cols.append(F.min("_n").alias(f"min_{prefix}"))
    return joined.agg(*cols)


MASK_SETS = 62  # sets that one mask column marks


def cohort_overlap(sets: Sequence[tuple[DataFrame, str]], name: str = "common_user_cnt") -> DataFrame:
    """C5 number of distinct users present in every set (each already restricted).

    One shuffle for any number of sets: all keys are stacked with the bit of their set, and
    the bits are ORed per user. The OR is partially aggregated before the shuffle, so a user
    with a third of all rows sends one row per partition, and no set needs to be distinct.
    A user counts when all bits are set. NULL is no user. Sets beyond ``MASK_SETS`` take
    further mask columns.
    """
    if not sets:
        raise ValueError("an intersection needs at least one set")
    words = range(-(-len(sets) // MASK_SETS))
    stacked = None
    for k, (df, key) in enumerate(sets):
        own = df.select(F.col(key).alias("_k"), *[
            F.lit(1 << k % MASK_SETS if k // MASK_SETS == w else 0).cast("long").alias(f"_m{w}") for w in words])
        own = own.filter(F.col("_k").isNotNull())
        stacked = own if stacked is None else stacked.unionByName(own)
    masks = stacked.groupBy("_k").agg(*[F.bit_or(f"_m{w}").alias(f"_m{w}") for w in words])
    for w in words:
        full = (1 << min(MASK_SETS, len(sets) - w * MASK_SETS)) - 1
        masks = masks.filter(F.col(f"_m{w}") == F.lit(full).cast("long"))
    return masks.agg(F.count(F.lit(1)).alias(name))


def linked_members(
    links: DataFrame, targets: DataFrame, link_key: str = "question_piece_id",
    target_key: str = "id", user: str = "user_id", distinct: bool = True,
) -> DataFrame:
    """Users of ``links`` whose linked row exists in ``targets`` (a semi-join on the
    link key), as distinct user keys. ``distinct=False`` leaves a user as often as distinct
    linked rows name them, without a shuffle by user: enough for a set of
    ``cohort_overlap``. A hot link key is spread over as many tasks as its share asks."""
    t = targets.select(F.col(target_key).alias(link_key)).distinct()
    users = salted_semi_join(links, t, link_key, user).select(user)
    return users.distinct() if distinct else users


def participation_and_intensity(
    members: DataFrame,
    facts: DataFrame,
    fact_user: str = "user_id",
    member_key: str = "user_id",
    fact_period: Period | None = None,
    ts: str = "created_at",
    names: Sequence[str] = (
        "total_voted_users", "event_participated_users", "event_participation_rate",
        "avg_event_cnt_per_participant",
    ),
    weight: str | None = None,
) -> DataFrame:
    """C6 members, members with facts, their share, and mean facts per participant
    (members without facts are left out of the mean; a NULL key is no member). With
    ``weight`` a row of ``facts`` stands for that many facts (a rollup)."""
    m = members.select(F.col(member_key).alias("_k")).distinct()
    counts = (
        restrict(facts, fact_period, ts)
        .groupBy(F.col(fact_user).alias("_k"))
        .agg(_facts(weight).alias("_n"))
    )
    joined = m.join(counts, "_k", "left")
    n, p = F.count("_k"), F.count("_n")
    return joined.agg(
        n.alias(names[0]), p.alias(names[1]), pct(p, n).alias(names[2]),
        dround(mean("_n"), 2).alias(names[3]),
    )


def overlap_range(
    users: DataFrame, facts: DataFrame, user_key: str = "id", fact_user: str = "user_id",
    ts: str = "created_at", names: Sequence[str] = ("min_created_at", "max_created_at"),
) -> DataFrame:
    """C7 earliest and latest ``ts`` of users who have at least one fact."""
    active = facts.select(F.col(fact_user).alias(user_key)).distinct()
    return users.join(active, user_key, "left_semi").agg(
        F.min(ts).alias(names[0]), F.max(ts).alias(names[1])
    )


__all__ = [
    "cohort", "cohort_overlap", "conversion_rate", "linked_members", "overlap_range",
    "participation_and_intensity", "per_member_activity", "two_way_participation",
]
