"""Segment comparisons (S1-S6).

Facts are first reduced per user (or per linked key) and only then joined to the
segment table, so the join carries one row per user whatever a user's share of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import PCT_DECIMAL_KEEP, div, dround, flag_sum, pct
from cohortscope.operators.skew import salted_semi_join
from cohortscope.plans.period import Period, restrict


def compare_segments(
    facts: DataFrame,
    members: DataFrame,
    value: str = "delta_point",
    user: str = "user_id",
    member_key: str = "user_id",
    where: Column | None = None,
    period: Period | None = None,
    ts: str = "created_at",
    labels: tuple[str, str] = ("voted", "not_voted"),
    flag_name: str = "vote_flag",
    weight: str | None = None,
) -> DataFrame:
    """S1 label each fact by whether its user is a member; per label: users, facts,
    value total, facts per user and value per user (each ratio 4 decimals, then 2).

    Facts without a user belong to no member and count as facts, not as a user. With
    ``weight`` a row stands for that many facts and ``value`` is their total (a rollup).
    """
    f = restrict(facts, period, ts)
    if where is not None:
        f = f.filter(where)
    per_user = f.groupBy(user).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"), F.sum(value).alias("_v")
    )
    m = members.select(F.col(member_key).alias(user)).distinct().withColumn("_m", F.lit(1))
    labelled = per_user.join(m, user, "left").withColumn(
        flag_name, F.when(F.col("_m").isNotNull(), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    )
    users, events, total = F.count(user), F.sum("_n"), F.sum("_v")
    return labelled.groupBy(flag_name).agg(
        users.alias("user_cnt"),
        events.cast("long").alias("total_events"),
        total.cast("long").alias("total_point"),
        dround(div(events, users), 2).alias("avg_events_per_user"),
        dround(div(total, users), 2).alias("avg_point_per_user"),
    )


def segment_members(
    users: DataFrame,
    facts: DataFrame,
    seg: str = "ban_status",
    user_key: str = "id",
    fact_user: str = "user_id",
    user_period: Period | None = None,
    fact_period: Period | None = None,
    ts: str = "created_at",
    name: str = "ban_cnt",
) -> DataFrame:
    """S2 distinct users with at least one fact, per segment."""
    active = restrict(facts, fact_period, ts).select(F.col(fact_user).alias(user_key)).distinct()
    u = restrict(users, user_period, ts).join(active, user_key, "left_semi")
    return u.groupBy(seg).agg(F.countDistinct(user_key).alias(name))


def segment_completion(
    facts: DataFrame,
    users: DataFrame,
    seg: str = "ban_status",
    status: str = "status",
    done_value: str = "C",
    user_key: str = "id",
    fact_user: str = "user_id",
    user_period: Period | None = None,
    fact_period: Period | None = None,
    ts: str = "created_at",
    names: Sequence[str] = ("total_votes", "completed_votes", "completion_rate_pct"),
) -> DataFrame:
    """S3 facts, completed facts and completion rate per segment (counts facts, not
    users), by rate descending."""
    per_user = (
        restrict(facts, fact_period, ts)
        .groupBy(F.col(fact_user).alias(user_key))
        .agg(F.count(F.lit(1)).alias("_n"), flag_sum(F.col(status) == done_value).alias("_d"))
    )
    u = restrict(users, user_period, ts).select(user_key, seg)
    joined = per_user.join(u, user_key)
    total, done = F.sum("_n"), F.sum("_d")
    return (
        joined.groupBy(seg)
        .agg(
            total.cast("long").alias(names[0]),
            done.cast("long").alias(names[1]),
            pct(done, total).alias(names[2]),
        )
        .orderBy(F.col(names[2]).desc(), F.col(seg))
    )


def segment_non_members(
    users: DataFrame,
    facts: DataFrame,
    seg: str = "ban_status",
    user_key: str = "id",
    fact_user: str = "user_id",
    user_period: Period | None = None,
    fact_period: Period | None = None,
    ts: str = "created_at",
    name: str = "user_cnt",
) -> DataFrame:
    """S4 users with no fact in the fact period, per segment (a left-anti join)."""
    active = restrict(facts, fact_period, ts).select(F.col(fact_user).alias(user_key)).distinct()
    u = restrict(users, user_period, ts).join(active, user_key, "left_anti")
    return u.groupBy(seg).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(seg))


def item_conversion(
    facts: DataFrame,
    members: DataFrame,
    item: str = "productId",
    user: str = "user_id",
    member_key: str = "user_id",
    period: Period | None = None,
    ts: str = "created_at",
    names: Sequence[str] = ("payed_cnt", "voted_cnt", "vote_rate"),
    keep: int | None = PCT_DECIMAL_KEEP,
) -> DataFrame:
    """S5 per item: distinct users, distinct users who are members, and the rate
    (``ROUND(voters * 100.0 / users, 2)``).

    Facts become distinct (item, user) pairs and members distinct keys before the join,
    so the distinct counts are plain counts and no raw fact meets a raw member row. An
    item whose users are all NULL stays, with counts 0 and no rate.
    """
    pairs = restrict(facts, period, ts).select(item, user).distinct()
    m = members.select(F.col(member_key).alias(user)).distinct().withColumn("_m", F.lit(1))
    joined = pairs.join(m, user, "left")
    n, v = F.count(user), F.count("_m")
    return joined.groupBy(item).agg(
        n.alias(names[0]), v.alias(names[1]), pct(v, n, keep=keep).alias(names[2])
    )


def member_linked_targets(
    links: DataFrame,
    members: DataFrame,
    targets: DataFrame,
    cols: Sequence[str],
    link_user: str = "user_id",
    link_key: str = "question_piece_id",
    member_key: str = "user_id",
    target_key: str = "id",
    link_period: Period | None = None,
    target_period: Period | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Target rows reached from members through distinct (user, key) link pairs, each
    with weight ``_w`` = how many such pairs point at it (its multiplicity in the join
    ``pairs JOIN members JOIN targets``).

    Links are shuffled twice: once on (user, salt), which serves the membership test and
    the distinct and spreads a hot user, and once on the key, as counts per key and task,
    so a hot key arrives as one row a task. The join with the targets is per key.
    """
    m = members.select(F.col(member_key).alias(link_user)).distinct()
    pairs = salted_semi_join(restrict(links, link_period, ts), m, link_user, link_key)
    per_key = pairs.groupBy(link_key).agg(F.count(F.lit(1)).alias("_w"))
    t = restrict(targets, target_period, ts).select(
        F.col(target_key).alias(link_key), *[F.col(c) for c in cols]
    )
    return per_key.join(t, link_key)


def _weighted_sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("_w")).otherwise(F.lit(0))).cast("long")


def flag_rate(
    links: DataFrame,
    members: DataFrame,
    targets: DataFrame,
    flag: str = "is_skipped",
    counted: str = "question_id",
    denominator: str = "rows",
    names: Sequence[str] = ("total_question_cnt", "skipped_question_cnt", "skip_rate_pct"),
    **link_args,
) -> DataFrame:
    """S6 flag counts and flag rate over member-linked target rows.

    ``denominator='rows'``: ``COUNT(counted)``, ``SUM(flag = 1)`` and
    ``ROUND(SUM(flag = 1) * 100 / COUNT(*), 2)`` over the joined rows.
    ``denominator='distinct'``: the total and the rate's denominator are
    ``COUNT(DISTINCT counted)`` instead.
    """
    joined = member_linked_targets(links, members, targets, [counted, flag], **link_args)
    flagged = _weighted_sum(F.col(flag) == 1)
    if denominator == "rows":
        # COUNT semantics: 0, not NULL, when nothing is linked.
        total = F.coalesce(_weighted_sum(F.col(counted).isNotNull()), F.lit(0).cast("long"))
        return joined.agg(
            total.alias(names[0]), flagged.alias(names[1]),
            pct(flagged, F.sum("_w")).alias(names[2]),
        )
    if denominator == "distinct":
        total = F.countDistinct(counted)
        return joined.agg(
            total.alias(names[0]), flagged.alias(names[1]), pct(flagged, total).alias(names[2])
        )
    raise ValueError(denominator)


def flag_split(
    links: DataFrame,
    members: DataFrame,
    targets: DataFrame,
    flag: str = "is_skipped",
    names: Sequence[str] = ("skip_0_cnt", "skip_1_cnt"),
    **link_args,
) -> DataFrame:
    """S6 variant: member-linked target rows with flag 0 and with flag 1
    (``SUM(CASE WHEN flag = v THEN 1 ELSE 0 END)``, NULL when nothing is linked)."""
    joined = member_linked_targets(links, members, targets, [flag], **link_args)
    return joined.agg(
        _weighted_sum(F.col(flag) == 0).alias(names[0]),
        _weighted_sum(F.col(flag) == 1).alias(names[1]),
    )
