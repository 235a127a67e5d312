"""Group-based eligibility (E1-E5): users in large enough classes of large enough schools.

Users are counted per class with partial aggregation, and only those per-class rows meet
the class and school tables. So a class holding a third of all users is one row per task
when it is shuffled, and no join carries raw users on the class key. The user id is the
key of the user table: a user is in one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import PCT_DECIMAL_KEEP, pct
from cohortscope.plans.period import Period, restrict


def qualified_groups(
    users: DataFrame, group: str = "group_id", member: str = "id", min_members: int = 4,
    name: str = "member_cnt",
) -> DataFrame:
    """E1 groups with at least ``min_members`` distinct members (the NULL group too)."""
    return (
        users.groupBy(group)
        .agg(F.countDistinct(member).alias(name))
        .filter(F.col(name) >= min_members)
    )


def qualified_group_count(
    users: DataFrame, group: str = "group_id", member: str = "id", min_members: int = 4,
    name: str = "class_cnt",
) -> DataFrame:
    """E2 how many groups qualify."""
    return qualified_groups(users, group, member, min_members).agg(F.count(F.lit(1)).alias(name))


def large_parents(schools: DataFrame, min_size: int, size_col: str = "student_count") -> DataFrame:
    return schools.filter(F.col(size_col) >= min_size).select(F.col("id").alias("school_id"))


def class_sizes(
    users: DataFrame, voters: DataFrame | None = None, group: str = "group_id",
    member: str = "id", voter_key: str = "user_id",
) -> DataFrame:
    """Per class: ``members`` and, with ``voters``, how many members are ``voters``.

    Users meet voters one to one on the user key before they are counted.
    """
    u = users.select(F.col(group), F.col(member).alias("_id")).distinct()
    if voters is None:
        return u.groupBy(group).agg(F.count("_id").alias("members"))
    v = voters.select(F.col(voter_key).alias("_id")).distinct().withColumn("_v", F.lit(1))
    return u.join(v, "_id", "left").groupBy(group).agg(
        F.count("_id").alias("members"), F.count("_v").alias("voters")
    )


def eligible_classes(
    sizes: DataFrame, groups: DataFrame, schools: DataFrame, min_school: int, min_class: int,
    group: str = "group_id",
) -> DataFrame:
    """The rows of ``sizes`` whose class is large enough and belongs to a large school."""
    in_large = groups.join(large_parents(schools, min_school), "school_id", "left_semi").select(
        F.col("id").alias(group)
    )
    return sizes.filter(F.col("members") >= min_class).join(in_large, group, "left_semi")


def eligible_population(
    users: DataFrame, groups: DataFrame, schools: DataFrame, min_school: int = 40,
    min_class: int = 4, group: str = "group_id", member: str = "id",
) -> DataFrame:
    """E3 eligible users and the classes they are in: a sum and a count over classes."""
    classes = eligible_classes(
        class_sizes(users, group=group, member=member), groups, schools, min_school, min_class, group
    )
    return classes.agg(
        F.coalesce(F.sum("members"), F.lit(0)).cast("long").alias("student_cnt"),
        F.count(group).alias("group_cnt"),
    )


def eligible_conversion(
    users: DataFrame, groups: DataFrame, schools: DataFrame, voters: DataFrame,
    min_school: int = 40, min_class: int = 4, group: str = "group_id", member: str = "id",
    voter_key: str = "user_id", voter_period: Period | None = None, ts: str = "created_at",
) -> DataFrame:
    """E4 eligible users, how many of them voted (in the period), and the share
    (``ROUND(voters * 100.0 / eligible, 2)``)."""
    sizes = class_sizes(users, restrict(voters, voter_period, ts), group, member, voter_key)
    classes = eligible_classes(sizes, groups, schools, min_school, min_class, group)
    n = F.coalesce(F.sum("members"), F.lit(0)).cast("long")
    v = F.coalesce(F.sum("voters"), F.lit(0)).cast("long")
    return classes.agg(
        n.alias("eligible_student_cnt"), v.alias("voted_student_cnt"),
        pct(v, n, keep=PCT_DECIMAL_KEEP).alias("voted_ratio"),
    )


def members_in_large_parents(
    users: DataFrame, groups: DataFrame, schools: DataFrame, min_school: int = 40,
    group: str = "group_id", name: str = "cnt",
) -> DataFrame:
    """E5 ``COUNT(u.group_id)`` of users whose class belongs to a large school.

    Users are counted per class first (partial aggregation), then joined to the class
    and school tables; join multiplicities are kept as in an inner join chain.
    """
    per_group = users.groupBy(group).agg(F.count(F.col(group)).alias("_n"))
    classes = groups.select(F.col("id").alias(group), "school_id").join(
        large_parents(schools, min_school), "school_id"
    )
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("long")
    return per_group.join(classes, group).agg(total.alias(name))
