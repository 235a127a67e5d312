"""Top-k entities with a label from a dimension (K1, K2).

The facts are aggregated by the foreign key first (partial aggregation, one row per key
leaves each task), only then joined to the dimension for the label, and the top k is
taken with a bounded per-partition heap (TakeOrderedAndProject). The join is between
two per-key relations; Catalyst/AQE broadcast the dimension when its measured size is
small and keep a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.exprs import DIV_EXTRA_DIGITS, dround
from cohortscope.plans.period import Period, restrict


SUM_TYPE = "decimal(28,8)"  # sums as decimal(38,8): exact in any order


def _label_and_rank(
    per_key: DataFrame, dim: DataFrame, fk: str, pk: str, label: str, order_col: str, k: int,
    dim_period: Period | None, dim_ts: str,
) -> DataFrame:
    labels = restrict(dim, dim_period, dim_ts).select(F.col(pk).alias(fk), F.col(label))
    joined = per_key.join(labels, fk)
    return joined.orderBy(F.col(order_col).desc(), F.col(fk), F.col(label)).limit(k)


def top_k_entities(
    facts: DataFrame,
    dim: DataFrame,
    fk: str = "question_id",
    pk: str = "id",
    label: str = "question_text",
    k: int = 10,
    name: str = "vote_cnt",
    where: Column | None = None,
    facts_period: Period | None = None,
    dim_period: Period | None = None,
    ts: str = "created_at",
    dim_ts: str = "created_at",
) -> DataFrame:
    """K1 top-k keys by fact row count, with the dimension's label.

    Facts without a matching dimension row are dropped (inner join); ties are broken by
    the key, so the result is a function of the data.
    """
    f = restrict(facts, facts_period, ts)
    if where is not None:
        f = f.filter(where)
    per_key = f.groupBy(fk).agg(F.count(F.lit(1)).alias(name))
    out = _label_and_rank(per_key, dim, fk, pk, label, name, k, dim_period, dim_ts)
    return out.select(fk, label, name)


def top_k_measures(
    facts: DataFrame,
    dim: DataFrame,
    measure: str = "opened_times",
    fk: str = "question_id",
    pk: str = "id",
    label: str = "question_text",
    k: int = 10,
    where: Column | None = None,
    facts_period: Period | None = None,
    dim_period: Period | None = None,
    ts: str = "created_at",
    dim_ts: str = "created_at",
    digits: int = DIV_EXTRA_DIGITS,
) -> DataFrame:
    """K2 per key: SUM, AVG and COUNT of a measure, top k by the sum.

    The measure is summed as a decimal, so the total and the ranking do not depend on the
    order in which partial sums meet. Sum and mean are then rounded to ``digits`` decimals
    (the dialect's AVG keeps 4). A key with a value too large for the decimal (1e20 and
    beyond, infinite) is summed as a double.
    """
    f = restrict(facts, facts_period, ts)
    if where is not None:
        f = f.filter(where)
    exact = F.col(measure).try_cast(SUM_TYPE)
    plain = F.col(measure).try_cast("double")
    large = F.coalesce(F.bool_or(exact.isNull() & plain.isNotNull()), F.lit(False))
    total = F.when(large, F.sum(plain)).otherwise(F.sum(exact).cast("double"))
    n = F.when(large, F.count(plain)).otherwise(F.count(exact))
    per_key = f.groupBy(fk).agg(
        dround(total, digits).alias(f"total_{measure}"),
        dround(F.try_divide(total, n), digits).alias(f"avg_{measure}"),
        F.count(F.lit(1)).alias("record_cnt"),
    )
    out = _label_and_rank(per_key, dim, fk, pk, label, f"total_{measure}", k, dim_period, dim_ts)
    return out.select(fk, label, f"total_{measure}", f"avg_{measure}", "record_cnt")
