"""Analytic operators. Each takes DataFrames and column names, returns a DataFrame."""

from cohortscope.operators import (  # noqa: F401
    activity,
    cohort,
    eligibility,
    lists,
    profile,
    retention,
    segments,
    timing,
    topk,
)
