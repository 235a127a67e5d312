"""cohortscope: product-analytics operators on Spark DataFrames.

Every operator takes DataFrames, column names and explicit periods and returns a
DataFrame built from built-in Spark expressions only, so Catalyst plans all of it
(pushdown, pruning, partial aggregation, AQE) and nothing is collected to the driver.

Layout:
    functions/  column-expression helpers that pin down the SQL semantics (dates,
                division and rounding, NULLs, JSON lists)
    sources/    table loading, the JSON-list source, schema inspection and the
                bindings from the driver tables to the logical tables
    operators/  the analyses (profiling, lists, activity, top-k, cohorts, segments,
                time to event, retention, eligibility)
    plans/      periods, size-checked broadcast, plan checks and the named query set
    streaming/  the same operators applied per micro-batch of a file stream
"""

from cohortscope.plans.period import Period
from cohortscope.session import build_session, configure

__all__ = ["Period", "build_session", "configure"]
