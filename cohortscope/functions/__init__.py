"""Column-expression helpers (built-in Spark expressions only)."""

from cohortscope.functions.exprs import *  # noqa: F401,F403
