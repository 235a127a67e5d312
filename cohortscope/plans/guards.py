"""Plan checks."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


# Operators that must never appear in our plans: a Python UDF in the hot path, or a
# join that pairs every row with every row.
FORBIDDEN_NODES = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


def plan_violations(df: DataFrame) -> list[str]:
    text = physical_plan(df)
    return [node for node in FORBIDDEN_NODES if node in text]
