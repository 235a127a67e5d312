"""Summarise the physical plan of every registered query (for PLANS.md).

Usage: python tools/plan_report.py [sf_dir] > plan_table.md
Counts scans, shuffles (Exchange), broadcast and sort-merge joins, top-k heaps,
Expand (multi-distinct) nodes, and lists the filters pushed into each scan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortscope.plans.catalog import REGISTRY, queries  # noqa: E402
from cohortscope.plans.guards import physical_plan, plan_violations  # noqa: E402
from cohortscope.session import build_session  # noqa: E402


def count(pattern: str, text: str) -> int:
    return len(re.findall(rf"\(\d+\) {pattern}\b", text))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]")
    print("| query | op | scans | shuffles | BHJ | SMJ | top-k heap | Expand | pushed filters | forbidden |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in queries().items():
        df = fn(spark, sf_dir)
        plan = physical_plan(df)
        scans = re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/(\w+)\.parquet\]", plan)
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p
                         and not all(x.startswith("IsNotNull") for x in p.split(", "))})
        pushed_txt = "; ".join(
            ", ".join(x for x in p.split(", ") if not x.startswith("IsNotNull")) for p in pushed
        ) or "–"
        print(
            f"| {name} | {REGISTRY[name].operator} | {', '.join(scans)} | {count('Exchange', plan)} "
            f"| {count('BroadcastHashJoin', plan)} | {count('SortMergeJoin', plan)} "
            f"| {'yes' if 'TakeOrderedAndProject' in plan else ''} | {count('Expand', plan)} "
            f"| {pushed_txt} | {', '.join(plan_violations(df)) or 'none'} |"
        )


if __name__ == "__main__":
    main()
