"""Write PLANS.md: a compact view of the executed physical plan of every registered query.

For each query: the Parquet scans (columns read, filters pushed), shuffle exchanges by kind, join
strategies, window / window-group-limit operators, Python evaluation nodes and reads of
checkpointed data.  Usage: ``python scripts/plan_summary.py [sf_dir] [output]``.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

#: joins above this size shuffle, so the plans show what happens when tables outgrow a broadcast
THRESHOLD = "64k"
CORES = int(os.environ.get("PLAN_CPUS", "8"))


def summarize(plan: str) -> dict[str, object]:
    scans = sorted(set(
        f"{m.group(2)} filters={m.group(1) or '[]'}"
        for m in re.finditer(r"PushedFilters: (\[[^\]\n]*\])?[^\n]*?ReadSchema: (struct<[^\n]*)", plan)))
    exchanges = Counter(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan))
    joins = Counter(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan))
    return {
        "scans": scans,
        "exchanges": dict(exchanges),
        "joins": dict(joins),
        "windows": plan.count("Window ["),
        "window_group_limits": plan.count("WindowGroupLimit"),
        "python": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython"),
        "checkpoint_reads": plan.count("Scan ExistingRDD"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "PLANS.md")
    from tabsieve.session import get_spark
    spark = get_spark(f"local[{CORES}]", **{"spark.sql.autoBroadcastJoinThreshold": THRESHOLD,
                                     "spark.sql.adaptive.autoBroadcastJoinThreshold": THRESHOLD})
    import tabsieve.plans.queries  # noqa: F401  (registers every query)
    from tabsieve.plans.catalog import QUERIES

    lines = ["# Executed plans of the registered queries", "",
             f"Generated by `scripts/plan_summary.py` on `{os.path.basename(sf_dir)}` (local[{CORES}], AQE on, "
             f"broadcast threshold {THRESHOLD}: below the tables' sizes, as at scale). "
             "Final adaptive plans (after AQE's runtime re-planning). Scans show the columns read and the "
             "filters pushed into Parquet; `checkpoint reads` are "
             "reads of data materialised earlier by `checkpoint()` (ranks, quantile slices, fuzzy rounds).", ""]
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()  # run this DataFrame's own query so AQE's final plan is available
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarize(final)
        lines.append(f"## {name}")
        for scan in s["scans"]:
            lines.append(f"- scan `{scan}`")
        lines.append(f"- exchanges {s['exchanges'] or '{}'}; joins {s['joins'] or '{}'}; windows {s['windows']} "
                     f"(group-limit {s['window_group_limits']}); python {s['python']}; "
                     f"checkpoint reads {s['checkpoint_reads']}")
        lines.append("")
    with open(out, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines))
    print(out)


if __name__ == "__main__":
    main()
