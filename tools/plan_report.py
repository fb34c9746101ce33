"""Plan report: the physical plan shape of every registered query, as Spark would
plan it on a cluster where no dimension is small enough to broadcast.

    python tools/plan_report.py [--sf /root/testdata/sf0.1] [--out PLANS.md]

Broadcasting is switched off (``spark.sql.autoBroadcastJoinThreshold=-1``), so every join shows the shuffle it
needs at 100 TB. Counted per query: shuffle exchanges, join strategies,
aggregate kinds, windows (and partial window-group limits), scans with pushed
filters, and operators that fall back to Python.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "exchanges": r"^\s*[:+\- ]*Exchange \(",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin|CartesianProduct",
    "hash_agg": r"^\s*[:+\- ]*HashAggregate \(",
    "sort_agg": r"^\s*[:+\- ]*SortAggregate \(",
    "obj_agg": r"^\s*[:+\- ]*ObjectHashAggregate \(",
    "window": r"^\s*[:+\- ]*Window \(",
    "group_limit": r"WindowGroupLimit",
    "python": r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython",
}


def shape(plan: str) -> dict:
    tree = plan.split("\n\n")[0]
    out = {k: len(re.findall(p, tree, re.M)) for k, p in PATTERNS.items()}
    out["scans"] = len(re.findall(r"^\(\d+\) Scan ", plan, re.M))
    out["pushed"] = len(re.findall(r"PushedFilters: \[[^\]]+\]", plan))
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default=None)
    ap.add_argument("--trees", default="agg_active_usage,join_fip_chain,quota_usage,stat_by_period,tail_n,word_count",
                    help="comma-separated keys whose plan trees are appended")
    args = ap.parse_args()
    tree_keys = [k for k in args.trees.split(",") if k]
    trees: dict[str, str] = {}

    from cirrus.session import get_session
    from cirrus.plans import registry

    spark = get_session("local[8]", shuffle_partitions=8,
                        extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    lines = ["| key | exchanges | SMJ | BHJ | nested-loop | hash agg | sort agg | object agg | window | "
             "group limit | python | scans | scans with pushed filters |",
             "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    registry.load_all()
    for k, fn in registry.QUERIES.items():
        if k.startswith("stream_"):
            continue  # streams run while being built; their batch twins are reported
        buf = io.StringIO()
        try:
            df = fn(spark, args.sf)
            with contextlib.redirect_stdout(buf):
                df.explain("formatted")
        except Exception as e:  # noqa: BLE001
            lines.append(f"| `{k}` | error: {type(e).__name__} |")
            continue
        s = shape(buf.getvalue())
        if k in tree_keys:
            trees[k] = buf.getvalue().split("\n\n")[0]
        lines.append(f"| `{k}` | " + " | ".join(str(s[c]) for c in
                     ["exchanges", "smj", "bhj", "bnlj", "hash_agg", "sort_agg", "obj_agg", "window",
                      "group_limit", "python", "scans", "pushed"]) + " |")
    text = "\n".join(lines)
    for k in tree_keys:
        if k in trees:
            text += f"\n\n### `{k}`\n\n```\n{trees[k]}\n```"
    if args.out:
        with open(args.out, "w") as f:
            f.write(text + "\n")
    print(text)
    spark.stop()


if __name__ == "__main__":
    main()
