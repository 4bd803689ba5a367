"""Write PLANS.md: per registered key, the physical plan's shuffles,
broadcasts, Python stages, and each parquet scan's read schema and pushed
filters (the review loop behind the design notes in README.md)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WRITES = {"catalog_sync", "catalog_upsert", "script_ingest", "retry_loop"}     # and every key that ends in _stream
PY_NODES = ("MapInPandas", "MapInArrow", "FlatMapCoGroupsInPandas", "ArrowEvalPython", "BatchEvalPython",
            "FlatMapGroupsInPandas")


def summarize(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[[^\]]*\].*?PushedFilters: \[([^\]]*)\].*?"
                       r"ReadSchema: struct<([^>\n]*(?:<[^>\n]*>)?[^>\n]*)>", plan)
    return {
        "exchanges": plan.count("Exchange "),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": sorted({n for n in PY_NODES if n in plan}),
        "nested_loop": "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan,
        "scans": scans,
    }


def main(sf_dir: str = "/root/testdata/sf0.01", out: str = "PLANS.md") -> None:
    from intentlane.session import build_session
    from intentlane.plans.registry import all_queries
    spark = build_session("local[8]", shuffle_partitions=8)
    lines = ["# PLANS — physical plan summary per query key", "",
             f"Generated by `python tests/plan_report.py` on `{sf_dir}` (initial adaptive plans: "
             "AQE may still turn shuffle joins into broadcasts and coalesce partitions at run time). "
             "Streaming keys and the index jobs write output and are listed without plans; of keys that "
             "write an intermediate table first, the plan after it is shown. "
             "Shuffle counts include the plans of scalar subqueries (the k-NN block counts are "
             "single-partition count aggregations over zero-column scans).", "",
             "| key | shuffles | broadcasts | Python stages | nested loop | scans: read schema / pushed filters |",
             "| --- | --- | --- | --- | --- | --- |"]
    for k, fn in all_queries().items():
        if k in WRITES or k.endswith("_stream"):
            lines.append(f"| {k} | (streaming / writes) | | | | |")
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        scans = "<br>".join(f"`{rs.replace('|', '/')}` / {pf or '—'}" for pf, rs in s["scans"])
        lines.append(f"| {k} | {s['exchanges']} | {s['broadcasts']} | {', '.join(s['python']) or '—'} | "
                     f"{'yes' if s['nested_loop'] else 'no'} | {scans} |")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
