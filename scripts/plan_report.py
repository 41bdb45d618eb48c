"""Executed (AQE final) physical plans of every registered query, summarised.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Counts per query: parquet scans, shuffle exchanges, broadcast exchanges,
sort-merge and broadcast-hash joins, Python (pandas) nodes and the filters
pushed into the scans; plus, from Spark's event log (written to a fresh
scratch folder), the number of jobs and the shuffle bytes / records written
by all jobs of the query, staging jobs included.
"""

from __future__ import annotations

import json
import re
import sys
import tempfile
import time
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from rolevec.catalog import QUERIES  # noqa: E402
from rolevec.session import checkpoint_dir  # noqa: E402


FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")
SHOWN = {"scans": r"Scan (parquet|text|ExistingRDD)", "shuffles": r"Exchange$", "broadcasts": r"BroadcastExchange", "smj": r"SortMergeJoin",
         "bhj": r"BroadcastHashJoin", "python": r"Pandas|Arrow|Python"}


def executed(log_dir: str) -> list[tuple[float, Counter, set[str]]]:
    """(start in seconds, node counts, pushed filters) of every SQL execution, from the last
    plan that the event log has of it: the one that ran."""
    start, plans = {}, {}
    for f in sorted(p for p in Path(log_dir).rglob("*") if p.is_file()):
        for line in f.open():
            ev = json.loads(line)
            if "sparkPlanInfo" in ev:
                plans[ev["executionId"]] = ev["sparkPlanInfo"]
                if "time" in ev:
                    start[ev["executionId"]] = ev["time"] / 1000
    out = []
    for key, plan in plans.items():
        nodes, pushed, todo = Counter(), set(), [plan]
        while todo:
            node = todo.pop()
            todo += node["children"]
            nodes[node["nodeName"].strip()] += 1
            pushed |= {x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", node["simpleString"]) if x}
        out.append((start.get(key, 0.0), nodes, pushed))
    return out


def shuffle_per_group(log_dir: str) -> dict:
    """Sum task shuffle-write metrics and count jobs per job group."""
    job_group, out = {}, defaultdict(lambda: {"jobs": 0, "bytes": 0, "records": 0})
    stage_group = {}
    for f in sorted(p for p in Path(log_dir).rglob("*") if p.is_file()):
        for line in f.open():
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                if g:
                    out[g]["jobs"] += 1
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
            elif kind == "SparkListenerTaskEnd":
                g = stage_group.get(ev.get("Stage ID"))
                m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                if g:
                    out[g]["bytes"] += m.get("Shuffle Bytes Written", 0)
                    out[g]["records"] += m.get("Shuffle Records Written", 0)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="rolevec-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("rolevec-plans")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    rows = []
    for name, q in QUERIES.items():
        spark.sparkContext.setJobGroup(name, name)
        t0, began = time.perf_counter(), time.time()
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        rows.append((name, began, time.time(), sec))
    spark.stop()
    shuffles = shuffle_per_group(log_dir)
    ran = executed(log_dir)
    hits = Counter(n for _, nodes, _ in ran for n in nodes.elements() if any(x in n for x in FORBIDDEN))
    print(f"# Executed plans of the registered queries ({Path(sf).name}, local[8])\n")
    print("Node counts over all SQL executions of a call (staging jobs and Spark ML's internal queries included), each from "
          "its final plan in the event log.  `jobs` and the shuffle columns are from the same log.  `python` counts pandas, "
          "Arrow and Python nodes.\n")
    print(f"{len(ran)} SQL executions; nested-loop or Cartesian joins and scalar Python functions: {dict(hits) or 'none'}.\n")
    print("| query | sec | jobs | shuffle KB | shuffle rows | scans | shuffles | broadcasts | SMJ | BHJ | python | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, began, ended, sec in rows:
        mine = [(nodes, pushed) for t, nodes, pushed in ran if began <= t <= ended]
        count = {k: sum(v for nodes, _ in mine for n, v in nodes.items() if re.search(x, n)) for k, x in SHOWN.items()}
        filters = "; ".join(sorted({p for _, pushed in mine for p in pushed}))[:160]
        sh = shuffles.get(name, {"jobs": 0, "bytes": 0, "records": 0})
        print(f"| {name} | {sec:.1f} | {sh['jobs']} | {sh['bytes'] / 1024:.0f} | {sh['records']} | " + " | ".join(str(count[k]) for k in SHOWN) + f" | {filters} |")


if __name__ == "__main__":
    main()
