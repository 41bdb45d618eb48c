"""Headline timings.

Runs the method's stages on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is fully
executed through the ``noop`` sink (nothing is collected); each is run three times in
one warm session; the fastest run is reported, and the median beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rolevec.catalog.queries import QUERIES, _stage2  # noqa: E402
from rolevec.operators.reduce import to_vector  # noqa: E402
from rolevec.plans.two_round import two_round_clustering  # noqa: E402
from rolevec.session import checkpointed, local_session  # noqa: E402

HEADLINE = [
    "topk_motions",          # events -> counts -> coverage -> scaling -> top-k
    "unaligned_vectors",     # + padding and per-role vectors
    "align_union",           # dense aligned view
    "column_cost",           # exact score of every column (the slow step of the original)
    "assemble_vectors",      # kept columns -> reduced vectors (the other slow step)
    "cohesion_separation",   # nearest-centre assignment + SSE/SSB on embeddings
    "two_round_clustering",  # bisecting k-means k=6, then k-means k=2, checklist
]


def two_rounds_of_vectors(spark, sf: str):
    """Both clustering rounds on the reduced vectors of the events (the registered query of
    this name clusters points moved apart, for an exact check)."""
    vec = _stage2(spark, sf).vectors
    points = checkpointed(vec.select("id", "label", to_vector("features").alias("features")))
    return two_round_clustering(points, "bkm", 6).checklist


def run(spark, name: str, sf: str) -> float:
    query = two_rounds_of_vectors if name == "two_round_clustering" else QUERIES[name]
    t0 = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=parts, app="rolevec-bench")
    run(spark, "motion_counts", sf)  # JVM / reader warm-up, not reported
    times, middle = {}, {}
    for name in names:
        try:
            runs = sorted(run(spark, name, sf) for _ in range(3))
            times[name], middle[name] = round(runs[0], 3), round(runs[1], 3)
        except Exception as e:  # noqa: BLE001 - report the rest, flag this one
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            times[name] = middle[name] = None
    sf_name = Path(sf).name.removeprefix("sf")
    try:
        sf_val = float(sf_name)
    except ValueError:
        sf_val = sf_name
    print(json.dumps({"metric": "rolevec_headline_total", "value": round(sum(t for t in times.values() if t is not None), 3),
                      "unit": "sec", "queries": times, "median": middle, "sf": sf_val, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
