"""Sweep of the two-round clustering over a range of k and repeated rounds.

Every (k, round) is an independent pair of fits over the same cached points.  First fits by
bisecting k-means go on together, in shared passes; the rest run from a small bounded thread
pool (as Spark ML's own ``parallelism`` does).  Per-cluster summaries -- at most k + 2 rows
each -- form one report DataFrame.

With a ledger, every finished fit's summary is a folder of its own under it, named by
(model, k, round, seed) and committed with the fit, so a sweep that was interrupted fits
only what is missing.  Rows carry a fingerprint of the points; a ledger of other points
is refused."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.bisecting import bisecting_fits
from rolevec.operators.cluster import extent, fit_predict, in_order
from rolevec.operators.evaluate import best_of, cluster_summary, count_positives
from rolevec.session import checkpointed, stage_table, staging
from rolevec.sinks.text import format_assignments, write_lines

SWEEP_SCHEMA = ("model string, k int, round int, stage int, prediction int, n long, n_bad long, "
                "n_good long, recall double, precision double")


#: Points of up to so many tasks (256 MB of doubles) may have a copy per running fit.
COPY_TASKS = 32


def sweep(points: DataFrame, model: str = "km", k_lo: int = 3, k_hi: int = 6, rounds: int = 10,
          base_seed: int = defaults.FINAL_SEED, parallelism: int = 4,
          max_iter: int = defaults.FINAL_MAX_ITER,
          min_divisible: float = defaults.MIN_DIVISIBLE_SIZE,
          assignments_path: str | None = None, ledger: str | None = None, both_halves: bool = False) -> DataFrame:
    """``(model, k, round, stage, prediction, n, n_bad, n_good, recall, precision)``;
    stage 1 = first clustering, stage 2 = second.  Round ``r`` uses seed
    ``base_seed + r``: repeatable, different per round.  With
    ``assignments_path`` every fit's rows are also written as
    ``id,label,prediction,v,...`` lines under ``k=K/round=R/stage=S``.  With ``ledger`` (a
    folder that all executors share) fits listed there are read instead of repeated, and
    new ones are added.  Where all points of the chosen cluster are equal, the second clustering
    has one cluster; with ``both_halves`` its empty half is a row of no points, too."""
    if k_lo <= 0 or k_hi <= 0 or k_lo > k_hi:
        raise ValueError(f"invalid k range {k_lo}..{k_hi}")
    if rounds <= 0:
        raise ValueError(f"number of rounds must be positive, got {rounds}")
    if model not in defaults.MODELS:
        raise ValueError(f"model must be one of {defaults.MODELS}, got {model!r}")
    spark: SparkSession = points.sparkSession
    n_bad = count_positives(points).first()["n_bad"]
    if not n_bad:
        raise ValueError("no known cases (label 1) among the points: recall is undefined")
    total = F.lit(int(n_bad))

    def one(job):
        with staging(spark):
            return fits(*job)

    def fits(k, r):
        seed = base_seed + r
        _, a1 = fit_predict(points, model, k, max_iter=max_iter, seed=seed, min_divisible=min_divisible,
                            coincide=coincide, fitted=trees.get((k, seed)))
        s1 = cluster_summary(a1, total).collect()  # at most k rows
        sus1 = stage_table(a1.where(F.col("prediction") == best_of(s1)).drop("prediction"), "sweep-suspicious")
        split, a2 = fit_predict(sus1, "km", defaults.SECOND_ROUND_K,
                            max_iter=defaults.SECOND_ROUND_MAX_ITER, seed=seed)
        s2 = cluster_summary(a2, total).collect()
        if both_halves and split is None:
            s2 += [Row(prediction=j, n=0, n_bad=0, n_good=0, recall=0.0, precision=None) for j in range(1, defaults.SECOND_ROUND_K)]
        if assignments_path:
            for stage, a in ((1, a1), (2, a2)):
                write_lines(format_assignments(a.withColumn("features", vector_to_array("features"))),
                            f"{assignments_path.rstrip('/')}/k={k}/round={r}/stage={stage}")
        out = []
        for stage, s in ((1, s1), (2, s2)):
            for row in s:
                out.append((model, k, r, stage, row["prediction"], row["n"], row["n_bad"], row["n_good"],
                            row["recall"], row["precision"]))
        return out

    def kept(job):
        """One fit, entered in the ledger once it is done."""
        rows = one(job)
        if ledger:
            k, r = job
            entry = spark.createDataFrame([(*row, stamp) for row in rows], SWEEP_SCHEMA + ", points string").coalesce(1)
            # an attempt that was cut off left no rows: files appear when the job commits
            entry.write.mode("overwrite").parquet(ledger_entry(ledger, model, k, r, base_seed + r))
        return rows

    jobs = [(k, r) for k in range(k_lo, k_hi + 1) for r in range(1, rounds + 1)]
    finished: list[tuple] = []
    if ledger:
        stamp = fingerprint(points, max_iter, min_divisible, *(["both_halves"] if both_halves else []))
        known = read_ledger(spark, ledger)
        if known is not None:
            if not known.where(F.col("points") != stamp).isEmpty():
                raise ValueError(f"the ledger {ledger} holds fits of other points or settings")
            wanted = spark.createDataFrame([(model, k, r, base_seed + r) for k, r in jobs], "model string, k int, round int, seed long")
            found = known.join(F.broadcast(wanted), ["model", "k", "round", "seed"], "left_semi")  # one row per fit of this sweep
            finished = [tuple(x) for x in found.select(*[c.split()[0] for c in SWEEP_SCHEMA.split(", ")]).collect()]  # at most k + 2 rows each
        done = {(x[1], x[2]) for x in finished}
        jobs = [j for j in jobs if j not in done]
        if not jobs:
            return spark.createDataFrame(finished, SWEEP_SCHEMA)
    coincide, tasks = extent(points)  # once for all fits
    # Dealt once for all fits, as many tasks as their size needs.  Spark ML keeps uncached
    # points as vectors, a copy per running fit, and goes over them in under half the time
    # of a cached frame, whose rows are decoded in every pass; large points share one
    # cached frame all the same.
    shared = False
    if points.storageLevel == StorageLevel.NONE:
        points = in_order(points, tasks)
        shared = tasks > COPY_TASKS
        points = points.persist(StorageLevel.MEMORY_AND_DISK) if shared else checkpointed(points)
    try:
        trees = {}
        if model == "bkm" and not coincide:
            # first fits of all jobs together: a pass reads the points once for all of them
            wanted = [(k, base_seed + r) for k, r in jobs]
            trees = dict(zip(wanted, bisecting_fits(points, wanted, max_iter, min_divisible)))
        # inheritable targets: each fit's jobs carry the caller's job group and
        # scheduler pool, so they can be cancelled and accounted together
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = [row for part in pool.map(inheritable_thread_target(spark)(kept), jobs) for row in part]
    finally:
        if shared:
            points.unpersist()
    return spark.createDataFrame(finished + rows, SWEEP_SCHEMA)


def ledger_entry(ledger: str, model: str, k: int, r: int, seed: int) -> str:
    return f"{ledger.rstrip('/')}/fit_model={model}/fit_k={k}/fit_round={r}/seed={seed}"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Rows of all finished fits with their ``seed`` and the fingerprint of their ``points``;
    None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    schema = SWEEP_SCHEMA + ", points string, fit_model string, fit_k int, fit_round int, seed long"
    return spark.read.schema(schema).parquet(ledger).drop("fit_model", "fit_k", "fit_round")


def fingerprint(points: DataFrame, *settings) -> str:
    """Number and hash of the points, and the settings of the fits."""
    values = points.select(F.xxhash64("id", "label", vector_to_array("features")).alias("h"))
    got = values.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"), F.sum((F.col("h") % 1_000_003)).alias("s")).first()
    return "/".join(str(x) for x in (*got, *settings))
