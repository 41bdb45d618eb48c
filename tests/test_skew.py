"""A user holding most of the events: bounded records, same results."""

from pyspark.sql import functions as F

from rolevec.operators.counts import explode_sequences, motion_counts
from rolevec.plans.vectorize import vectorize
from rolevec.sources.events import level_records


def _tokens(spark, n_heavy=20000):
    # user 1: n_heavy events at level 2; users 2..5: a few events each, levels 2..3
    heavy = spark.range(n_heavy).select(
        F.lit(1).cast("long").alias("role"), F.lit(2).alias("level"),
        F.timestamp_seconds(F.pmod("id", F.lit(20)) * 86400 + F.col("id") % 86400).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"),
        F.concat_ws("@", F.col("id").cast("string"),
                    F.concat(F.lit("m"), F.pmod("id", F.lit(7)).cast("string")), F.lit("p")).alias("token"))
    light = spark.range(n_heavy, n_heavy + 40).select(
        (F.pmod("id", F.lit(4)) + 2).cast("long").alias("role"), (F.pmod("id", F.lit(2)) + 2).cast("int").alias("level"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"),
        F.concat_ws("@", F.col("id").cast("string"), F.lit("m1"), F.lit("p")).alias("token"))
    extra = spark.range(n_heavy + 40, n_heavy + 41).select(
        F.lit(1).cast("long").alias("role"), F.lit(3).alias("level"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"),
        F.lit("x@m1@p").alias("token"))
    return heavy.unionByName(light).unionByName(extra)


def test_heavy_level_is_split_into_bounded_records(spark):
    toks = _tokens(spark)
    recs = level_records(toks)
    sizes = [r.n for r in recs.select(F.size("seqs").alias("n"), "role", "mark")
             .where("role = '1' AND mark = '2'").collect()]
    assert len(sizes) == 20 and max(sizes) == 1000 and sum(sizes) == 20000  # one record per day
    # no token lost or duplicated, and counts equal counting the events directly
    got = {(int(r.role), r.level, r.motion): r.cnt for r in motion_counts(explode_sequences(recs)).collect()}
    want = {(r.role, r.level, r.motion): r.cnt for r in toks.select(
        "role", "level", F.split("token", "@")[1].alias("motion")).groupBy("role", "level", "motion")
        .agg(F.count(F.lit(1)).alias("cnt")).collect()}
    assert got == want


def test_heavy_user_vectorizes_like_light_users(spark):
    toks = _tokens(spark)
    rows = explode_sequences(level_records(toks))
    v = vectorize(rows, spark.createDataFrame([(1,)], "id long"), 2, 3, 3)
    padded = v.padded.collect()
    assert len(padded) == len({(r.role, r.level) for r in padded}) * 3
    heavy = sorted((r.slot, r.motion) for r in padded if r.role == "1" and r.level == 2)
    # only user 1 covers both levels: every value scales to 0, ties go by name
    assert [m for _, m in heavy] == ["m0", "m1", "m2"]
    assert {r.role for r in padded} == {"1"}


def test_column_of_a_million_values(spark):
    """One column with 10^6 distinct values among small ones: histogram, distinct values and
    the iterated score need no list of them."""
    from rolevec.operators.colcost import column_cost_kmeans, column_distinct, column_histogram, informative_columns

    n = 1_000_000
    big = spark.range(n).select("id", F.lit(2).alias("level"), F.lit("big").alias("motion"), (F.col("id") / 7).alias("value"))
    small = spark.range(1000).select("id", F.lit(2).alias("level"), F.lit("small").alias("motion"), (F.col("id") % 3 + 1).cast("double").alias("value"))
    hist = column_histogram(big.unionByName(small), F.lit(n))
    plan = hist._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan and "Pandas" not in plan
    got = {r.motion: r.n_distinct for r in column_distinct(hist).collect()}
    assert got == {"big": n, "small": 4}
    assert [r.motion for r in informative_columns(column_distinct(hist), 5).collect()] == ["big"]
    cost = {r.motion: r.cost for r in column_cost_kmeans(hist, 5).collect()}
    step = n / 7 / 5  # evenly spread values: five equal runs are the optimum
    assert cost["small"] == 0.0 and abs(cost["big"] - n * step**2 / 12) < 1e-3 * cost["big"]


def test_busy_days_are_parted_evenly(spark):
    """A user with a third of all events: records stay short, and no task gets much more than the others."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 400 + 2).cast("long").alias("role"), F.lit(2).alias("level"),
        F.timestamp_seconds((F.col("id") % 5) * 86400 + F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # records go on over batches
        out = level_records(rows, 100).select("role", "seqs", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    load: dict[int, int] = {}
    for r in out:
        load[r.p] = load.get(r.p, 0) + len(r.seqs)
    sizes = sorted(load.values())
    assert len(sizes) == 32 and sizes[-1] <= 3 * sizes[16]
    assert max(len(r.seqs) for r in out) <= 160  # parts by a hash are about even
    assert all(list(r.seqs) == sorted(r.seqs, key=lambda t: ((int(t[1:]) % 5) * 86400 + int(t[1:]), int(t[1:]))) for r in out)
    assert sorted(int(t[1:]) for r in out for t in r.seqs) == list(range(n))
