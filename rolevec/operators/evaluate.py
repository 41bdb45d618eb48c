"""Cluster summaries against known cases, the suspicious cluster, checklist
and conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = 1


def count_positives(assigned: DataFrame, label_col: str = "label") -> DataFrame:
    """One row ``n_bad``: the number of known cases."""
    return assigned.agg(F.count_if(F.col(label_col) == POSITIVE).alias("n_bad"))


def cluster_summary(assigned: DataFrame, n_bad: Column, label_col: str = "label") -> DataFrame:
    """``(prediction, n, n_bad, n_good, recall, precision)``.

    ``recall`` = known cases in the cluster / all known cases (``n_bad``, a
    scalar column, so a second round stays relative to the first round's
    total); ``precision`` = known cases in the cluster / cluster size.  NULL
    when there are no known cases."""
    per = assigned.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label_col) == POSITIVE).alias("n_bad"))
    return per.select(
        F.col("prediction").cast("int").alias("prediction"), "n", "n_bad",
        (F.col("n") - F.col("n_bad")).alias("n_good"),
        F.try_divide(F.col("n_bad").cast("double"), n_bad.cast("double")).alias("recall"),
        F.try_divide(F.col("n_bad").cast("double"), F.col("n").cast("double")).alias("precision"))


def best_cluster(summary: DataFrame) -> DataFrame:
    """One row: the cluster with the highest recall (ties: higher precision,
    then lower cluster id).  A top-1 report, hence the limit."""
    return (summary.orderBy(F.col("recall").desc_nulls_last(), F.col("precision").desc_nulls_last(),
                            F.col("prediction").asc())
            .limit(1))


def best_of(summary: list) -> int:
    """The cluster that :func:`best_cluster` chooses, from collected summary rows."""
    low = float("-inf")
    key = lambda r: (-(low if r["recall"] is None else r["recall"]), -(low if r["precision"] is None else r["precision"]), r["prediction"])
    return min(summary, key=key)["prediction"]


def suspicious_rows(assigned: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of the chosen cluster (``best`` has one row: a bounded broadcast)."""
    return assigned.join(F.broadcast(best.select("prediction")), on="prediction", how="left_semi")


def checklist(assigned: DataFrame, suspicious: DataFrame, id_col: str = "id",
              label_col: str = "label") -> DataFrame:
    """``(id, label, prediction)`` for every row of ``assigned``: prediction 1
    when the id is among the final suspicious rows."""
    ids = suspicious.select(id_col).distinct().withColumn("_hit", F.lit(1))
    return (assigned.select(id_col, label_col).join(ids, on=id_col, how="left")
            .select(id_col, F.col(label_col).cast("int").alias("label"),
                    F.coalesce(F.col("_hit"), F.lit(0)).cast("int").alias("prediction")))


def evaluation_report(summary1: DataFrame, summary2: DataFrame, n_bad: Column) -> DataFrame:
    """One row ``(cluster_1, cluster_2, n_bad, detected, recall)``: chosen
    clusters of both rounds, all known cases, those in the final cluster, and
    its recall.  The second round's values come in as scalar subqueries."""
    b2 = best_cluster(summary2)
    return best_cluster(summary1).select(
        F.col("prediction").alias("cluster_1"),
        b2.select("prediction").scalar().alias("cluster_2"),
        n_bad.cast("long").alias("n_bad"),
        b2.select("n_bad").scalar().alias("detected"),
        b2.select("recall").scalar().alias("recall"),
    )


def round_checks(rounds) -> DataFrame:
    """One row of what must hold for the two rounds (``plans.two_round.TwoRounds``) from any start:
    ``n``, ``n_bad`` (of the checklist), ``clusters`` and ``recall_sum`` of the first round, and how
    often a rule is broken: ``unlisted`` ids that aren't listed once, ``outside`` (second-round
    points not in the chosen cluster), ``lost`` (points of it missing there), ``better`` (clusters
    with a higher recall than the chosen one, in either round), ``marked`` (listed as suspicious
    without being so, or the other way round), ``recall_gap`` of the second round's recalls to the
    first one's chosen cluster, ``detected_gap`` of the report to the checklist."""
    c = rounds.checklist.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == POSITIVE).alias("n_bad"),
                             (F.count(F.lit(1)) - F.count_distinct("id")).alias("unlisted"),
                             F.count_if((F.col("label") == POSITIVE) & (F.col("prediction") == 1)).alias("_found"))
    s1 = rounds.summary1.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.sum("recall"), 9).alias("recall_sum"), F.max("recall").alias("_best1"))
    s2 = rounds.summary2.agg(F.round(F.sum("recall"), 9).alias("_sum2"), F.max("recall").alias("_best2"))
    chosen = rounds.suspicious1.select("id", F.col("prediction").alias("_p"))
    met = rounds.assigned2.select("id", F.lit(1).alias("_in2")).join(chosen, "id", "full")
    inside = met.agg(F.count_if(F.col("_p").isNull()).alias("outside"), F.count_if(F.col("_in2").isNull()).alias("lost"))
    marks = (rounds.checklist.select("id", F.col("prediction").alias("_m"))
             .join(rounds.suspicious2.select("id", F.lit(1).alias("_s")), "id", "full").agg(F.count_if(F.coalesce("_m", F.lit(-1)) != F.coalesce("_s", F.lit(0))).alias("marked")))
    r = rounds.report.select(F.col("detected").alias("_detected"), F.col("recall").alias("_recall"), F.col("cluster_1").alias("_c1"))
    first = best_cluster(rounds.summary1).select(F.col("recall").alias("_chosen"))
    one = c
    for part in (s1, s2, inside, marks, r, first):
        one = one.crossJoin(part)  # one row each
    better = ((F.col("_chosen") < F.col("_best1")).cast("long") + (F.col("_recall") < F.col("_best2")).cast("long"))
    return one.select("n", "n_bad", "clusters", "recall_sum", "unlisted", "outside", "lost", better.alias("better"), "marked",
                      F.round(F.abs(F.col("_sum2") - F.col("_chosen")), 6).alias("recall_gap"), F.abs(F.col("_detected") - F.col("_found")).alias("detected_gap"))


def sweep_checks(swept: DataFrame) -> DataFrame:
    """``(model, k, round, n, n_bad, clusters, recall_sum, halves, n_gap, bad_gap, recall_gap)`` per fit:
    what the first clustering adds up to, the number of second clusters, and the distance of the
    second clustering's sums to a first cluster of the highest recall (0: it split exactly that one)."""
    first, second = (F.col("stage") == s for s in (1, 2))
    best = F.max(F.when(first, F.struct("recall", "precision", -F.col("prediction"), "n", "n_bad")))

    def total(stage, c):
        return F.sum(F.when(stage, F.col(c)))

    per = swept.groupBy("model", "k", "round").agg(
        total(first, "n").alias("n"), total(first, "n_bad").alias("n_bad"), F.count_if(first).alias("clusters"), F.round(total(first, "recall"), 9).alias("recall_sum"),
        F.count_if(second).alias("halves"), best.alias("_b"), total(second, "n").alias("_n2"), total(second, "n_bad").alias("_bad2"), total(second, "recall").alias("_r2"))
    return per.select("model", "k", "round", "n", "n_bad", "clusters", "recall_sum", "halves", (F.col("_n2") - F.col("_b.n")).alias("n_gap"), (F.col("_bad2") - F.col("_b.n_bad")).alias("bad_gap"),
                      F.round(F.abs(F.col("_r2") - F.col("_b.recall")), 9).alias("recall_gap"))
