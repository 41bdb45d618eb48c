"""Two-round clustering: cluster everything, keep the cluster that holds the
most known cases, split it again with k-means (k = 2), keep the best half.
Recall stays relative to all known cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.cluster import fit_predict
from rolevec.session import stage_table
from rolevec.operators.evaluate import (
    best_cluster,
    checklist,
    cluster_summary,
    count_positives,
    evaluation_report,
    suspicious_rows,
)


@dataclass
class TwoRounds:
    n_bad: int
    assigned1: DataFrame
    summary1: DataFrame
    suspicious1: DataFrame
    assigned2: DataFrame
    summary2: DataFrame
    suspicious2: DataFrame
    checklist: DataFrame
    report: DataFrame


def two_round_clustering(points: DataFrame, model: str = "bkm", k: int = 6,
                         seed: int = defaults.FINAL_SEED, max_iter: int = defaults.FINAL_MAX_ITER,
                         second_seed: int = defaults.SECOND_ROUND_SEED,
                         second_max_iter: int = defaults.SECOND_ROUND_MAX_ITER,
                         min_divisible: float = defaults.MIN_DIVISIBLE_SIZE) -> TwoRounds:
    """``points``: ``(id, label, features vector)``, ideally checkpointed.

    Each round's assignments and the suspicious points are written once to the shared checkpoint folder: summaries,
    checklist and report read those small tables instead of re-running the
    model over all points for every consumer."""
    n_bad = count_positives(points).first()["n_bad"]
    if not n_bad:
        raise ValueError("no known cases (label 1) among the points: recall is undefined")
    total = F.lit(int(n_bad))
    _, a1 = fit_predict(points, model, k, max_iter=max_iter, seed=seed, min_divisible=min_divisible)
    # one pass of the model over the points; the summary and the chosen rows read its table
    a1 = stage_table(a1, "round1")
    a1_ids = a1.select("id", "label", "prediction")
    s1 = cluster_summary(a1_ids, total)
    sus1 = stage_table(suspicious_rows(a1, best_cluster(s1)), "suspicious1")
    _, a2 = fit_predict(sus1.drop("prediction"), "km", defaults.SECOND_ROUND_K,
                        max_iter=second_max_iter, seed=second_seed)
    a2_ids = stage_table(a2.select("id", "label", "prediction"), "round2")
    s2 = cluster_summary(a2_ids, total)
    sus2 = suspicious_rows(a2_ids, best_cluster(s2))
    return TwoRounds(int(n_bad), a1_ids, s1, sus1, a2_ids, s2, sus2, checklist(a1_ids, sus2),
                     evaluation_report(s1, s2, total))
