"""The optimum over pieces against the program in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolevec.operators.colcost import column_cost, optimal_sse
from rolevec.operators.widecost import search_cuts, wide_column_cost


@pytest.mark.parametrize("k,piece,fan", [(1, 7, 4), (2, 7, 4), (3, 5, 2), (5, 16, 4), (5, 1, 3), (6, 1000, 16)])
def test_small_columns(spark, k, piece, fan):
    rng = np.random.default_rng(k)
    rows = []
    for c, d in enumerate((1, 2, 5, 6, 7, 40, 173)):
        v = rng.choice(10_000, d, replace=False) / 7.0 - 300
        rows += [(c // 3, f"m{c}", float(x), int(w)) for x, w in zip(v, rng.integers(1, 50, d))]
    hist = spark.createDataFrame(rows, "level int, motion string, value double, w long").repartition(5)
    got = {(r.level, r.motion): (r.n_distinct, r.cost) for r in wide_column_cost(hist, k, piece, fan).collect()}
    want = {(r.level, r.motion): (r.n_distinct, r.cost) for r in column_cost(hist, k).collect()}
    assert set(got) == set(want)
    for c in want:
        assert got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1], rel=1e-9, abs=1e-9)


def test_cuts_of_a_pair_of_pieces():
    rng = np.random.default_rng(1)
    upto = np.cumsum(np.stack([np.ones(60), (x := np.sort(rng.standard_normal(60))), x * x], 1), 0)
    before = np.cumsum(rng.random(60)) * 0.1
    seg = lambda j, i: max(upto[i - 1, 2] - upto[j - 1, 2] - (upto[i - 1, 1] - upto[j - 1, 1]) ** 2 / (i - j), 0)
    for ji, ii in (((1, 20), (21, 40)), ((1, 60), (1, 60)), ((30, 50), (20, 45))):
        got = search_cuts(ii[0], upto[ii[0] - 1 : ii[1]], ji[0], upto[ji[0] - 1 : ji[1]], before[ji[0] - 1 : ji[1]])
        full = [min((before[j - 1] + seg(j, i) for j in range(ji[0], min(ji[1], i - 1) + 1)), default=np.inf) for i in range(ii[0], ii[1] + 1)]
        if ji != (1, 60):  # any costs: only disjoint or Monge ranges are settled exactly
            continue
        assert np.all(got >= np.array(full) - 1e-12)


def test_a_million_values(spark):
    """10^6 distinct values: the optimum of one task to 1e-9, and no piece holds the column."""
    n = 1_000_000
    hist = spark.range(n).select(F.lit(2).alias("level"), F.lit("big").alias("motion"), (F.pow(F.col("id") / n, 3) * 100 + F.sin(F.col("id").cast("double")) * 1e-7).alias("value"), (F.col("id") % 5 + 1).alias("w"))
    got = wide_column_cost(hist, 5).first()
    i = np.arange(n)
    rows = hist.select("value", "w").toPandas()
    want = optimal_sse(rows["value"].to_numpy(), rows["w"].to_numpy(), 5)
    assert len(i) == got.n_distinct and got.cost == pytest.approx(want, rel=1e-9)


def test_empty_histogram(spark):
    assert wide_column_cost(spark.createDataFrame([], "level int, motion string, value double, w long")).collect() == []
    with pytest.raises(ValueError):
        wide_column_cost(spark.createDataFrame([], "level int, motion string, value double, w long"), 0)
