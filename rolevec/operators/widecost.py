"""The exact column cost of wide columns, spread over tasks.

``colcost.column_cost`` runs a column's interval program in one task.  Here the sorted
distinct values of a column lie in pieces of at most ``PIECE`` values, and the same program
runs over pieces:

* prefix sums of weights, values and squares: within the pieces by tasks, across them from
  one header row a piece;
* a layer of the program needs, for every position i, the best cut j < i.  Best cuts never
  move back as i grows, so the cuts of the pieces' ends are searched first, ``FAN`` at a time
  between known ones, by a pass in which each piece looks at its own positions j only;
* then every piece of positions i meets the pieces between its two ends' cuts, about two
  each, and a divide-and-conquer search settles the pair.

The driver holds a header and a cut per piece (one row per ``PIECE`` distinct values); no task
holds more than two pieces of a column.  Values are centred at the column's mean first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.session import stage_table

# The functions below run in Python workers: their code ships with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 4096
FAN = 16
GROUP = 64  # pieces of cuts whose results a task combines before the exchange


@dataclass
class Column:
    """What the driver knows of a column: per piece, its first position and the sums before it."""

    name: tuple
    start: np.ndarray
    size: np.ndarray
    sums: np.ndarray  # [pieces + 1, 3]: weight, value, square before each piece, and in all
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def total(self) -> int:
        return int(self.start[-1] + self.size[-1])


def _cut_pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        names = ["col", "part", "seq", "n", "w", "s1", "s2", "values", "weights"]
        for b in batches:
            col, v, w = (b.column(j).to_numpy() for j in range(3))
            if not len(col):
                continue
            cuts = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
            cuts = np.unique(np.concatenate([np.arange(a, z, size) for a, z in zip(cuts, np.append(cuts[1:], len(col)))]))
            rows = []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(col)]):
                x, y = v[a:z].astype(float), w[a:z].astype(float)
                rows.append((int(col[a]), part, seq, z - a, float(y.sum()), float((y * x).sum()), float((y * x * x).sum()), x.tobytes(), y.tobytes()))
                seq += 1
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _prefix(values: bytes, weights: bytes, base: np.ndarray) -> np.ndarray:
    """[n, 3]: weight, value and square up to and including each value."""
    x, w = np.frombuffer(values), np.frombuffer(weights)
    return np.stack([base[0] + np.cumsum(w), base[1] + np.cumsum(w * x), base[2] + np.cumsum(w * x * x)], axis=1)


def _segment(upto_j: np.ndarray, upto_i: np.ndarray) -> np.ndarray:
    """SSE of the values after position j up to position i, from their prefix sums."""
    d = upto_i - upto_j
    return np.maximum(d[..., 2] - d[..., 1] ** 2 / d[..., 0], 0.0)


def search_cuts(first_i: int, upto_i: np.ndarray, first_j: int, upto_j: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Least ``before[j] + segment(j, i)`` for every i, over the given positions j < i (inf if none).

    Positions are consecutive from ``first_i`` and ``first_j``.  Divide and conquer over i, all
    subproblems of a depth at once."""
    n, m = len(upto_i), len(upto_j)
    out = np.full(n, np.inf)
    ilo, ihi = np.array([0]), np.array([n - 1])
    jlo, jhi = np.array([0]), np.array([m - 1])
    while ilo.size:
        mid = (ilo + ihi) // 2
        top = np.minimum(jhi, first_i + mid - 1 - first_j)  # j < i
        lens = np.maximum(top - jlo + 1, 0)
        some = lens > 0
        best_j = jlo.copy()
        if some.any():
            at, count = np.flatnonzero(some), lens[some]
            starts = np.cumsum(count) - count
            owner = np.repeat(at, count)
            j = jlo[owner] + np.arange(count.sum()) - np.repeat(starts, count)
            value = before[j] + _segment(upto_j[j], upto_i[mid[owner]])
            least = np.minimum.reduceat(value, starts)
            out[mid[at]] = least
            hit = np.flatnonzero(value <= np.repeat(least, count))
            who, first = np.unique(owner[hit], return_index=True)
            best_j[who] = j[hit[first]]
        left, right = ilo <= mid - 1, mid + 1 <= ihi
        ilo, ihi, jlo, jhi = (np.concatenate((ilo[left], (mid + 1)[right])), np.concatenate(((mid - 1)[left], ihi[right])),
                              np.concatenate((jlo[left], best_j[right])), np.concatenate((np.maximum(best_j, jlo)[left], jhi[right])))
    return out


def _scan(pieces: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], bases: dict[int, np.ndarray], starts: dict[int, np.ndarray]) -> dict:
    """Best cut of single positions: (column, position) -> (cost, cut).

    ``asked[col]``: positions, least and largest cut, prefix sums.  Each piece looks at its own
    values as cuts; the partial minima are combined before and after the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["col"] not in asked:
                    continue
                position, lo, hi, upto = asked[r["col"]]
                first = int(starts[r["col"]][r["piece"]]) + 1  # the cut after the piece's first value
                mine = _prefix(r["values"], r["weights"], bases[r["col"]][r["piece"]])
                before = np.frombuffer(r["before"])
                for k in np.flatnonzero((lo < first + len(mine)) & (hi >= first)):
                    a, z = max(0, int(lo[k]) - first), min(len(mine), int(hi[k]) - first + 1)
                    value = before[a:z] + _segment(mine[a:z], upto[k])
                    at = int(value.argmin())
                    out.append((r["col"], int(position[k]), float(value[at]), first + a + at))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))], names=["col", "position", "cost", "cut"])

    found = pieces.mapInArrow(run, "col int, position long, cost double, cut long")
    best = found.groupBy("col", "position").agg(F.min(F.struct("cost", "cut")).alias("b"))
    return {(r["col"], r["position"]): (r["b"]["cost"], r["b"]["cut"]) for r in best.collect()}  # one row per position asked


def _end_cuts(columns: list[Column], pieces: DataFrame, layer: int, fan: int) -> None:
    """The best cut of every piece's end, ``fan`` at a time between known ones."""
    known = [{-1: layer - 1, len(c.start): c.total - 1} for c in columns]  # piece -> cut of its end; bounds outside
    step = 1
    while step * fan < max(len(c.start) for c in columns):
        step *= fan
    bases, starts = {k: c.sums for k, c in enumerate(columns)}, {k: c.start for k, c in enumerate(columns)}
    while step:
        asked = {}
        for k, c in enumerate(columns):
            new = [p for p in range(step - 1, len(c.start), step) if p not in known[k] and c.start[p] + c.size[p] >= layer]
            if not new:
                continue
            marks = np.array(sorted(known[k]))
            ends = np.array([c.start[p] + c.size[p] for p in new])
            below = np.searchsorted(marks, new) - 1
            lo = np.array([known[k][marks[b]] for b in below])
            hi = np.minimum([known[k][marks[b + 1]] for b in below], ends - 1)
            asked[k] = (ends, np.minimum(lo, hi), hi, c.sums[np.array(new) + 1])
        if asked:
            got = _scan(pieces, asked, bases, starts)
            for k, (ends, _, _, _) in asked.items():
                at = {int(e): int(p) for e, p in zip(columns[k].start + columns[k].size, range(len(columns[k].start)))}
                for e in ends.tolist():
                    known[k][at[e]] = got[(k, e)][1]
        step //= fan
    for k, c in enumerate(columns):
        # pieces too early to have a cut take the first one possible
        c.cut = np.maximum.accumulate(np.array([known[k].get(p, layer - 1) for p in range(len(c.start))]))


def _layer(spark, columns: list[Column], pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``before`` replaced by the next layer's costs."""
    pairs = []
    for k, c in enumerate(columns):
        low = np.append(0, c.cut[:-1])
        # a cut j lies in the piece that ends with the j-th value or after it
        a, z = (np.minimum(np.searchsorted(c.start + c.size, x), len(c.start) - 1) for x in (low, c.cut))
        pairs += [(k, p, q) for p in range(len(c.start)) for q in range(int(a[p]), int(z[p]) + 1)]
    listed = spark.createDataFrame(pairs, "col int, piece int, q int")
    bases, starts = {k: c.sums for k, c in enumerate(columns)}, {k: c.start for k, c in enumerate(columns)}
    mine = pieces.select("col", "piece", "values", "weights")
    theirs = pieces.select("col", F.col("piece").alias("q"), F.col("values").alias("qv"), F.col("weights").alias("qw"), "before")
    met = listed.join(mine, ["col", "piece"]).join(theirs, ["col", "q"]).withColumn("grp", F.floor(F.col("q") / GROUP))
    met = met.repartition("col", "piece", "grp").sortWithinPartitions("col", "piece", "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least = None, None
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                col, p, q = r["col"], r["piece"], r["q"]
                upto_i = _prefix(r["values"], r["weights"], bases[col][p])
                upto_j = _prefix(r["qv"], r["qw"], bases[col][q])
                cost = search_cuts(int(starts[col][p]) + 1, upto_i, int(starts[col][q]) + 1, upto_j, np.frombuffer(r["before"]))
                if at == (col, p, r["grp"]):
                    least = np.minimum(least, cost)
                    continue
                if at is not None:
                    out.append((at[0], at[1], least.tobytes()))
                at, least = (col, p, r["grp"]), cost
            yield _rows(out)
        if at is not None:
            yield _rows([(at[0], at[1], least.tobytes())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], names=["col", "piece", "before"])

    def fold(t: pa.Table) -> pa.Table:
        least = np.minimum.reduce([np.frombuffer(x) for x in t.column("before").to_pylist()])
        return pa.table({"col": t.column("col").slice(0, 1), "piece": t.column("piece").slice(0, 1), "before": pa.array([least.tobytes()], pa.binary())})

    parts = met.select("col", "piece", "q", "grp", "values", "weights", "qv", "qw", "before").mapInArrow(run, "col int, piece int, before binary")
    cost = parts.groupBy("col", "piece").applyInArrow(fold, "col int, piece int, before binary")
    return stage_table(mine.join(cost, ["col", "piece"]), "cost-layer")


def wide_column_cost(histogram: DataFrame, k: int = defaults.COLUMN_K, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """``(level, motion, n_distinct, cost)`` of every column: the optimum, as by ``column_cost``."""
    if k <= 0:
        raise ValueError(f"number of clusters must be positive, got {k}")
    spark = histogram.sparkSession
    hist = stage_table(histogram.select(F.col("level").cast("int").alias("level"), "motion", F.col("value").cast("double").alias("value"), F.col("w").cast("double").alias("w"))
                       .groupBy("level", "motion", "value").agg(F.sum("w").alias("w")).where("w > 0"), "wide-histogram")
    means = hist.groupBy("level", "motion").agg(F.count(F.lit(1)).alias("n_distinct"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))
    sized = stage_table(means, "wide-columns")
    wide = sized.where(F.col("n_distinct") > k).orderBy("level", "motion").collect()  # one row per column
    names = spark.createDataFrame([(c, r["level"], r["motion"], r["mean"]) for c, r in enumerate(wide)], "col int, level int, motion string, mean double")
    found = [] if not wide else _costs(spark, hist.join(names, ["level", "motion"]).select("col", (F.col("value") - F.col("mean")).alias("value"), "w"), len(wide), k, piece, fan)
    costs = names.join(spark.createDataFrame(found, "col int, cost double"), "col").select("level", "motion", "cost")
    return sized.join(costs, ["level", "motion"], "left").select("level", "motion", "n_distinct", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _costs(spark, values: DataFrame, n_columns: int, k: int, piece: int, fan: int) -> list[tuple[int, float]]:
    dealt = values.repartitionByRange("col", "value").sortWithinPartitions("col", "value")
    cut = dealt.mapInArrow(_cut_pieces(piece), "col int, part int, seq long, n long, w double, s1 double, s2 double, values binary, weights binary")
    raw = stage_table(cut, "wide-pieces")
    heads: list[list] = [[] for _ in range(n_columns)]
    for r in raw.select("col", "part", "seq", "n", "w", "s1", "s2").orderBy("col", "part", "seq").collect():  # a row per piece
        heads[r["col"]].append(r)
    columns, numbers = [], []
    for c, of in enumerate(heads):
        size = np.array([r["n"] for r in of], np.int64)
        sums = np.concatenate([np.zeros((1, 3)), np.cumsum([[r["w"], r["s1"], r["s2"]] for r in of], axis=0)])
        columns.append(Column((c,), np.cumsum(size) - size, size, sums))
        numbers += [(c, r["part"], r["seq"], p) for p, r in enumerate(of)]
    numbered = raw.join(spark.createDataFrame(numbers, "col int, part int, seq long, piece int"), ["col", "part", "seq"])
    bases = {c: x.sums for c, x in enumerate(columns)}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One interval from the first value: the first layer."""
        for b in batches:
            rows = b.to_pylist()
            cost = [_segment(np.zeros(3), _prefix(r["values"], r["weights"], bases[r["col"]][r["piece"]])).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("col", "piece", "values", "weights")), pa.array(cost, pa.binary())], names=["col", "piece", "values", "weights", "before"])

    pieces = stage_table(numbered.select("col", "piece", "values", "weights").mapInArrow(first, "col int, piece int, values binary, weights binary, before binary"), "cost-layer")
    for layer in range(2, k):
        _end_cuts(columns, pieces, layer, fan)
        pieces = _layer(spark, columns, pieces)
    if k == 1:
        return [(c, float(_segment(np.zeros(3), x.sums[-1]))) for c, x in enumerate(columns)]
    asked = {c: (np.array([x.total]), np.array([k - 1]), np.array([x.total - 1]), x.sums[-1:]) for c, x in enumerate(columns)}
    last = _scan(pieces, asked, bases, {c: x.start for c, x in enumerate(columns)})
    return [(c, last[(c, x.total)][0]) for c, x in enumerate(columns)]
