"""Nearest neighbours by an inverted multi-index.

1.  Vectors are cut into two halves, each with a codebook of ``CENTROIDS`` centroids (Spark ML
    k-means on ``SAMPLE`` distinct vectors, drawn by a hash over all rows).  A vector's cell is
    the pair of its halves' nearest centroids.  Every distinct vector is indexed.
2.  A query visits the cells in ascending summed distance of its halves to the centroids (the
    negative inner product, as nearness is the inner product): a heap holds the frontier of
    the sorted table of pairs, as many cells as it takes to see ``wanted`` entries.
3.  ``wanted`` is calibrated: the exact neighbours of ``PROBES`` queries, found by one pass over
    all entries, show how many entries a query must see for the recall ``RECALL``.
4.  Cells lie in blocks of at most ``BLOCK`` entries; a larger cell is split over several.  A
    query goes once to each block that holds a cell it visits, in slices of at most ``SLICE``
    queries.  Entries of visited cells are reranked by the exact inner product, and a block
    returns each query's best, which are merged by query.

Equal vectors are one entry with their smallest ``TOP`` + 1 ids, enough for any result with its
ties; equal queries search once.  Nothing is capped otherwise.

Defined results: a null or zero vector, or one with a null or non-finite component, takes no
part, nor do rows without an id; vectors meet only those of their length; rows with a query's id
are its own; equal pairs of id and vector count once; with few candidates all are returned; an
empty table gives no rows; extra columns are ignored.  Products are added up from the first
component to the last, in doubles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolevec.llm.ship import map_batches, ship
from rolevec.session import stage_table

TOP = 20
EVERY = 20
CENTROIDS = 64
SAMPLE = 20_000
PROBES = 128
RECALL = 0.95
LEAST = 4096  # entries that a query sees at least
BLOCK = 8192
SLICE = 8192
SEED = 20240517


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the distinct rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda v: v != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def entry_table(usable: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """entry, dim, embedding, ids (the smallest), asks (a query has this vector)."""
    asks = F.col("vec_id") % every == 0
    per = Window.partitionBy("embedding", "asks").orderBy("vec_id")
    few = usable.distinct().withColumn("asks", asks).withColumn("k", F.row_number().over(per)).where(F.col("k") <= top + 1)  # limited before the shuffle, too
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1)
    one = few.groupBy("embedding").agg(ids.alias("ids"), F.max("asks").alias("asks"))
    return one.select(F.monotonically_increasing_id().alias("entry"), F.size("embedding").alias("dim"), "embedding", "ids", "asks")


def codebooks(entries: DataFrame, dim: int, centroids: int = CENTROIDS, sample: int = SAMPLE) -> list[np.ndarray]:
    """Centroids of both halves, fitted on a bounded sample."""
    drawn = stage_table(entries.orderBy(F.xxhash64("embedding", F.lit(SEED)), "entry").limit(sample).select("embedding"), "codebook-sample")
    out = []
    for start, size in ((1, dim // 2), (dim // 2 + 1, dim - dim // 2)):
        if size == 0:
            out.append(np.zeros((1, 0)))
            continue
        half = drawn.select(array_to_vector(F.slice("embedding", start, size)).alias("half"))
        model = KMeans(k=centroids, initMode="random", maxIter=10, seed=SEED, featuresCol="half").fit(half) if centroids > 1 and half.count() > 1 else None
        out.append(np.array([c for c in model.clusterCenters()]) if model else np.array([half.first()[0].toArray()]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    if centroids.shape[1] == 0:
        return np.zeros(len(points), np.int64)
    return ((centroids * centroids).sum(1) - 2 * (points @ centroids.T)).argmin(1)


def halves_distance(queries: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """Distance of each query's halves to the centroids: [queries, centroids] per half."""
    cut = books[0].shape[1]
    return [-(queries[:, :cut] @ books[0].T), -(queries[:, cut:] @ books[1].T)]


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> Iterator[tuple[float, int, int]]:
    """(summed distance, i, j) of the cells in ascending order until ``wanted`` entries are seen.

    The heap holds the frontier: a pair of ranks is entered once both pairs before it are out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    rows, cols = a.tolist(), b.tolist()
    done = [0] * (len(x) + 1)  # how far each row of ranks has come
    heap = [(x[0] + y[0], 0, 0)]
    seen = 0
    table = counts.tolist()
    while heap:
        far, i, j = heapq.heappop(heap)
        done[i] = j + 1
        yield far, rows[i], cols[j]
        seen += table[rows[i]][cols[j]]
        if seen >= wanted:
            return
        if i + 1 < len(x) and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def assigned(entries: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """entries plus their cell (i * second codebook's size + j)."""
    cut, wide = books[0].shape[1], len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("embedding"))
            cell = nearest(m[:, :cut], books[0]) * wide + nearest(m[:, cut:], books[1]) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("embedding"), b.column("ids"), b.column("asks"), pa.array(cell, pa.int32())], names=["entry", "embedding", "ids", "asks", "cell"])

    kind = entries.schema["embedding"].dataType.simpleString()
    return map_batches(entries.select("entry", "embedding", "ids", "asks"), run, f"entry long, embedding {kind}, ids array<long>, asks boolean, cell int")


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component to the last."""
    out = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        out += queries[:, k] * points[:, k]
    return out


def best_of_block(queries: np.ndarray, points: np.ndarray, seen: np.ndarray | None, ids: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the ``top`` best ids among the points each query sees."""
    rows, found, scores = [], [], []
    length = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    start = np.cumsum(length) - length
    scale = np.abs(points).max(initial=0.0) * points.shape[1] if points.size else 0.0
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        use = np.arange(len(points)) if seen is None else np.flatnonzero(seen[lo : lo + 256].any(0))
        s = q @ points[use].T
        if seen is not None:
            s[~seen[lo : lo + 256][:, use]] = -np.inf
        if s.shape[1] == 0:
            continue
        k = min(top, s.shape[1])
        bound = np.partition(s, -k, axis=1)[:, -k]
        slack = 1e-13 * scale * np.abs(q).max(1)  # what the order of the sum can change
        r, c = np.nonzero((s >= (bound - slack)[:, None]) & (s > -np.inf))
        exact = products(q[r], points[use[c]])
        # ids of the points, best first, ties to the smaller id
        n = length[use[c]]
        at = np.repeat(start[use[c]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, exact, one = np.repeat(r, n), np.repeat(exact, n), flat[at]
        order = np.lexsort((one, -exact, r))
        r, exact, one = r[order], exact[order], one[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < top
        rows.append(r[keep] + lo)
        found.append(one[keep])
        scores.append(exact[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _best(rows: DataFrame, key: str, top: int, *more: str) -> DataFrame:
    """The ``top`` best rows of every query; the limit is applied before the shuffle, too."""
    per = Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id", *more)
    return rows.withColumn("__k", F.row_number().over(per)).where(F.col("__k") <= top).drop("__k")


def calibrate(entries: DataFrame, books: list[np.ndarray], counts: np.ndarray, recall: float = RECALL, probes: int = PROBES, top: int = TOP, least: int = LEAST) -> int:
    """How many entries queries must see, so that the probes find this share of their true neighbours."""
    asked = entries.where("asks").orderBy(F.xxhash64("embedding", F.lit(SEED + 1)), "entry").limit(probes).select("entry", "embedding").collect()
    if not asked:
        return least
    own = np.array([r["entry"] for r in asked])
    q = np.array([r["embedding"] for r in asked], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            entry, cell = b.column("entry").to_numpy(), b.column("cell").to_numpy()
            r, at, score = best_of_block(q, _matrix(b.column("embedding")), None, [[k] for k in range(b.num_rows)], top + 1)
            r, at, score = (v[entry[at] != own[r]] for v in (r, at, score))
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(entry[at]), pa.array(score), pa.array(cell[at].astype(np.int32))], names=["probe", "vec_id", "score", "cell"])

    true = _best(map_batches(entries.select("entry", "embedding", "cell"), run, "probe long, vec_id long, score double, cell int"), "probe", top).select("probe", "cell").collect()  # probes x top rows
    if not true:
        return least
    cells: dict[int, list[int]] = {}
    for r in true:
        cells.setdefault(r["probe"], []).append(r["cell"])
    need = []
    dist = halves_distance(q, books)
    for p, of in cells.items():
        table = dist[0][p][:, None] + dist[1][p][None, :]
        order = np.argsort(table, axis=None, kind="stable")
        upto = np.empty(table.size, np.int64)
        upto[order] = np.cumsum(counts.ravel()[order])
        need += upto[of].tolist()
    return max(least, int(np.quantile(np.array(need), recall, method="higher")))


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, recall: float = RECALL, centroids: int = CENTROIDS, sample: int = SAMPLE, least: int = LEAST, block: int = BLOCK, per_slice: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of every row whose id ``every`` divides."""
    usable = usable_vectors(vectors)
    entries = stage_table(entry_table(usable, every, top), "vectors")
    lengths = [r[0] for r in entries.where("asks").select("dim").distinct().collect()]  # one row per length of a query
    found = None
    for dim in lengths:
        part = _search(entries.where(F.col("dim") == dim), dim, top, recall, centroids, sample, least, block, per_slice)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "entry long, found array<struct<score: double, vec_id: long>>")
    known = stage_table(entries.join(found, "entry").select(F.col("embedding").alias("__embedding"), "found"), "found")
    asked = usable.where(F.col("vec_id") % every == 0).distinct()
    mine = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, top)
    told = asked.join(known, F.col("embedding") == F.col("__embedding")).select(F.col("vec_id").alias("query_id"), F.posexplode(mine).alias("k", "f"))
    return told.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _search(entries: DataFrame, dim: int, top: int, recall: float, centroids: int, sample: int, least: int, block: int, per_slice: int) -> DataFrame:
    """entry, found (the best ids, best first) of the entries that ask."""
    spark = entries.sparkSession
    books = codebooks(entries, dim, centroids, sample)
    wide = len(books[1])
    indexed = stage_table(assigned(entries, books), "indexed")
    counts = np.zeros(len(books[0]) * wide, np.int64)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CENTROIDS squared
        counts[r["cell"]] = r["n"]
    wanted = calibrate(indexed, books, counts.reshape(-1, wide), recall, top=top, least=least)
    # cells one after another in blocks of so many entries: a cell's first block and how many it spans
    ends = np.cumsum(counts)
    first = (ends - counts) // block
    spans = np.maximum(1, -(-ends // block) - first)
    queries = indexed.where("asks")
    slices = max(1, -(-queries.count() // per_slice))
    places = spark.createDataFrame([(int(c), int(first[c]), int(spans[c])) for c in np.flatnonzero(counts)], "cell int, first long, spans long")
    own_block = F.col("first") + F.pmod(F.xxhash64("entry"), F.col("spans"))
    left = indexed.join(F.broadcast(places), "cell").withColumn("block", own_block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))  # a row per cell: at most CENTROIDS squared

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            m = _matrix(b.column("embedding"))
            dist = halves_distance(m, books)
            rows, blocks, bounds = [], [], []
            for r in range(len(m)):
                hit, bound = set(), -np.inf
                for far, i, j in visited(dist[0][r], dist[1][r], counts.reshape(-1, wide), wanted):
                    bound = far
                    c = i * wide + j
                    if counts[c]:
                        hit.update(range(int(first[c]), int(first[c] + spans[c])))
                rows += [r] * len(hit)
                blocks += sorted(hit)
                bounds += [bound] * len(hit)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("entry").take(at), b.column("embedding").take(at), pa.array(blocks, pa.int64()), pa.array(bounds, pa.float64())], names=["query", "embedding", "block", "bound"])

    kind = indexed.schema["embedding"].dataType.simpleString()
    right = map_batches(queries.select("entry", "embedding"), route, f"query long, embedding {kind}, block long, bound double").withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
    ship(spark)

    def rerank(points: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if points.num_rows == 0 or asked.num_rows == 0:
            return empty
        q = _matrix(asked.column("embedding").combine_chunks())
        cell = points.column("cell").to_numpy()
        dist = halves_distance(q, books)
        bound = asked.column("bound").to_numpy()
        of, inverse = np.unique(cell, return_inverse=True)
        # a query sees the cells up to its last one's distance (recomputed here: the last bits may differ)
        near = dist[0][:, of // wide] + dist[1][:, of % wide] <= (bound + 1e-12 * (1 + np.abs(bound)))[:, None]
        out = []
        m, ids = _matrix(points.column("embedding").combine_chunks()), points.column("ids").to_pylist()
        for lo in range(0, len(q), 1024):
            r, one, score = best_of_block(q[lo : lo + 1024], m, near[lo : lo + 1024][:, inverse], ids, top + 1)
            out.append((r + lo, one, score))
        r, one, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query": asked.column("query").combine_chunks().take(pa.array(r)), "vec_id": pa.array(one), "score": pa.array(score)})

    key = ["block", "slice"]
    hits = left.select(*key, "cell", "embedding", "ids").groupBy(*key).cogroup(right.select(*key, "query", "embedding", "bound").groupBy(*key)).applyInArrow(rerank, "query long, vec_id long, score double")
    best = _best(hits, "query", top + 1)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), lambda x: F.struct((-x["s"]).alias("score"), x["vec_id"].alias("vec_id")))
    return best.groupBy(F.col("query").alias("entry")).agg(ranked.alias("found"))  # top + 1 rows a query
