"""Merkle manifest, conversation trie and nearest neighbours against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import DOCS
from pyspark.sql import functions as F

from rolevec.llm import convtrie, merkle, multiindex
from rolevec.llm.order import in_order


def awkward(df):
    for name in ("n", "a", "b", "bad", "pos", "total", "tree", "block", "depth", "words", "entry", "cell", "k", "kind", "digest", "path"):
        df = df.withColumn(name, F.lit("x"))
    return df


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- places within groups --------------------------------------------------------------------


def test_positions_and_running_values(spark, small_batches):
    rng = random.Random(3)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"g{k % 5}", rng.randrange(500), rng.randrange(1 << 62), rng.randrange(100)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, x long, s long").withColumn("row", F.monotonically_increasing_id()).cache()
    got = in_order(df.repartition(13), ["g"], ["o", "row"], xors=["x"], sums=["s"], groups=True).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, g or ""))
    want = {}
    for g, of in groups.items():
        x = s = 0
        for k, r in enumerate(sorted(of, key=lambda r: (r.o, r.row))):
            want[r.row] = (k, x, s, len(of), names.index(g))
            x, s = x ^ r.x, s + r.s
    assert {r.row: (r.pos, r.before_x, r.before_s, r.total, r.number) for r in got} == want
    plain = in_order(df, ["g"], ["o", "row"])
    assert plain.columns == [*df.columns, "pos"] and {r.row: r.pos for r in plain.collect()} == {k: v[0] for k, v in want.items()}


# --- Merkle manifest -------------------------------------------------------------------------


@pytest.mark.parametrize("levels", range(1, 9))
def test_places_of_a_complete_tree(levels):
    """Every place once; a subtree of the recursion is contiguous; children before parents."""
    places = [merkle.node_place(d, np.arange(1 << d), levels).tolist() for d in range(levels)]
    assert sorted(p for of in places for p in of) == list(range((1 << levels) - 1))
    assert places[0] == [0]
    top = levels // 2
    for t in range(1 << top if levels > 1 else 0):
        bottom = [places[d][i] for d in range(top, levels) for i in range(t << (d - top), (t + 1) << (d - top))]
        assert max(bottom) - min(bottom) + 1 == len(bottom)
    done = set(places[levels - 1])
    for _, _, p, left, right in merkle.building_order(levels):
        assert left in done and right in done
        done.add(p)


def merkle_brute(rows, changed):
    """{row number: (leaf, subroot, root, proof, folded)} by plain lists."""

    def digest(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def up(level):
        return [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out

    trees = {}
    for k, r in enumerate(rows):
        trees.setdefault(r[2], []).append(k)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = lambda k: (rows[k][0] is not None, rows[k][0] or 0, digest(rows[k]))
    built = {x: levels([digest(rows[k]) for k in sorted(trees[x], key=low)]) for x in order}
    top = levels([built[x][-1][0] for x in order])
    out = {}
    for t, x in enumerate(order):
        for p, k in enumerate(sorted(trees[x], key=low)):
            path, node = [], digest(changed(rows[k]))
            for tree, at in ((built[x], p), (top, t)):
                for level in tree[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    path += [s for j, s in enumerate(pair) if j != at % 2]
                    pair[at % 2] = node
                    node, at = sha("".join(pair)), at // 2
            out[k] = (digest(rows[k]), built[x][-1][0], top[-1][0], sha("".join(path)), node)
    return out


def one_more(r):
    i, source, lang, n, text = r
    return (i, source, lang, n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n, text)


@pytest.mark.parametrize("height,count", [(10, 90), (2, 90), (3, 9), (3, 8), (1, 1)])
def test_manifest_by_brute_force(spark, monkeypatch, height, count):
    rng = random.Random(count)
    rows = []
    for k in range(count):
        lang = rng.choice(["en", "en", "en", "de", None, "É", "e", ""])
        text = rng.choice([None, "", "ä" * rng.randrange(40), "x" * rng.randrange(3000)])
        rows.append((rng.choice([None, k, 5, -k, (1 << 60) + 2 * k + 1]), rng.choice([None, "s", "t"]), lang, rng.choice([None, len(text or "")]), text))
    rows += rows[:3]  # repeated rows are leaves of their own
    docs = awkward(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4))
    found, root = merkle.proofs(docs, merkle.tampered(), height)
    got = sorted((r.doc_id is not None, r.doc_id, r.leaf, r.subroot, root.hex(), r.proof_sha256, r.folded_root) for r in merkle.folded(found).collect())
    want = merkle_brute(rows, one_more)
    assert got == sorted((rows[k][0] is not None, rows[k][0], *v) for k, v in want.items())


def test_manifest_query_flags_tampering(spark):
    rows = [(k, "s", "en", k, "t" * k) for k in range(60)]
    out = {r.doc_id: r for r in merkle.manifest_digest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()}
    assert {k for k, r in out.items() if not r.verified} == {k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 0}
    assert all(r.verified == (r.folded_root == r.root) for r in out.values())


def test_manifest_of_nothing(spark):
    assert merkle.manifest_digest(spark.createDataFrame([], DOCS)).collect() == []


# --- conversation trie -----------------------------------------------------------------------


def trie_brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    turns = {c: [(t[2], t[4]) for t in sorted(of)] for c, of in convs.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    nodes = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, members in nodes.items():
        below, todo = [], [k]
        while todo:
            x = todo.pop()
            below.append(x)
            todo += kids.get(x, [])
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), sum(x not in kids for x in below), saved, sha(ends)))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed: int):
    rng = random.Random(seed)
    rows = []
    for c in range(200):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # the conversation that others begin with is absent
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice(["hi", "hi", "a b", "a  b c", None, "", "é x"])))
    for c in range(1000, 1040):  # copies, some with another end
        rows += [(c, t, "user", f"same {t}") for t in range(12)] + ([(c, 12, "x", str(c % 3))] if c % 2 else [])
    rows += [(5000, t, "user", "w " * (t % 4)) for t in range(300)] + [(5020, t, "user", "w " * (t % 4)) for t in range(280)]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "hi"), (-20, 0, "a", "b"), (7001, 3, "user", "hi"), (7001, 3, "user", "hi")]
    return rows


@pytest.mark.parametrize("chunk,piece", [(32, 1000), (2, 3)])
def test_trie_by_brute_force(spark, small_batches, chunk, piece):
    rows = conversations(chunk)
    df = awkward(spark.createDataFrame(rows, CONVERSATIONS)).drop("turn_x").repartition(5)
    got = sorted(tuple(r[c] if r[c] is not None else -(10**9) for c in TRIE) for r in convtrie.prefix_trie(df, chunk, piece).collect())
    assert got == sorted(tuple(v if v is not None else -(10**9) for v in r) for r in trie_brute(rows))


def test_trie_of_nothing_and_of_one(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    one = [(3, None, None, None)]  # borrows from a conversation that isn't there
    assert sorted(tuple(r[c] for c in TRIE) for r in convtrie.prefix_trie(spark.createDataFrame(one, CONVERSATIONS)).collect()) == sorted(trie_brute(one))


def test_forest_merges_in_descending_depth():
    #        0  1  2  3: rows 0, 1 share two, 2 ends inside them, 3 shares nothing
    parts = convtrie.forest([2, 1, 0], [3, 2, 1, 2], [9, 4, 7, 5], [0, 0, 0, 0])
    assert sorted(p[1:5] for p in parts) == sorted([(3, 3, 1, 9), (2, 2, 2, 4), (1, 1, 3, 4), (1, 2, 1, 5), (0, 0, 4, 4)])


# --- nearest neighbours ----------------------------------------------------------------------


def search_brute(rows, every=20, top=20):
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)})
    out = []
    for q, v in seen:
        if q % every:
            continue
        score = []
        for i, w in seen:
            if i != q and len(w) == len(v):
                s = 0.0
                for x, y in zip(v, w):
                    s += float(x) * float(y)
                score.append((-s, i))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(score)[:top])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    return centre[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, dim))


def test_search_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors(400, 6))]
    rows += [(1000 + k, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0]) for k in range(150)]  # copies: ties to the smaller id
    rows += [(2000 + k, [float(rng.randrange(2)) for _ in range(6)]) for k in range(200)]  # many equal products
    rows += [(3000 + k, [float(k)] * 3) for k in range(1, 30)] + [(3100, [2.0]), (3101, [3.0]), (3120, [1.0, 2.0]), (3140, [])]
    rows += [(4000, None), (4020, [0.0] * 6), (4040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4060, [float("nan")] * 6), (4080, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += rows[:5]
    df = awkward(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5))
    want = search_brute(rows)
    for more in ({}, {"block": 64, "per_slice": 16}):  # whole index seen: exact
        got = sorted(tuple(r) for r in multiindex.search(df, **more).select("query_id", "rank", "vec_id", "score").collect())
        assert got == want


def test_search_recall_and_calibration(spark):
    """An index that is seen in part finds at least nine of ten true neighbours."""
    x = vectors(6000, 16).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {}
    for r in multiindex.search(df, centroids=16, least=50, block=700, per_slice=128).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::20].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(len(s)), np.arange(0, 6000, 20)] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    assert sorted(got) == list(range(0, 6000, 20)) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[20 * k] & set(t.tolist())) for k, t in enumerate(true)) / true.size >= 0.9


def test_cells_come_in_ascending_distance():
    rng = np.random.default_rng(2)
    first, second = rng.standard_normal(9), rng.standard_normal(7)
    counts = rng.integers(0, 4, (9, 7))
    seen = list(multiindex.visited(first, second, counts, 10**9))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(9) for j in range(7)]
    assert [f for f, _, _ in seen] == sorted(f for f, _, _ in seen)
    part = list(multiindex.visited(first, second, counts, 20))
    assert part == seen[: len(part)] and sum(counts[i, j] for _, i, j in part) >= 20 > sum(counts[i, j] for _, i, j in part[:-1])


def test_search_of_nothing_and_of_one(spark):
    assert multiindex.search(spark.createDataFrame([], VECTORS)).collect() == []
    assert multiindex.search(spark.createDataFrame([(20, [1.0, 2.0], 0)], VECTORS)).collect() == []
