"""Numpy kernels against plain Python."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, SPACE, components, edit_distance, words
from hypothesis import given, settings
from hypothesis import strategies as st

from rolevec.llm.editdist import within
from rolevec.llm.fmindex import FMIndex
from rolevec.llm.graph import local_roots
from rolevec.llm.license_rules import load_rules
from rolevec.llm.licenses import suppress
from rolevec.llm.linededup import probe_shifts
from rolevec.llm.ngram_join import intersections, most_apart, overlap, prefix_size
from rolevec.llm.packing import default_vocabulary, encoder, sum_of_squares
from rolevec.llm.textkit import Lines, Words, slices
from rolevec.llm.vecdedup import frequent_pairs, needed_collisions

TEXT = st.text(alphabet="aAzZ09 é\n\t.-{ÿ漢 _", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.sampled_from([("alnum", ALNUM), ("space", SPACE)]))
def test_words_of_rows(texts, kind):
    name, rule = kind
    for lo, hi, data, off in slices(pa.array(texts, pa.string()), 40):
        w = Words(data, off, name)
        for r in range(hi - lo):
            want = words(texts[lo + r], rule)
            spans = list(zip(w.start, w.end, w.hash))[w.first[r] : w.first[r + 1]]
            assert [bytes(data[s:e]).decode().translate(str.maketrans("AZ", "az")) for s, e, _ in spans] == want
            alone = Words(np.frombuffer(" ".join(want).encode(), np.uint8), np.array([0, len(" ".join(want).encode())]), name)
            assert alone.hash.tolist() == [h for _, _, h in spans]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\né", max_size=12)), min_size=1, max_size=6))
def test_lines_of_rows(texts):
    for lo, hi, data, off in slices(pa.array(texts, pa.string()), 20):
        lines = Lines(data, off)
        got = [[] for _ in range(hi - lo)]
        for s, e, r, k in zip(lines.start, lines.end, lines.row, lines.number):
            assert len(got[r]) == k
            got[r].append(bytes(data[s:e]).decode())
        assert got == [(t or "").split("\n") for t in texts[lo:hi]]
        by = {}
        for s, e, h in zip(lines.start, lines.end, lines.hash(lines.start, lines.end)):
            assert by.setdefault(bytes(data[s:e]), h) == h


def test_slices_keep_a_long_row_whole():
    got = [(a, z, bytes(d)) for a, z, d, _ in slices(pa.array(["x" * 50, "ab", None, "cd"]), 10)]
    assert [(a, z) for a, z, _ in got] == [(0, 1), (1, 4)] and len(got[0][2]) == 50 and got[1][2] == b"abcd"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.data())
def test_fm_index_finds_every_place(text, data):
    text = np.array([*text, *text[: len(text) // 2], 0])
    index = FMIndex(text, 4, step=5)
    patterns = data.draw(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=6))
    table = np.zeros((len(patterns), 5), np.int64)
    for r, p in enumerate(patterns):
        table[r, 5 - len(p) :] = p
    lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    for r, p in enumerate(patterns):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[r], hi[r])).tolist()) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12), st.integers(97, 99)), max_size=4)), min_size=1, max_size=5), st.integers(0, 3))
def test_banded_distance(cases, limit):
    pairs = []
    for a, edits in cases:
        b = bytearray(a)
        for kind, at, c in edits:
            if kind == 0:
                b.insert(min(at, len(b)), c)
            elif at < len(b):
                b[at : at + 1] = b"" if kind == 1 else bytes([c])
        pairs.append((a, bytes(b)))
    flat = [x for p in pairs for x in p]
    size = np.array([len(x) for x in flat])
    start = np.cumsum(size) - size
    got = within(np.frombuffer(b"".join(flat), np.uint8), (start[::2], size[::2]), (start[1::2], size[1::2]), limit)
    assert got.tolist() == [min(edit_distance(a, b), limit + 1) for a, b in pairs]


def test_segments_are_found_at_the_probed_shifts():
    """Any two strings within the threshold share a segment at one of the shifts."""
    random.seed(3)
    for _ in range(3000):
        t = random.choice((1, 2, 3))
        a = [random.choice("abc") for _ in range(random.randint(t + 1, 12))]
        b = list(a)
        for _ in range(random.randint(0, t)):
            k = random.randint(0, len(b))
            b[k : k + random.randint(0, 1)] = random.choice(([], ["x"], [random.choice("abc")]))
        if edit_distance("".join(a).encode(), "".join(b).encode()) > t or min(len(a), len(b)) < t + 1:
            continue
        long, short = sorted((a, b), key=len, reverse=True)
        parts, n, found = t + 1, len(short), False
        for k in range(parts):
            base, extra = n // parts, n % parts
            p, size = k * base + max(0, k - (parts - extra)), base + (k >= parts - extra)
            for s in probe_shifts(t, k, len(long) - n):
                found |= p + s >= 0 and long[p + s : p + s + size] == short[p : p + size]
        assert found


def test_sum_of_squares_fills_bins_without_gaps():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 4000)
    bins, offsets = sum_of_squares(sizes, 100)
    for b in range(bins.max() + 1):
        of = np.flatnonzero(bins == b)
        of = of[np.argsort(offsets[of])]
        assert offsets[of].tolist() == (np.cumsum(sizes[of]) - sizes[of]).tolist() and sizes[of].sum() <= 100
    assert bins.max() + 1 <= 1.05 * sizes.sum() / 100


def test_sum_of_squares_rule_by_brute_force():
    rng = np.random.default_rng(2)
    sizes, cap = rng.integers(1, 20, 300), 20
    bins, _ = sum_of_squares(sizes, cap)
    load: dict[int, int] = {}
    for s, chosen in zip(sizes.tolist(), bins.tolist()):
        def cost(b, s=s):
            after = dict(load)
            after[b] = after.get(b, 0) + s
            gaps = [cap - v for v in after.values() if v < cap]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = {b: cost(b) for b, v in load.items() if v + s <= cap} | {len(load): cost(len(load))}
        assert options[chosen] == min(options.values())
        load[chosen] = load.get(chosen, 0) + s


def test_sum_of_squares_rejects_what_doesnt_fit():
    with pytest.raises(ValueError):
        sum_of_squares(np.array([5]), 4)


@pytest.mark.parametrize("text", ["", "a\n\n b  c\t d", "I'll  don't foo  bar", "<|endoftext|> a", "  lead", " \n \n", "é\x1c b\x85c", "​q  　z", "漢字 かな", "12 345 abc!!!  \n", "naïve Übergröße"])
def test_encoder_gives_the_vocabularys_ids(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(default_vocabulary()).encode(text), "<u4").tolist() == ids
    assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(encoder(default_vocabulary()).encode(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(0, 300)), max_size=12))
def test_suppression_by_brute_force(raw):
    rules = load_rules()
    found = sorted({(s, s + n, r) for s, n, r in raw})
    kept: list[tuple[int, int, int]] = []
    for s, e, r in sorted(found, key=lambda d: (rules[d[2]].priority, d[0] - d[1], d[2], d[0])):
        if not any(a <= s and e <= z for a, z, _ in kept):
            kept.append((s, e, r))
    assert suppress(found, rules) == sorted(kept)


def test_rules_hold_their_keyword():
    rules = load_rules()
    assert len(rules) >= 300 and len({r.order for r in rules}) == len(rules)
    for r in rules:
        text = r.regex.pattern.replace("licen[sc]ed", "licensed licenced ").replace("licen[sc]e", "license licence ").replace("open ?rail", "open rail openrail")
        assert any(all(x in text for x in k.split()) for k in r.keywords), r


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_local_components(edges):
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    node, root = local_roots(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == components(sorted({x for e in edges for x in e}), edges)


def test_prefix_bounds_hold():
    for percent in (80, 90):
        for n in range(1, 80):
            for m in range(n, 100):
                o = overlap(n, m, percent)
                if o > n:
                    continue
                assert 100 * o >= percent * (n + m - o) and 100 * (o - 1) < percent * (n + m - o + 1)
                assert n - o + 1 <= prefix_size(np.array(n), percent) and m - o + 1 <= prefix_size(np.array(m), percent)
                assert n + m - 2 * o <= min(most_apart(np.array(n), percent), most_apart(np.array(m), percent))


def test_intersections():
    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert intersections(left, right).tolist() == want


def test_collision_counts():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((90, 9)), rng.standard_normal((70, 9))
    count = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.8).sum(2)
    for needed in range(10):
        assert set(zip(*map(np.ndarray.tolist, frequent_pairs(a, b, 0.8, needed)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(count >= needed))))


def test_needed_collisions_reach_the_recall():
    k, p = needed_collisions(32, 1.5, 0.99), math.erf(1.5 / math.sqrt(2))
    tail = lambda k: sum(math.comb(32, j) * p**j * (1 - p) ** (32 - j) for j in range(k, 33))
    assert tail(k) >= 0.99 > tail(k + 1)
