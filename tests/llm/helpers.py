"""Plain-Python restatements for the tests."""

from __future__ import annotations

import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None, rule: re.Pattern = ALNUM) -> list[str]:
    return rule.findall((text or "").translate(LOWER))


def documents(spark, texts: dict[int, str | None], lang: str | None = "en"):
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS)


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text, SPACE)
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([("whole", *w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return components(ids, links)


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def removed_lines(texts: dict[int, str | None], threshold: int = 2, least: int = 40) -> dict[int, list[int]]:
    lines = [(i, k, x.encode()) for i, t in sorted(texts.items()) if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    out: dict[int, list[int]] = {}
    for at, (i, k, x) in enumerate(lines):
        if any(abs(len(y) - len(x)) <= threshold and edit_distance(x, y) <= threshold for _, _, y in lines[:at]):
            out.setdefault(i, []).append(k)
    return out


def contamination(texts: dict[int, str | None], items: dict, window: int = 10) -> dict[int, tuple[int, int, list[str]]]:
    grams = {}
    for item, t in items.items():
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, t in texts.items():
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def after_line_dedup(texts: dict[int, str | None], kept: set[int], threshold: int = 2, least: int = 40) -> dict[int, str | None]:
    """Texts without their repeated lines.  A document that lost lines goes if all that is left
    are short lines that documents holding its lost lines have, too.  Where several earlier
    lines are near a lost one, any of them may be the one looked at: then ``kept`` decides."""
    gone = removed_lines(texts, threshold, least)
    lines = {i: t.split("\n") for i, t in texts.items() if t is not None}
    places = [(i, k, x.encode()) for i, of in sorted(lines.items()) for k, x in enumerate(of) if len(x.encode()) >= least]
    first: dict[bytes, tuple[int, int]] = {}
    for i, k, x in places:
        first.setdefault(x, (i, k))
    out = {}
    for i, t in texts.items():
        if i not in gone:
            out[i] = t
            continue
        left = [x for k, x in enumerate(lines[i]) if k not in gone[i]]
        some, every = set(), set()  # holders in any case, and all that may be one
        for k in gone[i]:
            x = lines[i][k].encode()
            near = {first[y][0] for y in first if y != x and first[y] < (i, k) and abs(len(x) - len(y)) <= threshold and edit_distance(x, y) <= threshold}
            some.add(first[x][0])
            every |= {first[x][0]} | near
        own = [x for x in left if any(c.isalnum() for c in x)]

        def goes(holders):
            short = {y for h in holders if h != i for y in lines[h] if len(y.encode()) < least}
            return all(len(x.encode()) < least for x in left) and all(x in short for x in own)

        if goes(some) or goes(every) and i not in kept:
            continue
        out[i] = "\n".join(left)
    return out
