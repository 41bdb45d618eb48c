"""License scan: ordered signature rules over the words of whole texts.

A text's words, lower-cased and joined by single spaces, are matched against
hundreds of rules.  A keyword prefilter on word hashes decides which documents, and
which rules in them, are looked at; the rest cost no regex.  Overlapping detections
are resolved by priority: one inside the interval of a kept detection of a higher
priority, or of a longer one of the same priority, is suppressed.

A scan without a shuffle.  Defined results: a null text is empty; a document
without detections has no labels, null positions and score 0; equal texts get equal
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.license_rules import CONFIDENCE, Rule, load_rules
from rolevec.llm.ship import map_batches
from rolevec.llm.textkit import Words, hash_word, slices

#: Phrases whose places are counted, their labels and a word each holds.
BASE = (("under the mit license", "mit", "license"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "cc"))
BASE_CONFIDENCE = 0.95


class Scanner:
    """Rules indexed by keyword."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = load_rules() if rules is None else rules
        by_word: dict[int, list[int]] = {}
        for r in self.rules:
            for word in r.keywords:
                # A keyword of several words is gated by its first.
                by_word.setdefault(hash_word(word.split()[0]), []).append(r.order)
        for k, (_, _, word) in enumerate(BASE):
            by_word.setdefault(hash_word(word), []).append(-1 - k)
        self.words = np.array(sorted(by_word), np.uint64)
        self.rules_of = [by_word[int(w)] for w in self.words]
        self.base = [(re.compile(rf"(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label, _ in BASE]

    def gate(self, w: Words) -> dict[int, set[int]]:
        """Row -> rules whose keyword it holds (negative: base phrases)."""
        if len(w.hash) == 0:
            return {}
        at = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == w.hash)
        out: dict[int, set[int]] = {}
        if len(hit):
            pairs = np.unique(np.stack((w.rows()[hit], at[hit]), axis=1), axis=0)
            for row, k in pairs.tolist():
                out.setdefault(row, set()).update(self.rules_of[k])
        return out

    def scan(self, text: str, gated: set[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """(start, end, rule) of surviving detections and (start, label) of base places, in characters."""
        base = [(m.start(), label) for k, (phrase, label) in enumerate(self.base) if -1 - k in gated for m in phrase.finditer(text)]
        found = [(m.start(), m.end(), r) for r in sorted(g for g in gated if g >= 0) for m in self.rules[r].regex.finditer(text)]
        return suppress(found, self.rules), base


def suppress(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Drop what lies inside a kept detection that comes first by (priority, length, rule order)."""
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []  # kept intervals by start; none contains another
    ends: list[int] = []
    for s, e, r in sorted(found, key=lambda d: (rules[d[2]].priority, d[0] - d[1], d[2], d[0])):
        k = bisect_right(starts, s) - 1  # the last kept interval that starts at or before s reaches furthest
        if k >= 0 and ends[k] >= e:
            continue
        kept.append((s, e, r))
        at = bisect_left(starts, s)
        beyond = at
        while beyond < len(starts) and ends[beyond] <= e:
            beyond += 1  # intervals inside the new one need no place of their own here
        starts[at:beyond], ends[at:beyond] = [s], [e]
    return sorted(kept)


DETECTION = "struct<label: string, rule: int, first_word: bigint, last_word: bigint>"
SCHEMA = f"doc_id long, n_words long, base_at array<bigint>, base_labels array<string>, detections array<{DETECTION}>, score double"


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of words, word positions and labels of base phrases, surviving
    ``detections`` (label, rule number, word positions) and ``score``, the largest confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        for b in batches:
            for lo, hi, data, off in slices(b.column(1)):
                w = Words(data, off)
                n = hi - lo
                base_at, base_labels, detections, score = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n
                for row, gated in scanner.gate(w).items():
                    a, z = int(w.first[row]), int(w.first[row + 1])
                    raw = data.tobytes() if n == 1 else data[off[row] : off[row + 1]].tobytes()
                    shift = int(off[row]) if n > 1 else 0
                    text = b" ".join([raw[s - shift : e - shift] for s, e in zip(w.start[a:z].tolist(), w.end[a:z].tolist())]).translate(lower).decode("utf-8", "replace")
                    found, base = scanner.scan(text, gated)
                    if not found and not base:
                        continue
                    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                    word_at = lambda i: int(np.searchsorted(spaces, i))  # noqa: B023, E731
                    base_at[row] = sorted(word_at(s) for s, _ in base)
                    base_labels[row] = sorted({x for _, x in base})
                    detections[row] = [{"label": scanner.rules[r].label, "rule": r, "first_word": word_at(s), "last_word": word_at(e - 1)} for s, e, r in found]
                    score[row] = max([CONFIDENCE[scanner.rules[r].priority] for _, _, r in found] + [BASE_CONFIDENCE] * bool(base))
                kind = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(w.counts(), pa.int64()), pa.array(base_at, pa.list_(pa.int64())),
                     pa.array(base_labels, pa.list_(pa.string())), pa.array(detections, pa.list_(kind)), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "base_at", "base_labels", "detections", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def license_digest(docs: DataFrame) -> DataFrame:
    """The digest of :func:`scan_licenses`."""
    s = scan_licenses(docs)
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    return s.select("doc_id", "n_words", F.size("base_at").cast("long").alias("n_base"), F.array_min("base_at").alias("first_word"),
                    F.array_max("base_at").alias("last_word"), F.concat_ws(",", "base_labels").alias("base_labels"),
                    F.concat_ws(",", labels).alias("labels"), "score")
