"""Language identification in two steps: first the language family, then
one-versus-one linear support vector machines between the languages of it.

The models are fitted in one task on a bounded sample (``TRAIN_DOCS`` documents,
even over the languages, drawn by a hash over all rows); every document is
predicted from its whole text in a scan without a shuffle.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if
nothing could be learned; equal texts get equal answers; a language alone in its
family is decided by the family step; an empty table gives no rows; extra columns
are ignored.  Votes within a family that tie go to the larger sum of margins, then
to the alphabetically smaller language.

Whether a text is in the predicted language at all is told by that language alone: by the
mean log frequency of its trigrams, against a bound half-way between what the held-out
documents of the language reach and what trigrams by chance would (``Typical``).  Few
letters say little, so the bound falls with the error of the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolevec.llm.linear import Rows, fit_svm, letter_table, row_blocks, scores, sigmoid, trigrams
from rolevec.llm.ship import map_batches

TRAIN_DOCS = 4000
UNKNOWN = "und"
LEAST_FREQUENCY = 1e-5  # of a bucket of trigrams in a language
LOWEST = 0.002  # share of held-out documents that the bound may disregard
ERRORS = 3.0  # errors of the mean that a text may be below the bound
LEAST_HELD = 20  # held-out documents without which a language has no bound

#: ISO 639-1 codes by language family; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
    "sinitic": "yue zh",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().split("-")[0], lang)


class Typical:
    """How common a text's trigrams are in one language, whatever other languages there are."""

    def __init__(self, packed: np.ndarray) -> None:
        """``packed``: log frequency of every bucket, deviation of a single trigram, bound."""
        self.packed, self.logs, self.deviation, self.bound = packed, packed[:-2], packed[-2], packed[-1]

    def level(self, x: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Mean log frequency (squares of unit-length rows are shares), with the allowance for few letters."""
        return (x * x) @ self.logs + ERRORS * self.deviation / np.sqrt(np.maximum(letters, 1))

    @staticmethod
    def fit(x: np.ndarray, held: np.ndarray, letters: np.ndarray) -> Typical:
        """From training rows, and held-out rows with their numbers of letters."""
        logs = np.log((x * x).mean(0, dtype=float) + LEAST_FREQUENCY)
        if len(held) < LEAST_HELD:
            return Typical(np.append(logs, (0.0, -np.inf)))
        share = held * held
        deviation = float(np.sqrt(np.maximum(share @ logs**2 - (share @ logs) ** 2, 0).mean()))
        model = Typical(np.append(logs, (deviation, 0.0)))
        lowest = float(np.quantile(model.level(held, letters), LOWEST))
        return Typical(np.append(logs, (deviation, min(lowest, (lowest + float(logs.mean())) / 2))))


class LanguageModel:
    """Family models (one against the rest) and pair models within families."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]) -> None:
        self.langs = sorted(langs)
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.weights = weights

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> LanguageModel:
        model = LanguageModel(sorted(set(y.tolist())), {})
        family = np.array([family_of(v) for v in y.tolist()])
        if len(model.families) > 1:
            for f in model.families:
                model.weights[f"family:{f}"] = fit_svm(x, np.where(family == f, 1, -1))
        for members in model.members.values():
            for a, b in combinations(members, 2):
                model.weights[f"pair:{a}|{b}"] = fit_svm(x, np.where(y == a, 1, np.where(y == b, -1, 0)))
        return model

    def typical(self, x: np.ndarray, letters: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Does the row reach the bound of its language."""
        out = np.ones(len(x), bool)
        for lang in self.langs:
            rows = np.flatnonzero(langs == lang)
            if len(rows):
                own = Typical(self.weights[f"typical:{lang}"])
                out[rows] = own.level(x[rows], letters[rows]) >= own.bound
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of every row."""
        n = len(x)
        if not self.langs:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        if len(self.families) > 1:
            s = scores(x, np.stack([self.weights[f"family:{f}"] for f in self.families]))
            p = sigmoid(2 * s)
            best = s.argmax(1)
            sure = p[np.arange(n), best] / np.maximum(p.sum(1), 1e-12)
        else:
            best, sure = np.zeros(n, int), np.ones(n)
        out, score = np.empty(n, object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == k), self.members[f]
            if len(rows) == 0:
                continue
            votes, margin, prob = (np.zeros((len(rows), len(members))) for _ in range(3))
            pairs = list(combinations(range(len(members)), 2))
            if pairs:
                d = scores(x[rows], np.stack([self.weights[f"pair:{members[a]}|{members[b]}"] for a, b in pairs]))
                for (a, b), v in zip(pairs, d.T):
                    votes[:, a] += v >= 0
                    votes[:, b] += v < 0
                    margin[:, a] += v
                    margin[:, b] -= v
                    prob[:, a] += sigmoid(2 * v)
                    prob[:, b] += sigmoid(-2 * v)
            pick = (votes + margin / (1e3 * (1 + np.abs(margin).max(initial=0)))).argmax(1)
            out[rows] = np.array(members, object)[pick]
            within = prob[np.arange(len(rows)), pick] / max(1, len(members) - 1) if pairs else np.ones(len(rows))
            score[rows] = np.clip(sure[rows] * within, 0, 1)
        return out, score


def letters_of(data: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of counted bytes, which is the number of trigrams, of every row."""
    sums = np.append(0, np.cumsum(table[1][data]))
    return sums[off[1:]] - sums[off[:-1]]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on documents with a language whose id isn't held out; held-out ones, drawn alike,
    only set the bounds."""
    rows = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
            .select("doc_id", "lang", "text", held_out("doc_id").alias("held")))
    count = {r["lang"]: r["n"] for r in rows.where(~F.col("held")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return LanguageModel([], {})
    each = max(1, train_docs // len(count))
    parts = 1 << 20  # a language's share of a hash of the id
    limit = F.create_map(*[F.lit(v) for lang, n in sorted(count.items()) for v in (lang, min(parts, -(-each * parts // n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.try_element_at(limit, F.col("lang")))
    table = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = Rows(2 * train_docs), []
        x_held, y_held, letters = Rows(train_docs), [], []
        for b in batches:
            langs, held = np.array(b.column(1).to_pylist(), object), b.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in row_blocks(b.column(2)):
                got = trigrams(data, off, table)
                full = got.any(1)
                apart = full & held[lo:hi]
                x_held.add(got[apart])
                y_held.append(langs[lo:hi][apart])
                letters.append(letters_of(data, off, table)[apart])
                x.add(got[full & ~apart])
                y.append(langs[lo:hi][full & ~apart])
        if x.n:
            y, y_held, letters = np.concatenate(y).astype(str), np.concatenate(y_held).astype(str), np.concatenate(letters)
            model = LanguageModel.fit(x.block(), y)
            for lang in model.langs:
                own = y_held == lang
                model.weights[f"typical:{lang}"] = Typical.fit(x.block()[y == lang], x_held.block()[own], letters[own]).packed
            names = [*(f"lang:{v}" for v in model.langs), *model.weights]
            blobs = [*(b"" for _ in model.langs), *(w.tobytes() for w in model.weights.values())]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["name", "weights"])

    got = map_batches(sample.repartition(1), run, "name string, weights binary").collect()
    return LanguageModel([r["name"][5:] for r in got if r["name"].startswith("lang:")],
                         {r["name"]: np.frombuffer(r["weights"], float) for r in got if r["weights"]})


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a Unicode letter."""
    ascii_letter = (((data | 32) >= 97) & ((data | 32) <= 122)) & (data < 128)
    sums = np.append(0, np.cumsum(ascii_letter))
    out = sums[off[1:]] > sums[off[:-1]]
    for r in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[r] = any(c.isalpha() for c in bytes(data[off[r] : off[r + 1]]).decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score", typical_col: str | None = None) -> DataFrame:
    """The given columns with language and score (replacing columns of these names) and, if
    ``typical_col`` is given, whether the text is in that language at all."""
    more = [c for c in (lang_col, score_col, typical_col) if c]
    names = [c for c in docs.columns if c not in more]
    source, k, table = docs.select(*names), names.index("text"), letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score, typical = [], [], []
            for _, _, data, off in row_blocks(b.column(k)):
                x = trigrams(data, off, table)
                lang, s = model.predict(x)
                known = has_letter(data, off)
                langs.append(np.where(known, lang, UNKNOWN))
                score.append(np.where(known & (lang != UNKNOWN), s, 0.0))
                if typical_col:
                    typical.append(known & (lang != UNKNOWN) & model.typical(x, letters_of(data, off, table), lang))
            langs, score, typical = (np.concatenate(v) if v else np.zeros(0) for v in (langs, score, typical))
            cols = [pa.array(langs.tolist(), pa.string()), pa.array(score, pa.float64()), *([pa.array(typical.astype(bool))] if typical_col else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *more])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*source.schema.fields, *(T.StructField(c, kind) for c, kind in zip(more, kinds))])
    return map_batches(source, run, schema)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Prediction for every document: doc_id, held_out, lang_pred, score."""
    model = train(docs, train_docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Documents that are in one of the learned languages; columns unchanged.  If no
    language could be learned, all documents."""
    model = train(docs, train_docs)
    if not model.langs:
        return docs
    told = predict(docs, model, "__lang_pred", "__lang_score", "__lang_typical")
    return told.where("__lang_typical").select(*docs.columns)
