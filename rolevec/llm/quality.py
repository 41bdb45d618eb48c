"""Quality classifier from weak labels.

Heuristic labellers vote good (+1), bad (-1) or abstain (0) on every document.
Expectation-maximisation over the counts of vote patterns (an aggregation over all
documents; few of the 3**15 possible ones occur) estimates each labeller's accuracies and
the share of good documents.  The posterior of a pattern labels a bounded sample
(``TRAIN_DOCS``, drawn by a hash over all rows), on which a hashed linear scorer is
fitted; it then scores every document from its whole text.

Toxicity is found the same way.  Its labellers vote by rates per word: of a short list of
insults and of toxic terms (words and openings of words) of the document's own language,
learned from at most ``LABELLED_DOCS`` labelled documents whose id isn't held out.  A
single word never makes a labeller vote toxic.

Two scans and no shuffle of texts.  Defined results: a null or empty text scores 0 and
isn't toxic; equal texts of a language get equal answers; a null language is one of its
own; without labels, or in a language without learned terms, only the list of insults
votes; a document with several labels is toxic if one says so; with an empty table there
are no rows; if all documents vote alike the posterior is that of the prior; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolevec.llm.langid import held_out
from rolevec.llm.linear import BUCKETS, Rows, fit_logistic, raw_table, row_blocks, scores, sigmoid, trigrams
from rolevec.llm.ship import map_batches
from rolevec.llm.textkit import U64, Words, hash_word, mix64
from rolevec.session import stage_table

TRAIN_DOCS = 4000
KEEP = 0.5
STAT_BINS = 16
STAT_WEIGHT = 0.35
LABELLED_DOCS = 8000  # even over languages and labels
OPENINGS = (4, 6, 8)  # bytes of the openings of words that can be toxic terms
TERM_LIFT = 8  # how many times more often a term is in toxic documents
TERM_EVIDENCE = 20.0  # least G statistic of a term
LANGUAGE_TERMS = 1024  # strongest terms kept of a language
TOXIC_RATE = 0.01  # share of a text's words

#: Frequent function words of several languages.
STOP_WORDS = """the of and to in is it for on that with as was by at from this are be
der die das und ist von den im zu mit ein eine für nicht auf
le la les de des et un une est que pour dans en qui sur
el los las y del por con para una no se su al lo""".split()
#: Abusive words; one labeller of several goes by them.
ABUSIVE_WORDS = """idiot moron scum loser clown stupid worthless pathetic disgusting trash
imbecile bastard bitch asshole retard whore slut fuck fucking shithead dumbass""".split()

#: Statistics per document, in the order of :func:`statistics`.
STATS = ["n_words", "symbol_share", "upper_share", "top_word_share", "distinct_share", "same_line_share", "stop_share", "word_length", "digit_share", "tail_symbol_share", "separator_share", "repeat_share"]


def statistics(data: np.ndarray, off: np.ndarray, w: Words) -> np.ndarray:
    """Rows of :data:`STATS`."""
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    n = w.counts().astype(float)
    some = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[off[1:]] - sums[off[:-1]]).astype(float)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = ((data >= 33) & (data <= 47) & ~np.isin(data, np.frombuffer(b"'(),-.", np.uint8))) | np.isin(data, np.frombuffer(b"<=>@[\\]^_`{|}~", np.uint8))
    digit = (data >= 48) & (data <= 57)
    cased = share(upper) + share(lower)
    row = w.rows()
    # Distinct words and the most frequent one, by sorting (row, word).
    order = np.lexsort((w.hash, row))
    key, r = w.hash[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(order)))
    distinct = np.bincount(r[heads], minlength=rows).astype(float)
    top = np.zeros(rows)
    np.maximum.at(top, r[heads], runs.astype(float))
    stop = np.isin(w.hash, np.array([hash_word(x) for x in STOP_WORDS], np.uint64))
    per_word = lambda mask: np.bincount(row[mask], minlength=rows).astype(float)
    # A word followed by a symbol at once, but for sentence marks.
    after = np.append(data, 32)[w.end]
    tail = np.isin(after, np.frombuffer(b"#$%&*!|~^_", np.uint8))
    # Symbols that stand alone between blanks, per word.
    blank = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
    alone = share(symbol & blank[:-2] & blank[2:])
    # Words equal to the one before, or to the one before that.
    again = np.zeros(len(w.hash), bool)
    for back in (1, 2):
        again[back:] |= (w.hash[back:] == w.hash[:-back]) & (row[back:] == row[:-back])
    # Lines that repeat the one before or an earlier line of the document.
    same = np.zeros(rows)
    for k in np.flatnonzero(share(data == 10) > 0):
        lines = [x for x in data[off[k] : off[k + 1]].tobytes().split(b"\n") if x.strip()]
        if lines:
            same[k] = 1 - len(set(lines)) / len(lines)
    return np.stack((n, share(symbol) / np.maximum(size, 1), share(upper) / np.maximum(cased, 1), top / some, distinct / some, same,
                     per_word(stop) / some, (np.bincount(row, w.end - w.start, rows) if len(row) else np.zeros(rows)) / some,
                     share(digit) / np.maximum(size, 1), per_word(tail) / some, alone / some, per_word(again) / some), axis=1)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


#: (name, vote) of the overlapping labellers, over the columns of :data:`STATS`.
LABELLERS = [
    ("length", lambda s: _vote(s, s[:, 0] >= 30, s[:, 0] < 1)),
    ("symbols", lambda s: _vote(s, s[:, 1] < 0.02, s[:, 1] > 0.06)),
    ("shouting", lambda s: _vote(s, s[:, 2] < 0.15, s[:, 2] > 0.5)),
    ("one_word", lambda s: _vote(s, (s[:, 3] < 0.12) & (s[:, 0] >= 20), (s[:, 3] > 0.3) & (s[:, 0] >= 10))),
    ("vocabulary", lambda s: _vote(s, (s[:, 4] > 0.4) & (s[:, 0] >= 20), (s[:, 4] < 0.15) & (s[:, 0] >= 20) & (s[:, 0] < 2000))),
    ("lines", lambda s: _vote(s, s[:, 5] == 0, s[:, 5] > 0.3)),
    ("function_words", lambda s: _vote(s, s[:, 6] > 0.1, (s[:, 6] < 0.02) & (s[:, 0] >= 30))),
    ("word_length", lambda s: _vote(s, (s[:, 7] > 3) & (s[:, 7] < 9), (s[:, 7] > 14) & (s[:, 0] >= 5))),
    ("digits", lambda s: _vote(s, s[:, 8] < 0.05, s[:, 8] > 0.25)),
    ("word_tails", lambda s: _vote(s, s[:, 9] < 0.02, s[:, 9] > 0.2)),
    ("separators", lambda s: _vote(s, s[:, 10] < 0.02, (s[:, 10] > 0.15) & (s[:, 0] >= 5))),
    ("repeats", lambda s: _vote(s, s[:, 11] < 0.05, (s[:, 11] > 0.15) & (s[:, 0] >= 10))),
    ("stutter", lambda s: _vote(s, (s[:, 11] < 0.08) & (s[:, 3] < 0.2), (s[:, 11] > 0.1) & (s[:, 3] > 0.1) & (s[:, 0] >= 10))),
    ("marks", lambda s: _vote(s, (s[:, 1] < 0.03) & (s[:, 10] < 0.05), (s[:, 1] > 0.04) & ((s[:, 10] > 0.08) | (s[:, 9] > 0.1)))),
    ("capitals", lambda s: _vote(s, s[:, 2] < 0.2, (s[:, 2] > 0.4) & (s[:, 0] >= 5))),
]


def votes(stats: np.ndarray, labellers: list = LABELLERS) -> np.ndarray:
    return np.stack([f(stats) for _, f in labellers], axis=1)


def word_terms(data: np.ndarray, w: Words, salt: np.ndarray) -> Iterator[np.ndarray]:
    """Per kind of term, its key for every word (``salt``: of the word's language); the word
    itself comes first, then its openings, which are 0 where the word isn't longer."""
    yield mix64(w.hash ^ salt)
    low = np.append(np.where((data >= 65) & (data <= 90), data + 32, data), np.zeros(max(OPENINGS), np.uint8)).astype(U64)
    code = np.zeros(len(w.start), U64)
    for j in range(max(OPENINGS)):
        code |= low[w.start + j] << U64(8 * j)
        if j + 1 in OPENINGS:
            yield np.where(w.end - w.start > j + 1, mix64(mix64(code + U64(j)) ^ salt), U64(0))


def language_salts(langs: list[str]) -> np.ndarray:
    return mix64(np.array([zlib.crc32(x.encode()) for x in langs], U64))


class ToxicTerms:
    """Learned toxic terms (keys salted by language), and the languages that have any."""

    def __init__(self, keys: np.ndarray, langs: list[str]) -> None:
        self.keys, self.langs = np.unique(keys.astype(U64)), frozenset(langs)
        self.insults = np.array([hash_word(x) for x in ABUSIVE_WORDS], U64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> U64(48)).astype(int)] = True

    def has(self, key: np.ndarray) -> np.ndarray:
        out = self.maybe[(key >> U64(48)).astype(int)]
        out[out] = np.isin(key[out], self.keys)
        return out

    def statistics(self, data: np.ndarray, off: np.ndarray, w: Words, langs: list[str]) -> np.ndarray:
        """Per row: words, insults, words that are terms, that open with one, that are any of
        these, how many different ones, and 1 if the language has learned terms."""
        rows, row = len(off) - 1, w.rows()
        insult = np.isin(w.hash, self.insults)
        word, *opening = [self.has(k) for k in word_terms(data, w, language_salts(langs)[row])] if self.langs else [np.zeros(len(row), bool)] * 2
        opens = np.logical_or.reduce(opening)
        hit = insult | word | opens
        of_row = lambda mask: np.bincount(row[mask], minlength=rows).astype(float)
        different = np.unique(np.stack((row[hit].astype(U64), w.hash[hit])), axis=1)[0].astype(int)
        return np.stack((w.counts().astype(float), of_row(insult), of_row(word), of_row(opens), of_row(hit), np.bincount(different, minlength=rows).astype(float),
                         np.array([x in self.langs for x in langs], float)), axis=1)


def _rate_vote(s: np.ndarray, j: int, knows: np.ndarray) -> np.ndarray:
    """Toxic at twice at least and a rate of ``TOXIC_RATE``; abstains where it knows nothing."""
    return np.where(knows, _vote(s, (s[:, j] < 2) | (s[:, j] < 0.6 * TOXIC_RATE * s[:, 0]), (s[:, j] >= 2) & (s[:, j] >= TOXIC_RATE * s[:, 0])), 0).astype(np.int8)


#: (name, vote) of the toxicity labellers, over the columns of :meth:`ToxicTerms.statistics`; -1 is toxic.
TOXIC_LABELLERS = [
    ("insults", lambda s: _rate_vote(s, 1, s[:, 1] > 0)),
    ("words", lambda s: _rate_vote(s, 2, s[:, 6] > 0)),
    ("openings", lambda s: _rate_vote(s, 3, s[:, 6] > 0)),
    ("any_term", lambda s: _rate_vote(s, 4, s[:, 0] > 0)),
    ("variety", lambda s: _vote(s, (s[:, 5] < 2) | (s[:, 4] < 0.4 * TOXIC_RATE * s[:, 0]), (s[:, 5] >= 2) & (s[:, 4] >= 0.8 * TOXIC_RATE * s[:, 0]))),
]
TOXIC_BINS = 16


def toxic_features(s: np.ndarray) -> np.ndarray:
    """Bins of the rates of :meth:`ToxicTerms.statistics`; what occurs less than twice has none."""
    x = np.zeros((len(s), 5 * TOXIC_BINS), np.float32)
    for j in range(5):
        cell = np.minimum((s[:, j + 1] / np.maximum(s[:, 0], 1) * 4 / TOXIC_RATE).astype(int), TOXIC_BINS - 1)
        some = s[:, j + 1] >= 2
        x[np.flatnonzero(some), j * TOXIC_BINS + cell[some]] = 1
    return x


def pattern_code(v: np.ndarray) -> np.ndarray:
    """A vote pattern as a number to base three."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def pattern_votes(code: np.ndarray, n: int) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(n)) % 3 - 1


class LabelModel:
    """Two classes; cast votes independent given the class, an abstention says nothing.
    ``rates[c, j]``: probability that labeller j, if it votes, votes good on class c."""

    def __init__(self, prior: float, rates: np.ndarray) -> None:
        self.prior, self.rates = prior, rates

    @staticmethod
    def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
        """EM from the balance of votes; a labeller is taken to be right more often than not."""
        p = np.clip(0.5 + 0.5 * np.tanh(patterns.sum(1) / 2), 0.02, 0.98)
        # one bad vote weighs as much as several good ones at the start: labellers flag faults
        p = np.where((patterns < 0).any(1), np.minimum(p, 0.1), p)
        model = LabelModel(0.5, np.full((2, patterns.shape[1]), 0.5))
        for _ in range(rounds):
            model = LabelModel._maximise(patterns, counts, p, smooth)
            p = model.posterior(patterns)
        return model

    @staticmethod
    def _maximise(patterns: np.ndarray, counts: np.ndarray, p: np.ndarray, smooth: float) -> LabelModel:
        rates = np.empty((2, patterns.shape[1]))
        for c, weight in enumerate((counts * (1 - p), counts * p)):
            yes, no = (weight[:, None] * (patterns > 0)).sum(0), (weight[:, None] * (patterns < 0)).sum(0)
            rates[c] = (yes + smooth) / (yes + no + 2 * smooth)
        total = counts.sum()
        return LabelModel(float(((counts * p).sum() + smooth) / (total + 2 * smooth)), rates)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good, per pattern."""
        yes = np.log(self.rates[1]) - np.log(self.rates[0])
        no = np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])
        return sigmoid((patterns > 0) @ yes + (patterns < 0) @ no + np.log(self.prior) - np.log1p(-self.prior))

    def accuracies(self) -> np.ndarray:
        """Per labeller: probability that a cast vote agrees with the class."""
        return self.prior * self.rates[1] + (1 - self.prior) * (1 - self.rates[0])


def features(data: np.ndarray, off: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Hashed trigrams of the text and hashed bins of its statistics."""
    x = trigrams(data, off, raw_table())
    for j in range(len(STATS)):
        value = np.log2(1 + stats[:, j]) if STATS[j] in ("n_words", "word_length") else np.clip(stats[:, j], 0, 1) * STAT_BINS
        cell = np.minimum(value.astype(int), STAT_BINS)
        code = np.uint64(0xD1342543DE82EF95) * (np.uint64(j + 1) * np.uint64(1000) + cell.astype(np.uint64) + np.uint64(1))
        x[np.arange(len(x)), (code >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(int)] += STAT_WEIGHT
    return x


def with_language(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang (empty if it is null or there is no such column)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))


def learn_terms(docs: DataFrame, labels: DataFrame | None, labelled_docs: int = LABELLED_DOCS) -> ToxicTerms:
    """Terms that are ``TERM_LIFT`` times as frequent in documents labelled toxic, per
    language, with a G statistic of ``TERM_EVIDENCE``.  The documents are drawn by a hash
    of the id, evenly over languages and labels; held-out ids aren't used."""
    if labels is None:
        return ToxicTerms(np.zeros(0, U64), [])
    toxic = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = docs.where(F.col("text").isNotNull()).select("doc_id", "lang").join(toxic, "doc_id")
    strata = {(r["lang"], r["toxic"]): r["n"] for r in known.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted({lang for lang, _ in strata if (lang, 0) in strata and (lang, 1) in strata})
    if not langs:
        return ToxicTerms(np.zeros(0, U64), [])
    each, parts = max(1, labelled_docs // (2 * len(langs))), 1 << 20
    limit = F.create_map(*[F.lit(v) for lang in langs for t in (0, 1) for v in (f"{t}{lang}", min(parts, -(-each * parts // strata[lang, t])))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(parts)) < F.try_element_at(limit, F.concat(F.col("toxic").cast("string"), "lang"))).select("doc_id", "toxic").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, is_toxic = b.column(1).to_pylist(), b.column(2).to_numpy()
            for lo, hi, data, off in row_blocks(b.column(0)):
                w, salt = Words(data, off), language_salts(lang[lo:hi])
                row = w.rows()
                key = np.concatenate(list(word_terms(data, w, salt[row])))
                pair = np.unique(np.stack((np.tile(row, 1 + len(OPENINGS)).astype(U64), key))[:, key != 0], axis=1)
                at = lo + pair[0].astype(int)
                yield pa.RecordBatch.from_arrays([pa.array([lang[k] for k in at.tolist()], pa.string()), pa.array(pair[1].view(np.int64)), pa.array(is_toxic[at].astype(np.int32)), pa.array(np.zeros(len(at), bool))], names=["lang", "term", "toxic", "whole"])
                yield pa.RecordBatch.from_arrays([pa.array(lang[lo:hi], pa.string()), pa.array(np.zeros(hi - lo, np.int64)), pa.array(is_toxic[lo:hi].astype(np.int32)), pa.array(np.ones(hi - lo, bool))], names=["lang", "term", "toxic", "whole"])

    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "lang", "toxic")
    rows = map_batches(sample, run, "lang string, term long, toxic int, whole boolean")
    counts = stage_table(rows.groupBy("lang", "term", "whole").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c")), "toxic-terms")
    of_lang = counts.where("whole").select("lang", F.col("t").alias("nt"), F.col("c").alias("nc")).where("nt > 0 and nc > 0")
    share, base = F.col("t") / (F.col("t") + F.col("c")), F.col("nt") / (F.col("nt") + F.col("nc"))
    g = 2 * (F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    strong = (counts.where("not whole and t > 1").join(F.broadcast(of_lang), "lang").withColumn("g", g)
              .where((F.col("t") / F.col("nt") >= TERM_LIFT * F.col("c") / F.col("nc")) & (F.col("g") >= TERM_EVIDENCE)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("g"), "term"))
    kept = strong.withColumn("rank", rank).where(F.col("rank") <= LANGUAGE_TERMS).select("lang", "term").collect()
    return ToxicTerms(np.array([r["term"] for r in kept], np.int64).view(U64), [r["lang"] for r in kept])


def vote_table(docs: DataFrame, terms: ToxicTerms) -> DataFrame:
    """doc_id, pattern and toxic_pattern (votes to base three) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, codes, toxic = b.column(2).to_pylist(), [], []
            for lo, hi, data, off in row_blocks(b.column(1)):
                w = Words(data, off)
                codes.append(pattern_code(votes(statistics(data, off, w))))
                toxic.append(pattern_code(votes(terms.statistics(data, off, w, langs[lo:hi]), TOXIC_LABELLERS)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (codes, toxic))], names=["doc_id", "pattern", "toxic_pattern"])

    return map_batches(docs, run, "doc_id long, pattern long, toxic_pattern long")


def fit_labels(patterns: DataFrame, col: str = "pattern", labellers: list = LABELLERS) -> LabelModel | None:
    """Label model from the counts of vote patterns (None for an empty table)."""
    rows = patterns.groupBy(F.col(col).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return None
    code, n = np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], float)
    order = np.argsort(code)
    return LabelModel.fit(pattern_votes(code[order], len(labellers)), n[order])


def fit_scorers(docs: DataFrame, labels: LabelModel, toxic: LabelModel, terms: ToxicTerms, n_docs: int, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Linear scorers of quality and of toxicity, fitted in one task on a bounded sample with posterior labels."""
    parts = 1 << 20
    sample = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(parts)) < min(parts, -(-train_docs * parts // max(1, n_docs)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, p, rates, q = Rows(2 * train_docs), [], [], []
        for b in batches:
            langs = b.column(2).to_pylist()
            for lo, hi, data, off in row_blocks(b.column(1)):
                w = Words(data, off)
                stats, found = statistics(data, off, w), terms.statistics(data, off, w, langs[lo:hi])
                x.add(features(data, off, stats))
                p.append(labels.posterior(votes(stats)))
                rates.append(toxic_features(found))
                q.append(1 - toxic.posterior(votes(found, TOXIC_LABELLERS)))
        if x.n:
            quality = fit_logistic(x.block(), np.concatenate(p), l2=1e-5, rounds=300)
            x.x = np.concatenate((x.block(), np.concatenate(rates)), axis=1)
            toxicity = fit_logistic(x.block(), np.concatenate(q), l2=1e-5, rounds=300)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()) for w in (quality, toxicity)], names=["weights", "toxic_weights"])

    got = map_batches(sample.repartition(1), run, "weights binary, toxic_weights binary").collect()
    return (np.frombuffer(got[0]["weights"], float), np.frombuffer(got[0]["toxic_weights"], float)) if got else no_scorers()


def no_scorers() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(BUCKETS + 1), np.append(np.zeros(BUCKETS + 5 * TOXIC_BINS), -40.0)


def score_documents(docs: DataFrame, weights: np.ndarray, toxic_weights: np.ndarray, labels: LabelModel, terms: ToxicTerms) -> DataFrame:
    """doc_id, score (linear scorer), posterior (label model), toxicity (linear scorer)."""
    text_weights, rate_weights = np.stack((weights, np.append(toxic_weights[:BUCKETS], toxic_weights[-1]))), toxic_weights[BUCKETS:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = b.column(2).to_pylist(), [[], [], []]
            for lo, hi, data, off in row_blocks(b.column(1)):
                w = Words(data, off)
                stats, found = statistics(data, off, w), terms.statistics(data, off, w, langs[lo:hi])
                empty = np.diff(off) == 0
                s = scores(features(data, off, stats), text_weights)
                out[0].append(np.where(empty, 0.0, sigmoid(s[:, 0])))
                out[1].append(labels.posterior(votes(stats)))
                out[2].append(np.where(empty, 0.0, sigmoid(s[:, 1] + toxic_features(found) @ rate_weights)))
            cols = [np.concatenate(v) if v else np.zeros(0) for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in cols)], names=["doc_id", "score", "posterior", "toxicity"])

    return map_batches(docs, run, "doc_id long, score double, posterior double, toxicity double")


def classify_quality(docs: DataFrame, keep: float = KEEP, train_docs: int = TRAIN_DOCS, labels: DataFrame | None = None) -> DataFrame:
    """Per document: ``score`` of the linear scorer, ``posterior`` of the label model,
    ``toxic`` (toxicity scorer of at least a half) and ``kept`` (score of at least ``keep``, not
    toxic).  ``labels`` (doc_id, toxic) serve to learn toxic terms and nothing else."""
    docs = with_language(docs)
    terms = learn_terms(docs, labels)
    patterns = stage_table(vote_table(docs, terms), "votes")
    model, toxic_model = fit_labels(patterns), fit_labels(patterns, "toxic_pattern", TOXIC_LABELLERS)
    if model is None or toxic_model is None:
        model, weights = LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5)), no_scorers()
    else:
        weights = fit_scorers(docs, model, toxic_model, terms, patterns.count(), train_docs)
    toxic = F.col("toxicity") >= 0.5
    return score_documents(docs, *weights, model, terms).select("doc_id", "score", "posterior", toxic.alias("toxic"), ((F.col("score") >= keep) & ~toxic).alias("kept"))
