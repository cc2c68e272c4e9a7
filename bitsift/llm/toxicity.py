"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts in how many toxic and other documents words, and prefixes of words,
are, over three quarters of the labelled rows; the rest calibrates.  All terms in
``min_count`` documents or more have a signed log-odds.  A prefix's has a flat Dirichlet
prior; a word's prior is informative: its pseudo-counts follow the rates of its longest
counted prefix, so that rare words of a telling family count and rare words of none
don't (Monroe et al., 2008).  A word's score is its log-odds less DRIFT; so ordinary text
drifts down, and words that speak for clean text break a segment.

Scoring scans a document once and finds all maximal-scoring segments (Ruzzo and
Tompa, 1999).  A segment's score s in a text of n words is calibrated by the
extreme-value law of the largest segment of background text: lambda solves
E[exp(lambda * score)] = 1 over the words of non-toxic documents, K is matched
to their largest scores, and x = lambda * s - ln(K n) is the log of the inverse
of the expected number of such segments.  A segment is significant where that number is
at most EXPECTED.  The document's score is a logistic function, fitted on the labelled
rows, of its best x and the sum of those that are significant.

Only texts are inputs of a score.  The labelled rows used are at most
``sample_rows`` (chosen by a hash of the id), a parameter; that and ``min_count`` bound
the model's terms, of which none is dropped otherwise.  Training counts and
background scores are gathered by tasks; only the bounded model and one pair of
numbers for each sampled document reach the driver.

Cases: null and empty texts have no words and get the score of a text without
segments; without usable labels of both kinds every score is 0; a label of null
isn't used; repeated ids are scored row by row, and in training a document
counts once for each of its labels; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import bound_batches, join_sized, materialise, tidy

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
PREFIXES = (6, 5, 4)
DRIFT = 1.0
#: Scores that a word may have at most, either way.
CLIP = 6.0
#: Segments as good that background text may have, at most, for one to be significant.
EXPECTED = 0.05


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) where every place costs ``drift`` and the given ones add their score.

    Linear in the number of places given (amortised); places must ascend.
    """
    found: list[list] = []  # [first, end, sum before, sum after]
    total, last = 0.0, 0
    for at, gain in scores:
        total -= drift * (at - last)
        last = at + 1
        left, right = total, total + gain - drift
        total = right
        if right <= left:
            continue
        new = [at, at + 1, left, right]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s[3] - s[2], s[0], s[1]) for s in found]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] | None = None
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def gain(self, word: str) -> float:
        """What a word adds: its own term, else that of its longest counted prefix, else nothing."""
        held = self.terms.get(word)
        if held is None:
            for n in PREFIXES:
                if len(word) > n and (held := self.terms.get(word[:n] + "*")) is not None:
                    break
            else:
                held = 0.0
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[word] = held
        return held

    def places(self, words: list[str]) -> list[tuple[int, float]]:
        cache, gain = self.cache, self.gain
        values = [held if (held := cache.get(w)) is not None else gain(w) for w in words]
        return [(i, v) for i, v in enumerate(values) if v]

    def features(self, words: list[str]) -> tuple[float, float, list[tuple[float, int, int]]]:
        """The best calibrated segment, the sum of all that pass, and these segments."""
        if not words:
            return -8.0, 0.0, []
        base = self.log_k + math.log(len(words))
        good = [(self.lam * s - base, a, b) for s, a, b in segments(self.places(words), DRIFT)]
        best = max((x for x, _, _ in good), default=-8.0)
        passing = [g for g in good if g[0] >= -math.log(EXPECTED)]
        return max(-8.0, min(40.0, best)), min(80.0, sum(x for x, _, _ in passing)), passing

    def score(self, best: float, total: float) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind by term (a word, or a prefix and a star), and words of each kind under the empty term."""
    for batch in batches:
        counts = (Counter(), Counter())
        n = [0, 0]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = words_of(text)
            own = set(words)
            for p in PREFIXES:
                own.update([w[:p] + "*" for w in words if len(w) > p])
            counts[toxic].update(own)
            n[toxic] += 1
        for kind in (0, 1):
            counts[kind][""] = n[kind]
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep, sample_rows: int) -> DataFrame:
    """At most about ``sample_rows`` labelled rows that ``keep`` allows: id, text, toxic."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    usable = usable.where(keep(F.col("id")))
    n = usable.count()
    if n > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(sample_rows / n * (1 << 20)))
    chosen = materialise(usable, "labels")
    return join_sized(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), chosen, ["id"], "inner", 24)


def train(docs: DataFrame, labels: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 30_000, min_count: int = 5) -> Model:
    spark = docs.sparkSession
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, keep, sample_rows)
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4))), "labelled")
    counts = rows.where("part <> 0").select("text", "toxic").mapInArrow(_count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    counts = materialise(counts.where((F.col("c") + F.col("t") >= min_count) | (F.col("term") == "")), "terms")
    sizes = counts.where("term = ''").first()
    if not sizes or not sizes["c"] or not sizes["t"]:
        return Model()
    n_clean, n_toxic = sizes["c"], sizes["t"]
    model = Model(_terms({r["term"]: (r["t"], r["c"]) for r in counts.where("term <> ''").select("term", "t", "c").collect()}, n_toxic, n_clean))
    shared = spark.sparkContext.broadcast(model)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A histogram of word gains in clean documents, in hundredths."""
        for batch in batches:
            hist: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if not toxic and (words := words_of(text)):
                    hits = shared.value.places(words)
                    hist[0] += len(words) - len(hits)
                    hist.update(round(v * 100) for _, v in hits)
            yield pa.RecordBatch.from_arrays([pa.array(list(hist), pa.int64()), pa.array(list(hist.values()), pa.int64())], ["gain", "n"])

    hist = rows.where("part = 0").select("text", "toxic").mapInArrow(background, "gain long, n long").groupBy("gain").agg(F.sum("n").alias("n")).collect()
    model.lam = _lambda([(r["gain"] / 100 - DRIFT, r["n"]) for r in hist])
    # the law of the largest segment, P(S < s) = exp(-K n exp(-lambda s)): K n exp(-lambda s) averages 1 over clean documents
    first = spark.sparkContext.broadcast(Model(model.terms, model.lam))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) if not toxic]
            own = first.value
            terms = [len(w) * math.exp(-own.lam * max((s for s, _, _ in segments(own.places(w), DRIFT)), default=0.0)) for w in texts if w]
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(terms))]), pa.array([len(terms)], pa.int64())], ["total", "n"])

    sums = rows.where("part = 0").select("text", "toxic").mapInArrow(largest, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    if sums[1]:
        model.log_k = -math.log(max(1e-12, sums[0] / sums[1]))
    second = spark.sparkContext.broadcast(Model(model.terms, model.lam, model.log_k))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [second.value.features(words_of(t))[:2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("toxic")], ["best", "total", "toxic"])

    seen = rows.where("part = 0").select("text", "toxic").mapInArrow(features, "best double, total double, toxic int").collect()
    model.weights = _logistic(np.array([r[:2] for r in seen]).reshape(-1, 2), np.array([r["toxic"] for r in seen], float))
    return model


def _terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds: prefixes on a flat prior, words on that of their longest counted prefix."""
    base = math.log(n_toxic / n_clean)
    prior = n_toxic / (n_toxic + n_clean)

    def odds(t: float, c: float, strength: float, rate: float) -> float:
        return math.log((t + strength * rate) / (c + strength * (1 - rate))) - base

    out: dict[str, float] = {}
    for term, (t, c) in counts.items():
        if term.endswith("*"):
            out[term] = odds(t, c, 4.0, prior)
    for term, (t, c) in counts.items():
        if not term.endswith("*"):
            rate = prior
            for n in PREFIXES:
                if (held := counts.get(term[:n] + "*")) is not None and len(term) > n:
                    rate = (held[0] + 4.0 * prior) / (held[0] + held[1] + 4.0)
                    break
            out[term] = odds(t, c, 4.0, rate)
    return {term: round(max(-CLIP, min(CLIP, odds)), 2) for term, odds in out.items()}


def _lambda(hist: list[tuple[float, int]]) -> float:
    """The positive root of E[exp(lambda s)] = 1, or 1 where there is none."""
    s = np.array([x for x, _ in hist])
    p = np.array([n for _, n in hist], float)
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    p /= p.sum()
    low, high = 0.0, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """Ridge logistic regression by Newton's method."""
    if not len(y) or y.min() == y.max():
        return None
    z = np.column_stack((np.ones(len(y)), x))
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, passages (first and end word of each significant segment, and its x)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("x", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                best, total, passing = own.features(words_of(text))
                scores.append(own.score(best, total))
                found.append([{"first": a, "end": b, "x": x} for x, a, b in passing])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(found, kind)], ["id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, passages array<struct<first: long, end: long, x: double>>")


def held_out(id_):
    """The fold that training never sees."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold; a narrow filter."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(*own.features(words_of(t))[:2]) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))
        own.cache.clear()

    return docs.mapInArrow(run, docs.schema)
