"""Document quality by co-training two views.

The text view sees only what is written (word and symbol statistics,
repetition), the metadata view only source, language and stated length.  Both
are ridge logistic regressions, first fitted to the labelled rows.  In each round
one pass over all documents without a label scores them by both views, as
calibrated on labelled rows that neither was trained on; each view's confident
pseudo-labels go to the other (Blum and Mitchell, 1998), unless that one is as sure
of the opposite.  A view is confident if both its calibrated odds and their ratio to
the odds among labels reach those of ``sure``: a view that only knows the share of
good documents gives nothing.  The tasks return what a Newton step of the other view's
regression needs, sums of gradients and curvatures, so any number of documents
takes part and only sums of the model's size reach the driver.  Pseudo-labels are
decided anew each round; those of a kind weigh at most ``trust`` times the
labelled rows of that kind.  At last a logistic regression over both calibrated
logits gives the score.

Features are computed once, into a table in the shared folder.  The first fit uses
at most ``labelled_rows`` labelled documents (chosen by a hash of the id; a
parameter), whose features, no texts, reach the driver.  Every document is scored,
by a narrow map.

Cases: null or empty texts have features of zero; null metadata are values of
their own; unknown sources fall into hashed slots; without usable labels of
both kinds every score is 0.5 and nothing is predicted low; repeated ids are
scored row by row, rows without id too, but these train nothing; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import join_sized, materialise, tidy

SOURCE_SLOTS, LANG_SLOTS = 64, 16
RUN = re.compile(r"([^\w\s])\1")
N_TEXT, N_META = 16, 5


def text_features(text: str | None) -> list[float]:
    if not text or not (words := text.split()):
        return [0.0] * N_TEXT
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text))
    spaces = sum(map(str.isspace, text))
    digits = sum(map(str.isdigit, text))
    upper = sum(map(str.isupper, text))
    symbols = size - letters - spaces - digits
    plain = sum(w.isalpha() for w in words)
    return [
        math.log1p(n), sum(map(len, words)) / n, upper / max(1, letters), symbols / size, digits / size, plain / n,
        len(counts) / n, counts.most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines), math.log1p(size / len(lines)), text.count("|") / n, len(RUN.findall(text)) / n,
        sum(len(w) <= 3 for w in words) / n, sum(text.count(c) for c in ".!?") / n, len(set(text)) / math.sqrt(size),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Slots of source and language, then what is said of the length."""
    size = math.log1p(max(0, n_chars or 0))
    return [zlib.crc32(f"s{source}".encode()) % SOURCE_SLOTS, zlib.crc32(f"l{lang}".encode()) % LANG_SLOTS, size, size * size / 10, float(n_chars is None)]


def unpack(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both views, from stored features; slots become columns of 0 and 1."""
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), N_TEXT + N_META).astype(float)
    slots = np.zeros((len(x), SOURCE_SLOTS + LANG_SLOTS))
    at = np.arange(len(x))
    slots[at, x[:, N_TEXT].astype(int)] = 1.0
    slots[at, SOURCE_SLOTS + x[:, N_TEXT + 1].astype(int)] = 1.0
    return x[:, :N_TEXT], np.column_stack((slots, x[:, N_TEXT + 2 :]))


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -30, 30)

    def sums(self, x: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log-likelihood of these rows."""
        z, p = self.design(x), sigmoid(self.logit(x))
        return z.T @ (y - p), (z * (p * (1 - p) + 1e-9)[:, None]).T @ z

    def newton(self, gradient: np.ndarray, curvature: np.ndarray, ridge: float = 1.0) -> tuple[Linear, float]:
        """The regression after one step, and the step's size."""
        penalty = np.full(len(self.weights), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        return Linear(self.mean, self.scale, self.weights + np.clip(step, -5, 5)), np.abs(step).max()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Linear:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    model = Linear(mean, scale, np.zeros(x.shape[1] + 1))
    for _ in range(30):
        model, size = model.newton(*model.sums(x, y))
        if size < 1e-7:
            break
    return model


@dataclass
class Model:
    views: tuple[Linear, Linear] | None = None
    calibrated: tuple[Linear, Linear] | None = None
    joint: Linear | None = None
    pseudo: int = 0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, both) as probabilities of good quality."""
        if self.joint is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        own = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, (text, meta), strict=True)]
        return tuple(sigmoid(z) for z in (*own, self.joint.logit(np.column_stack(own))))


Views = tuple[Linear, Linear]
#: (target view, kind): number of rows, gradient and upper curvature, in one array.
Sums = dict[tuple[int, int], np.ndarray]


def exchange(views: Views, calibrated: Views, rows: tuple[np.ndarray, np.ndarray], sure: float, base: float = 0.0) -> Sums:
    """What these rows add to a step of each view, by the other view's pseudo-labels; base: logit of the share of good labels."""
    z = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(views, calibrated, rows, strict=True)]
    p, least = [sigmoid(x) for x in z], math.log(sure / (1 - sure))
    out = {}
    for target in (0, 1):
        for kind in (0, 1):
            sign = 2 * kind - 1
            given = np.minimum(sign * z[1 - target], sign * (z[1 - target] - base)) > least
            opposed = (1 - p[target] if kind else p[target]) > sure
            x = rows[target][given & ~opposed]
            gradient, curvature = views[target].sums(x, float(kind))
            out[target, kind] = np.concatenate(([len(x)], gradient, curvature[np.triu_indices(len(gradient))]))
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, part: np.ndarray, pool: Callable[[Views, Views, float], Sums], rounds: int = 4, trust: float = 5.0) -> Model:
    """part: whether a labelled row trains (True) or calibrates; pool: the sums of ``exchange`` over all rows without a label."""
    if not len(y) or min(y.min(), y[part].min(initial=1)) == max(y.max(), y[part].max(initial=0)) or len(set(y[~part].tolist())) < 2:
        return Model()
    both = (text, meta)
    views = tuple(fit(v[part], y[part]) for v in both)
    calibrate = lambda views: tuple(fit(m.logit(v[~part])[:, None], y[~part]) for m, v in zip(views, both, strict=True))
    share = y[~part].mean()
    calibrated, pseudo, base = calibrate(views), 0, math.log(share / (1 - share))
    for _ in range(rounds):
        found = pool(views, calibrated, base)
        pseudo = int(sum(s[0] for s in found.values()))
        if not pseudo:
            break
        stepped = []
        for target, view in enumerate(views):
            gradient, curvature = view.sums(both[target][part], y[part])
            n = len(gradient)
            for kind in (0, 1):
                s = found[target, kind]
                weight = min(1.0, trust * float((y[part] == kind).sum()) / max(1.0, s[0]))
                upper = np.zeros((n, n))
                upper[np.triu_indices(n)] = s[1 + n :]
                gradient = gradient + weight * s[1 : 1 + n]
                curvature = curvature + weight * (upper + np.triu(upper, 1).T)
            stepped.append(view.newton(gradient, curvature)[0])
        views = tuple(stepped)
        calibrated = calibrate(views)
    logits = [c.logit(m.logit(v[~part])[:, None]) for c, m, v in zip(calibrated, views, both, strict=True)]
    return Model(views, calibrated, fit(np.column_stack(logits), y[~part]), pseudo)


def _pool_sums(pool: DataFrame, sure: float) -> Callable[[Views, Views, float], Sums]:
    """The exchange over a table of features, as one job: tasks add up their rows, a shuffle adds up the tasks."""

    def sums(views: Views, calibrated: Views, base: float) -> Sums:
        shared = pool.sparkSession.sparkContext.broadcast((views, calibrated))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    found = exchange(*shared.value, unpack(batch.column("x").to_pylist()), sure, base)
                    flat = np.concatenate([found[k] for k in sorted(found)])
                    total = flat if total is None else total + flat
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "value"])

        rows = pool.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        widths = [1 + n + n * (n + 1) // 2 for n in (len(v.weights) for v in views) for _ in (0, 1)]
        flat = np.zeros(sum(widths))
        for row in rows:
            flat[row["at"]] = row["value"]
        return dict(zip(((0, 0), (0, 1), (1, 0), (1, 1)), np.split(flat, np.cumsum(widths)[:-1]), strict=True))

    return sums


def _inputs(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(size_col).cast("long").alias("n_chars"))


COLUMNS = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang", "size_col": "n_chars"}


def features(docs: DataFrame, **columns) -> DataFrame:
    """id and packed features of every row, as a table in the shared folder."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
            raw = [np.array(text_features(t) + meta_features(s, g, n), np.float32).tobytes() for t, s, g, n in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "x"])

    return materialise(_inputs(docs, **(COLUMNS | columns)).mapInArrow(run, "id long, x binary"), "quality-features")


def train(made: DataFrame, labels: DataFrame, keep, label_col: str = "quality", label_id: str = "doc_id", labelled_rows: int = 12_000, sure: float = 0.9, rounds: int = 4) -> Model:
    """From ``features``; labels are used only of ids that ``keep`` allows, all other documents are the pool."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull())
    usable = materialise(usable.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(keep(F.col("id"))), "quality-labels")
    n = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, labelled_rows / max(1, n)) * (1 << 20)))
    rows = join_sized(made, chosen, ["id"], "inner", 24, n).orderBy("id", "label", "x").collect()
    if not rows:
        return Model()
    text, meta = unpack([bytes(r["x"]) for r in rows])
    label = np.array([r["label"] for r in rows], float)
    part = np.array([zlib.crc32(f"part{r['id']}".encode()) % 4 != 0 for r in rows])
    pool = join_sized(made.where("id IS NOT NULL"), usable.select("id"), ["id"], "left_anti", 16, n)
    return co_train(text, meta, label, part, _pool_sums(pool, sure), rounds)


def score(made: DataFrame, model: Model) -> DataFrame:
    """From ``features``, one row per input row: id, score (of good quality), text_score, meta_score."""
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m, both = shared.value.scores(*unpack(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(both), pa.array(t), pa.array(m)], ["id", "score", "text_score", "meta_score"])

    return made.mapInArrow(run, "id long, score double, text_score double, meta_score double")
