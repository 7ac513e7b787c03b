"""Naive Bayes support vectors for document quality.

A document is the set of its word and punctuation n-grams (one and two long),
hashed to a fixed number of features. Each indicator is scaled by the log ratio
of its smoothed frequencies in the two classes; a linear hinge-loss model over
the scaled indicators is fitted by dual coordinate descent. All labelled rows train
it: log ratios come from sums over all of them, the linear model is the mean of those
of parts of about ``PART_BYTES`` of text (weighted by rows), each fitted in a task, and
the logistic curve is fitted on all their margins, each under a model that has not
seen the row. The driver sees sums only.

Defined cases: a null text is an empty one and gets the score of no features;
texts of any length are scored and trained on whole (a row is at most a bitmap of
all features, 32 kB); label rows without a label or an id are left out, of
repeated labels of one id the smallest counts, of repeated rows of a labelled id
the text with the smallest hash; with fewer than two classes the score is the share of label 1
(0.5 with no labels); null ids and repeated rows are scored like others; empty
tables give no rows; further columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, featured, materialize, summed

#: Features of all texts together, and bytes of text of a part of the labelled rows.
FEATURES = 1 << 18
PART_BYTES = 32 << 20
#: Margins are counted in steps of 1/GRID up to REACH.
GRID, REACH = 4096, 64
ACCEPT = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


def pack(f: np.ndarray) -> bytes:
    """Distinct sorted features in their numbers or, where that is shorter, as a bitmap of all features."""
    if 4 * len(f) < FEATURES // 8:
        return f.astype("<i4").tobytes()
    return np.packbits(np.bincount(f, minlength=FEATURES).astype(bool)).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if len(b) == FEATURES // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))
    return np.frombuffer(b, "<i4")


def features(text: str | None) -> np.ndarray:
    """Hashed indicators of a whole text, distinct, sorted."""
    tokens = TOKEN.findall(text or "")
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    # A share of letters in capitals or of tokens without letters says more than any one of them.
    bare = sum(not t[0].isalnum() for t in tokens)
    high = sum(t.isupper() and len(t) > 1 for t in tokens)
    marks = (f"\0bare {min(9, 20 * bare // n)}", f"\0high {min(9, 20 * high // n)}", f"\0same {10 * len(set(tokens)) // n}")
    crc = zlib.crc32
    own = " ".join(tokens).encode("utf-8", "surrogatepass").split(b" ")
    one = list(map(crc, own))
    two = map(crc, [b" " + x for x in own[1:]], one)  # a checksum goes on from that of the word before
    return np.unique(np.array([*one, *two, *(crc(m.encode()) for m in marks)], np.int64) % FEATURES)


@dataclass(frozen=True)
class Model:
    """weights per feature, bias, and the two numbers that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum()) / max(1.0, len(f) ** 0.5) + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def log_ratios(seen: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratios of smoothed frequencies, by how many texts of label 0 and 1 hold a feature."""
    p = seen + smooth
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def scaled(d: bytes, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a document's row: log ratios over the root of their number, and a one for the bias."""
    at = unpack(d)
    return np.r_[at, FEATURES], np.r_[ratio[at] / max(1.0, len(at) ** 0.5), 1.0]


def dual_descent(row: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int, enough: float = 1e-2) -> np.ndarray:
    """Weights of the L2-regularised hinge loss over sparse rows (the last feature is the bias); ``row`` gives one of them."""
    w = np.zeros(FEATURES + 1)
    alpha, norm = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, v = row(i)
            norm[i] = norm[i] or float(v @ v)
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < enough:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, y), by Newton steps with a little shrinkage. Of n rows each, y is the share of label 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(n * (p - y) * margin).sum() + 1e-2 * a, (n * (p - y)).sum() + 1e-2 * b])
        q = n * (p * (1 - p) + 1e-9)
        h = np.array([[(q * margin**2).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def descend(docs: list[bytes], y: np.ndarray, ratio: np.ndarray, share: np.ndarray, cost: float = 0.1, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights over scaled indicators, and a bias, of packed feature sets and 0/1 labels; share weighs the labels."""
    return dual_descent(lambda i: scaled(docs[i], ratio), np.where(y, 1.0, -1.0), cost * share[y.astype(int)], epochs, seed)


def shares(n: np.ndarray) -> np.ndarray:
    """Weights that make n rows of each label count alike."""
    return n.sum() / (2 * np.maximum(1, n))


def flat(n: np.ndarray) -> Model:
    """The model where one label has no rows: the share of label 1, one half without any."""
    p = float(np.clip(n[1] / n.sum() if n.sum() else 0.5, 1e-6, 1 - 1e-6))
    return Model(np.zeros(FEATURES), 0.0, 1.0, float(np.log(p / (1 - p))))


def fit_rows(docs: list[bytes], y: np.ndarray) -> Model:
    """Fit on packed feature sets and 0/1 labels at hand. The curve is fitted on margins of folds that the model has not seen."""
    if len(y) == 0 or y.all() or not y.any():
        return flat(np.bincount(y, minlength=2))
    y = y.astype(int)

    def train(at: np.ndarray) -> tuple[np.ndarray, float]:
        seen = np.zeros((2, FEATURES))
        for i in at:
            seen[y[i], unpack(docs[i])] += 1
        r = log_ratios(seen)
        w = descend([docs[i] for i in at], y[at], r, shares(np.bincount(y[at], minlength=2)))
        return w[:-1] * r, float(w[-1])

    folds = np.arange(len(y)) % 2
    margins = np.zeros(len(y))
    for k in range(2):
        at = np.flatnonzero(folds != k)
        if y[at].all() or not y[at].any():
            continue
        m = Model(*train(at), 1.0, 0.0)
        for i in np.flatnonzero(folds == k):
            margins[i] = m.margin(unpack(docs[i]))
    return Model(*train(np.arange(len(y))), *platt(margins, y.astype(float)))


def encode(text: str) -> bytes:
    """A text's features, packed as the steps from each to the next."""
    return zlib.compress(np.diff(features(text), prepend=0).astype("<i4").tobytes(), 1)


#: A labelled row: its part, its fold, its label and its features.
Row = tuple[int, int, int, np.ndarray]


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for part, key, label, made in zip(*(b.column(c) for c in ("part", "key", "label", "made")), strict=True):
            yield part.as_py(), key.as_py() & 1, int(label.as_py() != 0), np.cumsum(np.frombuffer(zlib.decompress(made.as_py()), "<i4"))


def counted(table: DataFrame) -> np.ndarray:
    """(2, 2, FEATURES + 1): texts by fold and label that hold a feature; the last column counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((2, 2, FEATURES + 1))
        for _, fold, y, f in decoded(batches):
            out[fold, y, f] += 1
            out[fold, y, -1] += 1
        if out[..., -1].any():  # a task may read a piece of a file in which no row begins
            yield out

    total = summed(table, run, 4 * (FEATURES + 1))
    return np.zeros((2, 2, FEATURES + 1)) if total is None else total.reshape(2, 2, -1)


def mixed(table: DataFrame, ratios: list[np.ndarray], share: list[np.ndarray]) -> np.ndarray:
    """Weights and bias of three models, which leave out fold 0, fold 1 and none: means of those of all parts, weighted by rows."""
    held = table.sparkSession.sparkContext.broadcast((ratios, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((3, FEATURES + 2))
        for _, rows in groupby(decoded(batches), key=lambda r: r[0]):
            folds, labels, docs = zip(*((fold, y, pack(f)) for _, fold, y, f in rows), strict=True)
            for k, (r, s) in enumerate(zip(*held.value, strict=True)):
                at = np.flatnonzero(np.array(folds) != k)
                if len(at):
                    w = descend([docs[i] for i in at], np.array(labels)[at], r, s)
                    out[k] += len(at) * np.r_[w, 1.0]
        if out[2, -1]:
            yield out

    total = summed(table, run, 3 * (FEATURES + 2)).reshape(3, -1)
    held.destroy()
    return total[:, :-1] / np.maximum(1, total[:, -1:])


def margins(table: DataFrame, models: list[Model | None]) -> DataFrame:
    """at, n, hits: rows, and those of label 1, by the margin (in steps of 1/GRID, within REACH) under the model of their fold; 0 without one."""
    held = table.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(round(GRID * min(max(m.margin(f), -REACH), REACH)) if (m := held.value[fold]) else 0, y) for _, fold, y, f in decoded([b])]
            cols = list(zip(*rows, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["at", "y"])

    return table.mapInArrow(run, "at int, y int").groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from all labelled rows of docs outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    table = materialize(featured(docs, labels, label, encode, PART_BYTES))
    seen = counted(table)
    each = [seen[1], seen[0], seen.sum(axis=0)]
    n = [x[:, -1] for x in each]
    if not n[2].all():
        return flat(n[2])
    ratios = [log_ratios(x[:, :-1]) for x in each]
    weights = mixed(table, ratios, [shares(x) for x in n])
    unseen = [Model(weights[k, :-1] * ratios[k], float(weights[k, -1]), 1.0, 0.0) if n[k].all() else None for k in range(2)]
    curve = np.array([tuple(r) for r in margins(table, unseen).orderBy("at").collect()], float)  # bounded by the steps
    return Model(weights[2, :-1] * ratios[2], float(weights[2, -1]), *platt(curve[:, 0] / GRID, curve[:, 2] / curve[:, 1], n=curve[:, 1]))


def score_column(model: Model, text: Column, spark) -> Column:
    """The score of each whole text."""
    held = spark.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(features(t)) for t in texts], dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(text.cast("string"))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, as they are, whose score is at least ``accept``."""
    return docs.where(score_column(model, docs["text"], docs.sparkSession) >= accept)
