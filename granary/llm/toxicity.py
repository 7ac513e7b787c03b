"""Convolutional toxicity classifier, trained in numpy.

A word's embedding is the sum of those that its hash and the hashes of its two
prefixes select, so inflected forms share what they have in common. Filters of
several widths slide over the whole text and keep their maxima; a logistic layer
reads the maxima. Filters times embeddings is one table, so that scoring is
lookups and additions, however long the text.
Training follows gradients through the positions of the maxima with Adam, over all
labelled texts: they lie in a table of the shared folder, whole and however long,
as packed bucket ids of two bytes, in parts of about ``PART_BYTES`` of text. In each
pass a net trains on each part from the same beginning, and their mean, weighted by
rows, begins the next (parameter mixing). The driver sees sums of nets only; a
maximum over a text is that over its pieces.

The decision threshold is calibrated by language. The language is told from the
text's own function words, never from a column, and each threshold moves the
margin so that a score of 0.5 is the threshold everywhere.

Defined cases: null and empty texts are padding only; label rows without a
label or an id are left out, of repeated labels of an id the largest counts, of
repeated rows of a labelled id the text with the smallest hash; with fewer than two classes the
score is the share of label 1 (0.5 with no labels); null ids and repeated rows are
scored like others; empty tables give no rows; further columns, whatever their
names, pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, featured, materialize, summed

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = BUCKETS
#: Words of a piece of a training text, and bytes of text of a part of the training texts, over which one net passes.
PIECE, PART_BYTES = 1 << 18, 32 << 20
#: Margins are counted in steps of 1/GRID up to REACH.
GRID, REACH = 1024, 64
#: Bytes of the prefixes that a word is hashed by besides its whole.
PREFIXES = (4, 6)
#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to is in that it was for with as he on be at by this from or an are not",
    "fr": "le la les de des du et en un une que qui dans pour par sur est au avec il pas ce",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "el la los las de que y en un una por con no para es se del al lo como su",
}
LANGUAGES = tuple(FUNCTION_WORDS)
OTHER = len(LANGUAGES)
#: A language needs so many rows of either label for a threshold of its own.
ENOUGH = 20

_SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """(words, 3): the hash of each word and of its prefixes."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    parts = [words, *([w[:n] for w in words] for n in PREFIXES)]
    out = np.empty((len(words), len(parts)), np.int64)
    for k, own in enumerate(parts):
        out[:, k] = np.fromiter(map(zlib.crc32, own), np.int64, len(words))
    out[:, 1:] += np.arange(1, len(parts)) * 7919
    return out & 0xFFFFFFFF


_MARKS = [np.array([zlib.crc32(w.encode()) for w in words.split()], np.int64) for words in FUNCTION_WORDS.values()]


def language(hashes: np.ndarray) -> int:
    """Index of the language whose function words make up most of the text, or OTHER."""
    if not len(hashes):
        return OTHER
    words = np.sort(hashes[:, 0])
    counts = [int((np.searchsorted(words, m, "right") - np.searchsorted(words, m, "left")).sum()) for m in _MARKS]
    best = int(np.argmax(counts))
    return best if counts[best] else OTHER


def ids(hashes: np.ndarray) -> np.ndarray:
    """Buckets, with padding so that every filter has a position."""
    pad = np.full((max(WIDTHS) - 1 + (len(hashes) == 0), len(PREFIXES) + 1), PAD)
    return np.concatenate([hashes % BUCKETS, pad])


def pieces(x: np.ndarray, size: int = 0) -> list[np.ndarray]:
    """A text's buckets in pieces that overlap by as much as the widest filter needs."""
    size, lap = size or PIECE, max(WIDTHS) - 1
    return [x[lo : lo + size + lap] for lo in range(0, max(1, len(x) - lap), size)]


@dataclass
class Net:
    embed: np.ndarray  # (BUCKETS + 1, DIM); the last row is padding and stays zero
    taps: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray  # (widths * FILTERS,)
    rest: float

    def table(self) -> np.ndarray:
        """A row per bucket with the answers of all taps of all filters to it."""
        return np.ascontiguousarray(self.embed @ np.concatenate([t for w in WIDTHS for t in self.taps[w]], axis=1))

    def pooled(self, text: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest answer of each filter over all pieces, the buckets it comes from: filters x widest width x hashes)."""
        n_filters, widest = len(self.bias), max(WIDTHS)
        best = np.full(n_filters, -np.inf, np.float32)
        words = np.full((n_filters, widest, len(PREFIXES) + 1), PAD, np.int64)
        for x in text:
            last = len(x) - widest + 1  # positions; padding gives narrow filters as many
            for lo in range(0, last, 8192):
                own = x[lo : min(last, lo + 8192) + widest - 1]
                tap = table[own[:, 0]]
                for k in range(1, own.shape[1]):
                    tap += table[own[:, k]]
                n, first, answers = len(own) - widest + 1, 0, []
                for w in WIDTHS:
                    answer = tap[:n, first : first + FILTERS]
                    for j in range(1, w):
                        first += FILTERS
                        answer = answer + tap[j : n + j, first : first + FILTERS]
                    first += FILTERS
                    answers.append(answer)
                answer = np.concatenate(answers, axis=1)
                at = answer.argmax(axis=0)
                v = answer[at, np.arange(n_filters)]
                better = np.flatnonzero(v > best)
                best[better] = v[better]
                words[better] = own[at[better][:, None] + np.arange(widest)]
        return best + self.bias, words

    def params(self) -> list[np.ndarray]:
        return [self.embed, *(self.taps[w] for w in WIDTHS), self.bias, self.out]

    def vector(self) -> np.ndarray:
        """All parameters, one after another."""
        return np.concatenate([*(p.ravel() for p in self.params()), [self.rest]])

    def like(self, vector: np.ndarray) -> Net:
        """A net of these shapes with the parameters of a vector."""
        parts = np.split(vector[:-1], np.cumsum([p.size for p in self.params()])[:-1])
        embed, *taps, bias, out = (v.reshape(p.shape).astype(p.dtype) for v, p in zip(parts, self.params(), strict=True))
        return Net(embed, dict(zip(WIDTHS, taps, strict=True)), bias, out, float(vector[-1]))

    def copy(self) -> Net:
        return self.like(self.vector())

    def margin(self, text: list[np.ndarray], table: np.ndarray) -> float:
        best, _ = self.pooled(text, table)
        return float(np.maximum(best, 0) @ self.out + self.rest)

    def gradients(self, text: list[np.ndarray], table: np.ndarray, y: int, weight: float, into: Gradients) -> float:
        """Add one text's gradients of weight times its log loss; returns that loss."""
        best, words = self.pooled(text, table)
        live = np.maximum(best, 0)
        z = float(live @ self.out + self.rest)
        d = self.embed.dtype.type((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight)
        into.out += d * live
        into.rest += d
        g = np.where(best > 0, d * self.out, 0).astype(self.embed.dtype)
        into.bias += g
        for k, w in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            if g[part].any():
                for j in range(w):
                    own = words[part, j]
                    into.taps[k][j] += (self.embed[own].sum(axis=1) * g[part, None]).T
                    np.add.at(into.embed, own, (self.taps[w][j] * g[part]).T[:, None, :])
        return weight * float(np.logaddexp(0, z) - y * z)


class Gradients:
    """Sums over a batch, beginning with the shrinkage of each parameter."""

    def __init__(self, net: Net):
        self.embed, self.taps = 1e-4 * net.embed, [1e-3 * net.taps[w] for w in WIDTHS]
        self.bias, self.out, self.rest = np.zeros_like(net.bias), 1e-3 * net.out, np.zeros(1, net.bias.dtype)


class Adam:
    def __init__(self, *params: np.ndarray, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


#: A training text: its part, its pieces, its label and its language.
Row = tuple[int, list[np.ndarray], int, int]


def encode(text: str) -> bytes:
    """A text's language and its buckets, packed."""
    h = word_hashes(text)
    return bytes([language(h)]) + zlib.compress(ids(h).astype("<u2").tobytes(), 1)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for part, label, made in zip(*(b.column(c) for c in ("part", "label", "made")), strict=True):
            own = made.as_py()
            x = np.frombuffer(zlib.decompress(own[1:]), "<u2").reshape(-1, len(PREFIXES) + 1)
            yield part.as_py(), pieces(x), label.as_py(), own[0]


def initial(counts: np.ndarray, seen_in: np.ndarray, seed: int = 11) -> tuple[Net, np.ndarray]:
    """A net to begin with and its frozen buckets, by how many texts there are of each label and in how many a bucket occurs.

    The first embedding axis starts at each bucket's smoothed log ratio, if it occurs often enough to trust.
    """
    rng = np.random.default_rng(seed)
    (n0, n1), (c0, c1) = np.maximum(counts, 1), seen_in
    ratio = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    seen = c1 + c0
    trust = np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    embed = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[:, 0] = np.where(seen >= 3, np.clip(np.sign(ratio) * np.maximum(np.abs(ratio) - 2 * trust, 0), -4, 4), 0)
    frozen = seen < 3
    embed[frozen] = 0
    embed[PAD] = 0
    taps = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        taps[w][0, 0] = np.abs(taps[w][0, 0]) + 0.3
    n = len(WIDTHS) * FILTERS
    return Net(embed, taps, np.full(n, -0.1, np.float32), np.full(n, 0.3, np.float32), 0.0), frozen


def train(net: Net, frozen: np.ndarray, weight: np.ndarray, rows: Iterator[Row], batch: int = 64) -> int:
    """One pass of Adam steps over rows, on net itself; returns the number of rows."""
    total, rest = 0, np.full(1, net.rest, np.float32)
    adam = Adam(net.embed, *(net.taps[w] for w in WIDTHS), net.bias, net.out, rest, rate=0.02)
    while own := list(islice(rows, batch)):
        table, sums = net.table(), Gradients(net)
        for _, text, y, _ in own:
            net.gradients(text, table, y, weight[y] / len(own), sums)
        sums.embed[frozen] = 0
        adam.step(sums.embed, *sums.taps, sums.bias, sums.out, sums.rest)
        net.embed[PAD] = 0
        net.rest = float(rest[0])
        total += len(own)
    return total


@dataclass
class Model:
    net: Net | None
    slope: float
    thresholds: np.ndarray  # by language; the last is for all others
    share: float

    def __post_init__(self) -> None:
        self.ready = self.net.table() if self.net else None

    def score(self, text: str | None) -> float:
        if self.net is None:
            return self.share
        h = word_hashes(text)
        z = self.slope * (self.net.margin([ids(h)], self.ready) - self.thresholds[language(h)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _cut(margin: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap that it lies in, of n texts and hits of label 1 at each distinct margin."""
    order = np.argsort(-margin)
    m, n, right = margin[order], np.cumsum(n[order]), np.cumsum(hits[order])
    k = int(np.argmax(2 * right / (n + right[-1])))
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k] - 0.5)


def counted(table: DataFrame) -> np.ndarray:
    """(2, buckets + 1): in how many texts of each label a bucket occurs; the last column counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((2, BUCKETS + 2))
        for _, text, y, _ in decoded(batches):
            out[y, np.unique(np.concatenate([np.unique(x) for x in text]))] += 1
            out[y, -1] += 1
        if out[:, -1].any():  # a task may read a piece of a file in which no row begins
            yield out

    return summed(table, run, 2 * (BUCKETS + 2)).reshape(2, -1)


def mixed(table: DataFrame, net: Net, frozen: np.ndarray, weight: np.ndarray) -> Net:
    """The mean, weighted by rows, of nets that each pass over one part of the table from the same beginning."""
    held = table.sparkSession.sparkContext.broadcast((net, frozen, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        first, own_frozen, own_weight = held.value
        out = np.zeros(1 + len(first.vector()))
        for _, rows in groupby(decoded(batches), key=lambda r: r[0]):
            own = first.copy()
            n = train(own, own_frozen, own_weight, rows)
            out += n * np.r_[1.0, own.vector()]
        if out[0]:
            yield out

    total = summed(table, run, 1 + len(net.vector()))
    held.destroy()
    return net.like(total[1:] / total[0])


def margins(table: DataFrame, net: Net) -> DataFrame:
    """lang, at, n, hits: texts, and those of label 1, by language and margin (in steps of 1/GRID, within REACH)."""
    held = table.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        ready = own.table()
        for b in batches:
            rows = [(lang, round(GRID * min(max(own.margin(text, ready), -REACH), REACH)), y) for _, text, y, lang in decoded([b])]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["lang", "at", "y"])

    return table.mapInArrow(run, "lang int, at int, y int").groupBy("lang", "at").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", passes: int = 6) -> Model:
    """A model from all labelled rows of docs outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    table = materialize(featured(docs, labels, label, encode, PART_BYTES, F.max))
    kept = F.pmod(F.shiftright("key", 7), F.lit(4)) == 0
    counts = {(r["kept"], r["label"]): r["n"] for r in table.groupBy(kept.alias("kept"), "label").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (_, y), v in counts.items() if y == k) for k in range(2)]
    share = n[1] / sum(n) if sum(n) else 0.5
    if not all(n):
        return Model(None, 1.0, np.zeros(OTHER + 1), share)
    # A fold that lacks a label on either side is none: all rows train, and all calibrate.
    split = all(counts.get((k, y)) for k in (True, False) for y in range(2))
    rows, probe = (table.where(~kept), table.where(kept)) if split else (table, table)
    seen = counted(rows)
    texts = seen[:, -1]
    net, frozen = initial(texts, seen[:, :-1])
    for _ in range(passes):
        net = mixed(rows, net, frozen, texts.sum() / (2 * texts))
    # Thresholds come from texts that the net they are applied to has not seen, if there are any of each label.
    got = np.array([tuple(r) for r in margins(probe, net).collect()])  # bounded by languages and steps
    per = got[np.argsort(got[:, 1], kind="stable")]

    def cut(rows: np.ndarray) -> float:
        at, first = np.unique(rows[:, 1], return_index=True)
        return _cut(at / GRID, np.add.reduceat(rows[:, 2], first), np.add.reduceat(rows[:, 3], first))

    cuts = np.full(OTHER + 1, cut(per))
    for k in range(OTHER + 1):
        own = per[per[:, 0] == k]
        if min(own[:, 3].sum(), (own[:, 2] - own[:, 3]).sum()) >= ENOUGH:
            cuts[k] = cut(own)
    return Model(net, 1.0, cuts, share)


def score_column(model: Model, text: Column, spark) -> Column:
    """The score of each whole text."""
    held = spark.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(text.cast("string"))
