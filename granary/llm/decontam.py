"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The terms of the index are five-word shingles: those of an item's question and
those of its answer (its last line, or else its last sentence; a part of fewer
words is one shingle). An item of fewer than ``LEAST_WORDS`` words in all says too
little to tell a leak from ordinary text ("Yes." is in many): it is not searched for
unless a smaller least number is asked for, and :func:`short_items` lists what is
left out. Items become postings of BM25 impacts, in blocks of items
of like thresholds, and each term keeps the largest impact in each block that it
occurs in, and in no other. Every text is a query as a whole, so a leak is found
however it is broken up: the block maxima of the terms that the text shares are
added, blocks whose sum stays below their lowest threshold are skipped, the
others are walked with WAND pivots, and every item above its own threshold is
retrieved. The work follows the postings that a text meets, not the items.

An item's threshold is its score for itself less what a text with ``overlap`` of
its shingles can lack at most, so retrieval misses no item that the verification
would confirm. Verification asks for ``overlap`` of all shingles and for ``part``
of the question's and of the answer's: a question without its answer is no leak,
an item of a single sentence has no answer to ask for.

The index goes to the executors in parts of at most ``PART_ITEMS`` items and
``PART_BYTES`` bytes of text (one longer item is a part of its own). There is one
part in use at a time; documents are read once for each.

Defined cases: null or empty texts hold nothing, items without words, or with too
few, are never found; null ids stay; repeated document rows give repeated results,
items are told apart by id and text, repeated items are one; empty tables give no
rows; texts of any length are searched whole; further columns, whatever their
names, pass through (``clean``) or are ignored (``leaks``).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize

SHINGLE = 5
#: Least share of an item's shingles, and of its question's and its answer's own.
OVERLAP, PART = 0.8, 0.5
#: Words that an item has at least, question and answer together, to be searched for.
LEAST_WORDS = 8
K1, B = 1.2, 0.75
BLOCK = 4
#: An index takes about 20 bytes for each byte of its items' texts.
PART_ITEMS, PART_BYTES = 20_000, 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table that says which hashes no shingle of the index has.
SIEVE = 20

_SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer, or else the last sentence; a single sentence has none."""
    lines = text.rstrip().rsplit("\n", 1)
    if len(lines) == 1:
        head, dot, tail = text.rstrip().rstrip(".!?").rpartition(". ")
        lines = [head + dot, tail] if dot else lines
    return (lines[0], lines[1]) if len(lines) == 2 else (lines[0], "")


def shingles(words: list) -> list[tuple]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word numbers."""
    out = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for j in range(n):
        out = (out ^ numbers[j : j + len(out)].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


class Level:
    """The index's shingles of one length: exact lookup of those of a text."""

    def __init__(self, grams: np.ndarray, terms: np.ndarray):
        h = hashes(grams.ravel(), grams.shape[1])[:: grams.shape[1]] if len(grams) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.n, self.hash, self.grams, self.terms = grams.shape[1], h[order], grams[order], terms[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.hash >> np.uint64(64 - SIEVE)] = True

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of every shingle of the text that the index has."""
        h = hashes(numbers, self.n)
        at = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE)])
        own = h[at]
        found_at, found = [], []
        place = np.searchsorted(self.hash, own)
        while len(at):  # a second round only where two shingles of the index have one hash
            ok = place < len(self.hash)
            ok[ok] = self.hash[place[ok]] == own[ok]
            at, own, place = at[ok], own[ok], place[ok]
            same = (numbers[at[:, None] + np.arange(self.n)] == self.grams[place]).all(axis=1)
            found_at.append(at[same])
            found.append(self.terms[place[same]])
            at, own, place = at[~same], own[~same], place[~same] + 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_at]), np.concatenate([none, *found])


def _expand(begin: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of terms, index into the values) for all values of the given terms."""
    n = begin[terms + 1] - begin[terms]
    row = np.repeat(np.arange(len(terms)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[terms][row]


class Detector:
    """The index of one part of the benchmark: (item key, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP, part: float = PART, least_words: int = LEAST_WORDS):
        self.overlap, self.part = overlap, part
        self.number: dict[bytes, int] = {}
        term_of: dict[tuple[int, ...], int] = {}
        rows = []
        for key, text in items:
            if len(words_of(text)) < least_words:
                continue
            parts = []
            for own in question_and_answer(text):
                words = [self.number.setdefault(w, len(self.number)) for w in words_of(own)]
                parts.append([term_of.setdefault(g, len(term_of)) for g in shingles(words)])
            if parts[0] or parts[1]:
                rows.append((key, np.array(parts[0], np.int64), np.array(parts[1], np.int64)))
        df = np.zeros(len(term_of) + 1)
        for _, q, a in rows:
            df[np.unique(np.concatenate([q, a]))] += 1
        idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
        mean = sum(len(q) + len(a) for _, q, a in rows) / max(1, len(rows))
        entries = []
        for key, q, a in rows:
            whole = np.concatenate([q, a])
            terms, n = np.unique(whole, return_counts=True)
            impact = idf[terms] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(whole) / mean))
            lacking = len(whole) - math.ceil(overlap * len(whole) - 1e-9)
            best = float(impact.sum())
            threshold = best - float(np.sort(impact)[::-1][:lacking].sum()) - 1e-5 * best
            entries.append((threshold, key, q, a, terms, impact))
        # Items of like thresholds share a block, so that its lowest one is telling.
        entries.sort(key=itemgetter(0, 1))
        self.items = [(key, q, a) for _, key, q, a, _, _ in entries]
        self.threshold = np.array([e[0] for e in entries])
        self.lowest = self.threshold[::BLOCK]
        size = [len(e[4]) for e in entries]
        term = np.concatenate([np.zeros(0, np.int64), *(e[4] for e in entries)])
        entry = np.repeat(np.arange(len(entries)), size)
        order = np.lexsort((entry, term))
        term, self.entry = term[order], entry[order]
        self.impact = np.concatenate([np.zeros(0), *(e[5] for e in entries)])[order]
        self.begin = np.searchsorted(term, np.arange(len(term_of) + 1))
        # Block maxima, only of the blocks that a term occurs in.
        block = self.entry // BLOCK
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block, self.block_most = block[first], np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.block_begin = np.searchsorted(term[first], np.arange(len(term_of) + 1))
        by_length: dict[int, list] = {}
        for g, t in term_of.items():
            by_length.setdefault(len(g), []).append((g, t))
        self.levels = [Level(np.array([g for g, _ in own], np.int64), np.array([t for _, t in own], np.int64)) for _, own in sorted(by_length.items())]

    def blocks(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, rows of terms that occur in it, their maxima) of every block whose bound reaches its lowest threshold."""
        row, at = _expand(self.block_begin, terms)
        own, most = self.block[at], self.block_most[at]
        order = np.argsort(own, kind="stable")
        row, own, most = row[order], own[order], most[order]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        if not len(cut):
            return
        bound = np.add.reduceat(most, cut)
        for k in np.flatnonzero(bound >= self.lowest[own[cut]]):
            part = slice(cut[k], cut[k + 1] if k + 1 < len(cut) else None)
            yield int(own[cut[k]]), row[part], most[part]

    def retrieve(self, terms: np.ndarray, block: int, rows: np.ndarray, most: np.ndarray) -> list[tuple[int, float]]:
        """WAND over one block: (entry, score) of every item at or above its threshold."""
        lo, hi = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for t, m in zip(terms[rows].tolist(), most.tolist(), strict=True):
            b, e = int(self.begin[t]), int(self.begin[t + 1])
            a = b + int(np.searchsorted(self.entry[b:e], lo))
            entries = self.entry[a : min(e, a + BLOCK)].tolist()
            entries = entries[: bisect_left(entries, hi)]
            lists.append([entries[0], 0, m, entries, self.impact[a : a + len(entries)].tolist()])
        least, out = float(self.lowest[block]), []
        while lists:
            lists.sort(key=itemgetter(0))
            bound, pivot = 0.0, None
            for p in lists:
                bound += p[2]
                if bound >= least:
                    pivot = p[0]
                    break
            if pivot is None:
                break
            full, score = lists[0][0] == pivot, 0.0
            for p in lists:
                if p[0] > pivot or not full and p[0] == pivot:
                    break
                at = p[1]
                if full:
                    score += p[4][at]
                    at += 1
                else:
                    at = bisect_left(p[3], pivot, at)
                p[0], p[1] = (p[3][at] if at < len(p[3]) else hi), at
            if full and score >= self.threshold[pivot]:
                out.append((pivot, score))
            lists = [p for p in lists if p[0] < hi]
        return out

    def find(self, text: str | None) -> list[tuple[int, int, float, float, float, float]]:
        """(item key, first word, score, overlap of question, of answer, of both) of each item that the text holds.

        The first word is that of the stretch, as long as the item, with most of its shingles.
        """
        words = words_of(text)
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        hits = [level.find(numbers) for level in self.levels]
        at, term = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in hits)]) for i in range(2))
        if not len(at):
            return []
        terms, have = np.unique(term), None
        out = []
        for block, rows, most in self.blocks(terms):
            for entry, score in self.retrieve(terms, block, rows, most):
                if have is None:
                    have = np.zeros(len(self.begin), bool)
                    have[terms] = True
                key, q, a = self.items[entry]
                whole = np.concatenate([q, a])
                share = [float(have[x].mean()) if len(x) else 1.0 for x in (q, a, whole)]
                if share[2] >= self.overlap - 1e-9 and min(share) >= self.part - 1e-9:
                    own = np.sort(at[np.isin(term, whole)])
                    inside = np.searchsorted(own, own + len(whole) + SHINGLE) - np.arange(len(own))
                    out.append((key, int(own[np.argmax(inside)]), score, *share))
        return sorted(out)


def parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in lists of bounded size; only one is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    own: list[tuple[int | None, str]] = []
    size = 0
    for r in items.orderBy(F.asc_nulls_first("item_id"), "text").toLocalIterator():
        more = len(r["text"].encode("utf-8", "surrogatepass"))
        if own and (len(own) >= PART_ITEMS or size + more > PART_BYTES):
            yield own
            own, size = [], 0
        own.append((r["item_id"], r["text"]))
        size += more
    if own:
        yield own


def short_items(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, text: the items that have words but too few to be searched for."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return rows.withColumn("_words", F.pandas_udf(run, "long")("text")).where((F.col("_words") > 0) & (F.col("_words") < least_words)).drop("_words")


def detectors(spark: SparkSession, benchmark: DataFrame, overlap: float = OVERLAP, part: float = PART, least_words: int = LEAST_WORDS) -> Iterator[tuple]:
    """(broadcast of a detector and its items' ids, whether it is the last) for each part, built when it is asked for."""
    rest = parts(benchmark)
    rows = next(rest, None)
    while rows is not None:
        following = next(rest, None)
        detector = Detector([(i, t) for i, (_, t) in enumerate(rows)], overlap, part, least_words)
        yield spark.sparkContext.broadcast((detector, [i for i, _ in rows])), following is None
        rows = following


FOUND = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double, overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part: float = PART, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document row and item that it holds, with score and overlaps."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held, last in detectors(spark, benchmark, overlap, part, least_words):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            detector, ids = held.value
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4)
            for b in batches:
                found = [(d, ids[i], *rest) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, *rest in detector.find(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        own = rows.mapInArrow(run, FOUND)
        if not last:
            own = materialize(own)
            held.destroy()
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], FOUND) if out is None else out


def leaking_column(text: Column, held) -> Column:
    """True where a whole text holds an item of the broadcast part."""

    def run(texts: pd.Series) -> pd.Series:
        detector = held.value[0]
        return pd.Series([bool(detector.find(t)) for t in texts], dtype=bool)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(text.cast("string"))


def clean(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part: float = PART, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs, as they are, that hold no item."""
    bounded_batches(docs.sparkSession)
    for held, last in detectors(docs.sparkSession, benchmark, overlap, part, least_words):
        docs = docs.where(~leaking_column(docs["text"], held))
        if not last:
            docs = materialize(docs)
            held.destroy()
    return docs
