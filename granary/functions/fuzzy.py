"""Similarity of strings by longest common subsequence, on a 0 to 100 scale.

The score is 100 * 2 * LCS / (len a + len b). Spark has no such function, so an
Arrow UDF computes it, with the bit-parallel recurrence of Hyyro on integers;
callers keep what reaches it small by lookups, distinct values and length bands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def ratio_column(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def sorted_tokens(text: Column) -> Column:
    """The words of a text in order of the alphabet, joined by spaces; its ratio is the token-sort ratio."""
    words = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    return F.array_join(F.array_sort(words), " ")


class Choices:
    """A vocabulary that finds its most similar entry without comparing all.

    No subsequence is longer than the characters that two texts share, so shared
    counts bound every score: they are added up for the whole vocabulary character by
    character, and entries are compared from the highest bound down to the best score.
    """

    def __init__(self, keys: Sequence[str]):
        self.keys = keys
        self.lengths = np.array([len(k) for k in keys], dtype="int64")
        self.counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            for c, n in Counter(k).items():
                held.setdefault(c, []).append((i, n))
        for c, own in held.items():
            self.counts[c] = (np.array([i for i, _ in own], dtype="int64"), np.array([n for _, n in own], dtype="int64"))

    def best(self, value: str, cutoff: float) -> int | None:
        """The place of the entry most like the value if at least ``cutoff``; the first of equals."""
        shared = np.zeros(len(self.keys), dtype="int64")
        for c, n in Counter(value).items():
            if c in self.counts:
                at, own = self.counts[c]
                shared[at] += np.minimum(own, n)
        total = self.lengths + len(value)
        bound = np.where(total > 0, 200.0 * shared / np.maximum(total, 1), 100.0)
        near = np.flatnonzero(bound >= cutoff)
        score, place = -1.0, None
        for i in near[np.argsort(-bound[near], kind="stable")].tolist():
            if bound[i] < score:
                break
            own = ratio(value, self.keys[i])
            if own > score or own == score and i < place:
                score, place = own, i
        return place if score >= cutoff else None


def best_choice(value: Column, choices: list[str], cutoff: float, token_sort: bool = False) -> Column:
    """The choice most like the value if at least ``cutoff``; the first of equals."""
    tidy = (lambda t: " ".join(sorted(t.split()))) if token_sort else (lambda t: t)
    held: list[Choices] = []  # made once a task

    def run(x: pd.Series) -> pd.Series:
        if not held:
            held.append(Choices([tidy(c) for c in choices]))

        def one(v: str | None) -> str | None:
            at = None if v is None else held[0].best(tidy(v), cutoff)
            return None if at is None else choices[at]

        known = {v: one(v) for v in x.unique()}
        return x.map(known)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(value)
