"""SimHash near-duplicates found through anchor points of a covering code.

Fingerprints have 64 bits in three blocks. Two that differ in at most t bits
differ in at most 2t/3 of the bits of some two blocks, so each of the three
pairs of blocks is searched on its own. The 43 bits of such a subspace carry a
linear covering code: the perfect [23,12] and [15,11] codes side by side with
five free bits, covering radius R = 3 + 1. The point half way between two
close fingerprints lies within R of a codeword, so replicating each
fingerprint to every anchor within R plus its half of the threshold makes the
two meet at an anchor: no pair is lost. Anchors per fingerprint are 100 on average,
whatever the corpus, and are listed from a table of error patterns by syndrome.

Fingerprints, not documents, are compared, each distinct one once. Anchors
travel as packed blocks, not as rows. An anchor hands on a spanning forest of
its close pairs, never all of them, and components are then contracted by
alternating stars over tables in the shared folder.

Defined cases: null and empty texts have fingerprint zero, which links like any
other; null ids stay and are never a component's id unless all are null;
repeated rows link with themselves; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, discard, materialize, partitions, spread_join

SHINGLE = 4
SEED = 42
THRESHOLD = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
SUBSPACES = ((0, 1), (0, 2), (1, 2))
WIDTH = 43
GOLAY = 0b110001110101
#: Groups beyond this size are linked by a search over those not yet reached.
SMALL_GROUP = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 8192):
        h = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(lo, min(n, lo + 8192))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(text.cast("string"))


def syndrome_columns() -> np.ndarray:
    """The syndrome of each of the 43 bits, 15 bits wide."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= GOLAY
    return np.array(out + [i << 11 for i in range(1, 16)] + [0] * 5, np.int64)


def syndromes(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for i, c in enumerate(syndrome_columns()):
        if c:
            out ^= np.where((points >> np.uint64(i)) & np.uint64(1), c, 0)
    return out


COVERING_RADIUS = 4


@cache
def error_patterns(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns of weight <= radius sorted by syndrome, begin of each syndrome)."""
    layer, all_ = np.zeros(1, np.uint64), [np.zeros(1, np.uint64)]
    top = np.full(1, -1, np.int64)
    for _ in range(radius):
        grown, tops = [], []
        for bit in range(WIDTH):
            ok = top < bit
            grown.append(layer[ok] | np.uint64(1 << bit))
            tops.append(np.full(int(ok.sum()), bit, np.int64))
        layer, top = np.concatenate(grown), np.concatenate(tops)
        all_.append(layer)
    patterns = np.concatenate(all_)
    s = syndromes(patterns)
    order = np.argsort(s, kind="stable")
    return patterns[order], np.searchsorted(s[order], np.arange((1 << 15) + 1))


def subspace_points(fps: np.ndarray, which: int) -> np.ndarray:
    (a, na), (b, nb) = (BLOCKS[i] for i in SUBSPACES[which])
    mask = lambda n: np.uint64((1 << n) - 1)
    return ((fps >> np.uint64(a)) & mask(na)) | (((fps >> np.uint64(b)) & mask(nb)) << np.uint64(na))


def anchors(fps: np.ndarray, which: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, position in fps) of every copy in one subspace; its number is part of the anchor."""
    share = 2 * threshold // 3
    patterns, begin = error_patterns(COVERING_RADIUS + (share + 1) // 2)
    points = subspace_points(fps, which)
    s = syndromes(points)
    n = begin[s + 1] - begin[s]
    at = np.repeat(np.arange(len(fps)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    codewords = points[at] ^ patterns[begin[s][at] + within]
    return codewords | np.uint64(which << WIDTH), at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _replicate(threshold: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(all_), 20_000):
                fps = all_[lo : lo + 20_000]
                for which in range(len(SUBSPACES)):
                    anchor, at = anchors(fps, which, threshold)
                    bucket = (_mixed(anchor) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    pairs = np.stack([anchor, fps[at]], axis=1)[order]
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    full = np.flatnonzero(cuts[1:] > cuts[:-1])
                    blocks = [pairs[cuts[i] : cuts[i + 1]].tobytes() for i in full]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return run


def _search(points: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs of one large group: each found point is compared with those not yet reached."""
    edges, rest = [], points
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= threshold
            if near.any():
                hit = rest[near]
                edges += [(p, q) for q in hit]
                queue += list(hit)
                rest = rest[~near]
    return edges


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end with the smallest end it reaches over the edges (a, b); roots are left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _link(threshold: int):
    """Close pairs within each anchor, as a forest: (fp, smaller fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        for b in batches:
            blocks += b.column("block").to_pylist()
        if not blocks:
            return
        rows = np.frombuffer(b"".join(blocks), np.uint64).reshape(-1, 2)
        del blocks
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        anchor, fp = rows[:, 0], rows[:, 1]
        begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[begin, len(anchor)])
        lefts, rights = [], []
        left_in_group = np.repeat(begin + size, size) - np.arange(len(anchor)) - 1
        left_in_group[np.repeat(size > SMALL_GROUP, size)] = 0
        at = np.flatnonzero(left_in_group)
        for shift in range(1, SMALL_GROUP):
            at = at[left_in_group[at] >= shift]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= threshold]
            lefts.append(fp[near])
            rights.append(fp[near + shift])
        for i in np.flatnonzero(size > SMALL_GROUP):
            found = np.array(_search(np.unique(fp[begin[i] : begin[i] + size[i]]), threshold), np.uint64).reshape(-1, 2)
            lefts.append(found[:, 0])
            rights.append(found[:, 1])
        a, b = np.concatenate([*lefts, fp[:0]]), np.concatenate([*rights, fp[:0]])
        differ = a != b
        child, root = _forest(a[differ].view(np.int64), b[differ].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["u", "v"])

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """u, v: edges between distinct fingerprints whose components are those of all close pairs."""
    spark = fps.sparkSession
    # Copies of one fingerprint take 16 bytes each; a bucket then holds 32 MB at most on average.
    buckets = max(partitions(spark), fps.count() * 110 * 16 // (32 << 20) + 1)
    blocks = fps.mapInArrow(_replicate(threshold, buckets), "bucket int, block binary")
    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_link(threshold), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root: every node of the edges with the smallest node it reaches (roots left out).

    Large-star and small-star steps alternate until nothing changes; each step
    is a table in the shared folder, so a lost executor costs one step at most.
    The centre of a large star is salted.
    """
    spark = edges.sparkSession
    now = materialize(edges)
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).withColumn("m", F.least("u", "m"))
        large = materialize(spread_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = spread_join(large, low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialize(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())
        discard(spark, before, large)
        if state == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text")).alias("fp")))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    rooted = components(links(classes.select("fp"), threshold))
    member = classes.join(rooted, F.col("fp") == F.col("u"), "left").select("fp", "n_rows", "least", F.coalesce("root", "fp").alias("root"))
    low = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(member.join(low, "root").select("fp", "n_rows", "component_id"))
    return spread_join(prints, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
