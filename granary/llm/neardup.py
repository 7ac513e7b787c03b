"""Near copies by MinHash bands and sequential Bayesian verification: sets of word shingles at or above a Jaccard similarity.

Each distinct set is handled once: 125 minima under random functions make 25 bands
of five, and 128 minima, 8 bits of each, its signature (unlike values are equal by chance once in 256, which drops nothing). A pair at similarity 0.85
shares a band with a chance of 1 - 4e-7, one at 0.8 of 1 - 5e-5. Candidates are
compared a batch of 32 signature values at a time. After each batch the posterior
of their similarity (uniform before any value) tells the chance that it reaches the
least one; a pair is dropped where that is below ``MISS``. Survivors are verified
exactly on their full sets.

Bands of few sets give all their pairs, a band of many its sets with the first one.
Bands of many that the components of verified pairs do not yet connect are searched
pair by pair between components, in two steps: chunks of signatures, which are of
one size whatever the texts, mark the sets that have a plausible partner, and only
those meet again in chunks of bounded bytes of whole sets, for exact verification.
So nothing is lost that the first set is not near to, and no task holds more than
two chunks. The first step is quadratic in an open band, at about 4e7 pairs a core
and second.

Defined cases: a text of fewer words than a shingle is one shingle; texts without
words are one group (``first_of_each``) or linked with nothing (``near_duplicates``
of a rule that says so); null ids stay and are never a component's id unless all
are null; repeated rows are in one group; empty tables give no rows; further
columns, whatever their names, pass through (``first_of_each``) or are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize, spread_join
from granary.llm.simhash import components, fingerprint_column
from granary.llm.simhash import links as fingerprint_links

SEED = 42
BANDS, ROWS = 25, 5
#: Values of a signature, and those compared at once.
VALUES, BATCH = 128, 32
#: Chance of being near below which a candidate is dropped.
MISS = 1e-6
#: Bands of more sets than this are not paired at once.
SMALL_GROUP = 8
#: Signatures (128 bytes each) and bytes of sets of a chunk; a task holds two chunks.
CHUNK, CHUNK_BYTES = 4096, 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, the least similarity as a fraction, and whether texts without words are alike."""

    shingle: int = 5
    least: tuple[int, int] = (4, 5)
    empty_alike: bool = True


#: Of stages on word shingles, and of op12.
STAGE, QUERY = Rule(), Rule(3, (85, 100), False)


def shingle_set(text: str | None, shingle: int = STAGE.shingle) -> np.ndarray:
    """The distinct 64-bit hashes of all shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = min(shingle, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ own[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 1 << 64, (2, VALUES), np.uint64)
    return a | np.uint64(1), b


def minima(hashes: np.ndarray) -> np.ndarray:
    a, b = multipliers()
    least = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[lo : lo + 2048, None] ^ b) * a).min(axis=0), out=least)
    return least


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """(one key a band, signed; the signature); none for an empty set."""
    if not len(hashes):
        return [], b""
    least = minima(hashes)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]
    mixed = (least ^ (least >> np.uint64(32))) * MIX
    return np.array(keys, np.uint64).view(np.int64).tolist(), (mixed >> np.uint64(56)).astype("u1").tobytes()


@cache
def needed(least: tuple[int, int], n: int) -> int:
    """The fewest equal values of n that leave a chance of ``MISS`` or more that a pair's similarity is the least one.

    With m of n equal that similarity is Beta(m + 1, n - m + 1), and its chance to
    reach t is that of at most m heads in n + 1 throws of a coin of chance t.
    """
    t, chance = least[0] / least[1], 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if chance >= MISS:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which rows of two tables of signatures (or of one and a single signature) may be near: batch after batch of those left."""
    rows = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for lo in range(0, VALUES, BATCH):
        other = b[lo : lo + BATCH] if b.ndim == 1 else b[rows, lo : lo + BATCH]
        equal = equal + np.count_nonzero(a[rows, lo : lo + BATCH] == other, axis=1)
        left = equal >= needed(least, lo + BATCH)
        rows, equal = rows[left], equal[left]
        if not len(rows):
            break
    return rows


def near(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, least: tuple[int, int] = STAGE.least) -> np.ndarray | bool:
    """Whether sets of n and m elements with so many in common are near."""
    return least[1] * common >= least[0] * (n + m - common)


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def print_column(text: Column, rule: Rule) -> Column:
    """sid: the set's own 128-bit hash; n: its size; keys: its bands; sig: its signature."""

    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, rule.shingle) for t in texts]
        sketches = [sketch(s) for s in sets]
        return pd.DataFrame({"sid": [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], "n": [len(s) for s in sets], "keys": [k for k, _ in sketches], "sig": [g for _, g in sketches]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "sid binary, n long, keys array<long>, sig binary")(text.cast("string"))


def set_column(text: Column, rule: Rule) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, rule.shingle).tobytes() for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(text.cast("string"))


def plausible_column(a: Column, b: Column, rule: Rule) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if len(a):
            left, right = (np.frombuffer(b"".join(x), "u1").reshape(-1, VALUES) for x in (a, b))
            out[plausible(left, right, rule.least)] = True
        return pd.Series(out)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(a, b)


def near_column(a: Column, b: Column, rule: Rule) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        return pd.Series([bool(near(in_common(x, y), len(x), len(y), rule.least)) for x, y in sets], dtype=bool)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(a, b)


def like_sizes(n: Column | np.ndarray, m: Column | np.ndarray, least: tuple[int, int]) -> Column | np.ndarray:
    """What near sets' sizes fulfil."""
    return (least[1] * n >= least[0] * m) & (least[1] * m >= least[0] * n)


def partners(signatures: np.ndarray, sizes: np.ndarray, label: np.ndarray, p: int, least: tuple[int, int]) -> np.ndarray:
    """The sets behind p that may be near it and have another label."""
    other = np.flatnonzero((label[p + 1 :] != label[p]) & like_sizes(sizes[p + 1 :], sizes[p], least)) + p + 1
    return other[plausible(signatures[other], signatures[p], least)] if len(other) else other


def unlinked_pairs(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray | None = None, least: tuple[int, int] = STAGE.least) -> list[tuple[int, int]]:
    """Near pairs that link what the roots, and pairs before, do not link yet: fewer than there are sets."""
    if signatures is None:
        signatures = np.stack([np.frombuffer(sketch(s)[1], "u1") for s in sets])
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    out = []
    for p in range(len(ids) - 1):
        for q in partners(signatures, sizes, label, p, least):
            if label[q] != label[p] and near(in_common(sets[p], sets[q]), sizes[p], sizes[q], least):
                out.append((int(ids[p]), int(ids[q])))
                label[label == label[q]] = label[p]
    return out


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), "u1").reshape(-1, VALUES)


def _marked(rule: Rule):
    """Of a pair of chunks, the sets that have a plausible partner in another component."""

    def run(table: pa.Table) -> pa.Table:
        signatures, sizes = _signatures(table), table.column("size").to_numpy()
        label = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        mark = np.zeros(len(label), bool)
        for p in range(len(label) - 1):
            found = partners(signatures, sizes, label, p, rule.least)
            mark[found] = True
            mark[p] |= len(found) > 0
        return table.select(["key", "uid"]).filter(pa.array(mark))

    return run


def _unlinked(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        found = unlinked_pairs(table.column("uid").to_numpy(), table.column("root").to_numpy(), sets, _signatures(table), rule.least)
        return pa.table({"u": pa.array([p[0] for p in found], pa.int64()), "v": pa.array([p[1] for p in found], pa.int64())})

    return run


def with_value(rows: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the value of their key, which may be very frequent. values: uid, value."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    return spread_join(rows, counts.join(values.select(F.col("uid").alias(key), F.col("value").alias(name)), key), key)


def dealt(rows: DataFrame, chunks: Column) -> DataFrame:
    """rows to every pair (i, j) of chunks of their band that has theirs."""
    own = rows.withColumn("i", F.pmod(F.xxhash64("uid"), chunks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    return own.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """u, v: candidates whose SimHash fingerprints (fp) lie within its threshold.

    Sets of one fingerprint meet the first of them, and first ones meet along the
    forest that spans all close fingerprints.
    """
    first = materialize(classes.groupBy("fp").agg(F.min("uid").alias("head"), F.count("*").alias("n_rows")))
    own = spread_join(classes.select("uid", "fp"), first, "fp").where("uid <> head").select(F.col("head").alias("u"), F.col("uid").alias("v"))
    a, b = (first.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "uv")
    close = fingerprint_links(first.select("fp")).join(a, "u").join(b, "v").select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    return own.unionByName(close).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def links(rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """u, root: the sets that are near others, with the smallest uid that they reach (roots left out)."""
    least = rule.least
    signatures = classes.select("uid", F.col("sig").alias("value"))
    banded = classes.select("uid", F.col("n").alias("size"), F.explode("keys").alias("key"))
    bands = materialize(banded.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("uid").alias("head"), F.min_by("size", "uid").alias("head_size")).where("n_rows > 1"))
    members = materialize(spread_join(banded, bands.withColumn("n", F.col("n_rows")), "key").where("head is not null"))
    few, many = members.where(F.col("n") <= SMALL_GROUP), members.where(F.col("n") > SMALL_GROUP)
    a, b = (few.select("key", F.col("uid").alias(x), F.col("size").alias(f"size_{x}")) for x in "uv")
    both = a.join(b, "key").where((F.col("u") < F.col("v")) & like_sizes(F.col("size_u"), F.col("size_v"), least)).select("u", "v")
    star = many.where((F.col("uid") != F.col("head")) & like_sizes(F.col("size"), F.col("head_size"), least)).select(F.col("head").alias("u"), F.col("uid").alias("v"))
    some = both.unionByName(star)
    if "fp" in classes.columns:
        some = some.unionByName(simhash_pairs(classes.where("n > 0")))
    pairs = materialize(some.distinct())
    signed = with_value(with_value(pairs, signatures, "u", "sig_u"), signatures, "v", "sig_v")
    left = materialize(signed.where(plausible_column(F.col("sig_u"), F.col("sig_v"), rule)).select("u", "v"))

    def whole(uids: DataFrame) -> DataFrame:
        """uid, value: the whole sets of some rows. As a table the list has a size that Spark knows before it plans: a small one is broadcast, and texts move only to meet a large one."""
        wanted = materialize(uids.distinct())
        return materialize(rows.join(wanted.withColumnRenamed("uid", "_near_uid"), "_near_uid").select(F.col("_near_uid").alias("uid"), set_column(F.col("text"), rule).alias("value")))

    sets = whole(left.select(F.col("u").alias("uid")).unionByName(left.select(F.col("v").alias("uid"))))
    verified = with_value(with_value(left, sets, "u", "set_u"), sets, "v", "set_v").where(near_column(F.col("set_u"), F.col("set_v"), rule)).select("u", "v")
    verified = materialize(verified)
    rooted = components(verified)
    # Bands of many sets that are not one component yet.
    placed = materialize(many.join(rooted, F.col("uid") == F.col("u"), "left").select("key", "uid", "size", "n", F.coalesce("root", "uid").alias("root")))
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_rows")).where("lo < hi").select("key", "n_rows", F.lit(True).alias("open"))
    apart = materialize(spread_join(placed, open_, "key").where("open").drop("open"))
    if apart.isEmpty():
        return rooted
    signed = with_value(dealt(apart, F.ceil(F.col("n") / CHUNK)), signatures, "uid", "sig").select("key", "i", "j", "uid", "size", "root", "sig")
    marks = materialize(signed.groupBy("key", "i", "j").applyInArrow(_marked(rule), apart.select("key", "uid").schema).distinct())
    if marks.isEmpty():
        return rooted
    again = apart.join(marks, ["key", "uid"], "left_semi").select("key", "uid", "root", "size")
    bytes_ = again.groupBy("key").agg(F.count("*").alias("n_rows"), F.ceil(F.sum(F.col("size") * 8) / CHUNK_BYTES).alias("chunks"))
    again = dealt(materialize(spread_join(again, bytes_, "key")), F.col("chunks")).select("key", "i", "j", "uid", "root")
    held = with_value(with_value(again, signatures, "uid", "sig"), whole(marks.select("uid")), "uid", "set")
    more = held.groupBy("key", "i", "j").applyInArrow(_unlinked(rule), "u long, v long")
    return components(verified.unionByName(more).distinct())


def grouped(docs: DataFrame, rule: Rule, simhash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(docs with _near_uid, one a row, and _near; the near copies' groups: sid, component_id, n_rows, uid of the row that stays)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = materialize(docs.withColumn("_near_uid", F.monotonically_increasing_id()).withColumn("_near", print_column(F.col("text"), rule)).withColumns({"_near_fp": fingerprint_column(F.col("text"))} if simhash else {}))
    doc = F.col("doc_id").cast("long")
    order = F.struct(doc.isNull().alias("no_id"), doc.alias("id"), F.xxhash64(*docs.columns).alias("content"), F.col("_near_uid").alias("uid"))
    own = F.struct("_near.n", "_near.keys", "_near.sig", *([F.col("_near_fp").alias("fp")] if simhash else []))
    classes = rows.groupBy(F.col("_near.sid").alias("sid")).agg(F.min(order).alias("first"), F.count("*").alias("n_rows"), F.first(own).alias("own"))
    classes = materialize(classes.select("sid", "own.*", "n_rows", "first", F.col("first.uid").alias("uid")))
    rooted = links(rows, classes, rule)
    member = classes.join(rooted, F.col("uid") == F.col("u"), "left").select("sid", "n_rows", "first", F.coalesce("root", "uid").alias("root"))
    low = member.groupBy("root").agg(F.min("first").alias("least"))
    groups = member.join(low, "root").select("sid", "n_rows", F.col("least.id").alias("component_id"), F.col("least.uid").alias("uid"))
    return rows, materialize(groups)


def near_duplicates(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether it is the component's own row): one row per input row."""
    rows, groups = grouped(docs.select("doc_id", "text"), rule)
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_near.sid").alias("sid"), F.col("_near.n").alias("n_shingles"))
    out = spread_join(own, groups.drop("uid"), "sid")
    of = F.col("component_id") if rule.empty_alike else F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, rule: Rule = STAGE, simhash: bool = False) -> DataFrame:
    """The rows of docs, as they are, that come first in their group: by id (null last), then by a hash of the row, then any of the equal ones."""
    rows, groups = grouped(docs, rule, simhash)
    kept = groups.select(F.col("uid").alias("_near_uid")).distinct()
    dropped = materialize(rows.select("_near_uid").join(kept, "_near_uid", "left_anti"))
    return rows.join(dropped, "_near_uid", "left_anti").select(docs.columns)
