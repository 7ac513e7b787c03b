"""Document fingerprints by randomised edit embedding.

All texts are walked with the same random bits: at step j a pointer reads a
character c and moves on if the shared bit (j, c) is set. Two texts that differ
by an edit meet again on their walks after it, so edit distance becomes Hamming
distance between the sequences of characters read. A walk of a text of n
characters has 2n steps.

A fingerprint keeps SLOTS sampled steps. Slot k takes, of the steps a walk has,
the one that is first in k's own random order of all steps, so texts of
different lengths sample the same step with probability shorter / longer, and
equal slots estimate the share of equal steps of the longer walk. A slot is one
byte, mixed from the step and the character.

Walks of a batch advance together, longest texts first, so a step is three
array operations whatever the number of texts.

:func:`near_links` bands the slots and verifies the fingerprints that share a band,
pair by pair in small bands, against the first and then between what is still
apart in large ones. :func:`near_groups` gives each row the group that this makes.

Defined cases: null and empty texts have the fingerprint of zeros and are alike
to each other only; null ids come last; rows with the same id are ordered by
the hash of their text, descending; the only row of a table is its own successor;
empty tables give no rows; further columns are ignored. A walk is a loop of two
steps a character, so a text takes its worker about six seconds a million
characters; texts are walked whole, up to 2**30 characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize, partitions, spread_join
from granary.llm.simhash import components

SLOTS = 128
PERIOD = 4096
END = 255
SEED = 20_240_229
#: Walks are planned for texts of up to 2**30 characters.
STEPS = 1 << 31
BANDS = 32
#: Bands of eight slots: a pair at 0.8 shares one of them with a chance of 0.95, one at 0.9 of 0.9999.
QUERY_BANDS = 16
#: Bands of more fingerprints than this are searched in chunks of about so many.
SMALL_GROUP, CHUNK = 24, 1000
#: Characters and texts that a worker walks at once.
BATCH_CHARS, BATCH_TEXTS = 12_000_000, 1500


@cache
def walk_bits() -> np.ndarray:
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256), np.int64)
    bits[:, END] = 0
    return bits


@cache
def samples() -> tuple[np.ndarray, list[np.ndarray]]:
    """(all sampled steps in order, for each slot its own): steps that come before all earlier ones in the slot's order."""
    rng = np.random.default_rng(SEED + 1)
    own = []
    for _ in range(SLOTS):
        at, steps = 1, [0]
        while True:
            # of the first m steps each is first with equal chance, so the next record after `at` steps is at / uniform
            at = int(at / (1.0 - rng.random())) + 1
            if at > STEPS:
                break
            steps.append(at - 1)
        own.append(np.array(steps, np.int64))
    return np.unique(np.concatenate(own)), own


def classes(text: str) -> np.ndarray:
    """Characters as bytes 0 to 254."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2_654_435_761)) >> np.uint32(8)).astype(np.uint32) % np.uint32(END)


def fingerprints(texts: list[str]) -> list[bytes]:
    """SLOTS bytes for each text."""
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    begin = np.cumsum(n + 1) - (n + 1)
    buffer = np.full(int((n + 1).sum()), END, np.uint8)
    for i, at in zip(order, begin, strict=True):
        buffer[at : at + lengths[i]] = classes(texts[i])
    steps, own = samples()
    longest = int(2 * n[0])
    rows = int(np.searchsorted(steps, longest))
    read = np.full((rows, len(texts)), END, np.uint8)
    position, bits = begin.copy(), walk_bits()
    active = np.searchsorted(-2 * n, -np.arange(longest), side="left")
    char, move = np.empty(len(texts), np.uint8), np.empty(len(texts), np.int64)
    sampled = np.zeros(longest + 1, bool)
    sampled[steps[:rows]] = True
    row, take, add, m = 0, np.take, np.add, -1
    for j, (now, keep) in enumerate(zip(active.tolist(), sampled.tolist(), strict=False)):
        if now != m:
            m = now
            p, c, b = position[:m], char[:m], move[:m]
        take(buffer, p, out=c, mode="clip")
        if keep:
            read[row, :m] = c
            row += 1
        take(bits[j % PERIOD], c, out=b, mode="clip")
        add(p, b, out=p)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    some = n > 0
    for k, mine in enumerate(own):
        which = np.searchsorted(mine, 2 * n) - 1
        at = np.searchsorted(steps, mine)[np.maximum(which, 0)]
        symbol = read[np.minimum(at, max(rows - 1, 0)), np.arange(len(texts))] if rows else np.zeros(len(texts), np.uint8)
        mixed = (steps[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        out[some, k] = (1 + ((mixed >> np.uint64(40)) % np.uint64(255)))[some]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return [out[i].tobytes() for i in back]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, 0 to 1."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def places(ids: np.ndarray, hashes: np.ndarray, splits: np.ndarray, null_parts: int) -> np.ndarray:
    """The partition of each row in descending order of id (NaN: null, last) and, where an id is many splits, of hash."""
    share = hashes.astype(np.float64) / 2.0**64 + 0.5
    low, high = np.searchsorted(splits, ids, side="left"), np.searchsorted(splits, ids, side="right")
    up = low + np.minimum(np.floor(share * np.maximum(1, high - low)), np.maximum(0, high - low - 1))
    none = len(splits) + 1 + np.minimum(np.floor((1 - share) * null_parts), max(0, null_parts - 1))
    return np.where(np.isnan(ids), none, len(splits) - up).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to their partition."""
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("doc_id"), b.column("hash"), pa.array(texts, pa.binary())], ["bucket", "doc_id", "hash", "text"])


#: Kinds of rows in a partition: a document's group, a document, the borrowed first document of the next partition.
NEAR, OWN, BORROWED = 0, 1, 2


def descending(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """doc_id, hash, text (compressed), kind, near_id: partitions in descending order of id, each followed by the first row of the next.

    Rows of one id are in descending order of their text's hash. The texts move
    once, compressed. Only ids are sampled for the split points; an id that takes
    several of them, and null ids, are dealt by hash to as many partitions. One
    row a partition is borrowed, so nothing here grows with a group. Rows of
    ``near`` (doc_id, hash, near_id) come just before the documents they are of.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    n = partitions(spark)
    known = rows.where("doc_id is not null")
    splits = sorted(known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)) if n > 1 else []
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts, null_parts = np.array(splits, np.float64), -(-n * nulls // max(1, total))

    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(places(ids.to_numpy(np.float64, na_value=np.nan), hashes.to_numpy(np.int64), cuts, null_parts))

    place.__annotations__ = {"ids": pd.Series, "hashes": pd.Series, "return": pd.Series}
    bucket = F.pandas_udf(place, "int")(F.col("doc_id"), F.col("hash"))
    first = F.max(F.struct("doc_id", "hash")).alias("head")
    heads = {r["bucket"]: r["head"] for r in rows.select(bucket.alias("bucket"), "doc_id", "hash").groupBy("bucket").agg(first).collect()}
    full = sorted(heads)
    after = [(*heads[b], full[i - 1]) for i, b in enumerate(full)]  # the last bucket is followed by the first
    head = F.broadcast(spark.createDataFrame(after, "head long, head_hash long, bucket int"))
    same = rows.join(head, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash")))
    borrowed = same.groupBy("bucket", "doc_id", "hash").agg(F.min("text").alias("text"))
    packed = "bucket int, doc_id long, hash long, text binary"
    none = F.lit(None).cast("long").alias("near_id")
    own = rows.withColumn("bucket", bucket).mapInArrow(_packed, packed).select("*", F.lit(OWN).alias("kind"), none)
    dealt = own.unionByName(borrowed.mapInArrow(_packed, packed).select("*", F.lit(BORROWED).alias("kind"), none))
    if near is not None:
        dealt = dealt.unionByName(near.select(bucket.alias("bucket"), "doc_id", "hash", F.lit(None).cast("binary").alias("text"), F.lit(NEAR).alias("kind"), "near_id"))
    dealt = dealt.repartitionById(len(cuts) + 1 + null_parts, F.col("bucket"))
    # The borrowed row comes after all; a document's group before it.
    return dealt.sortWithinPartitions(F.col("kind") == BORROWED, F.desc_nulls_last("doc_id"), F.desc("hash"), "kind").select("doc_id", "hash", "text", "kind", "near_id")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long"


def _edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple[int, str, int]], follows: str) -> pa.RecordBatch:
        texts = [t for _, t, _ in rows]
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], follows], strict=True)]
        prints = fingerprints([*texts, follows, *changed])
        own, new = prints[: len(rows) + 1], prints[len(rows) + 1 :]
        cols = [
            pa.array([d for d, _, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([p.hex() for p in own[:-1]]),
            pa.array([p.hex() for p in new]),
            pa.array([likeness(p, q) for p, q in zip(own, new, strict=False)], pa.float64()),
            pa.array([likeness(p, q) for p, q in zip(own, own[1:], strict=False)], pa.float64()),
            pa.array([g for _, _, g in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in EDITED.split(", ")])

    rows: list[tuple[int, str, int]] = []
    chars, done, group = 0, False, (None, None, None)
    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        for doc, h, packed, kind, near_id in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if done:
                continue
            if kind == NEAR:
                group = (doc, h, near_id)
                continue
            text = unpress.decompress(packed).decode("utf-8", "surrogatepass")
            if rows and (kind == BORROWED or len(rows) >= BATCH_TEXTS or chars > BATCH_CHARS):
                yield out(rows, text)
                rows, chars = [], 0
            done = kind == BORROWED
            rows.append((doc, text, group[2] if group[:2] == (doc, h) else None))
            chars += len(text)


def edit_sensitivity(docs: DataFrame, bands: int = QUERY_BANDS) -> DataFrame:
    """Fingerprints of each text and of its edited form (see :func:`edited`), how alike they are, and each text's group of near ones."""
    bounded_batches(docs.sparkSession)
    prints = materialize(fingerprint_table(keyed(docs), "hash"))
    near = near_groups(prints, bands=bands)
    return descending(docs, near).mapInArrow(_edited_rows, EDITED)


def fingerprint_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fingerprint (binary) and any other columns of type long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array(fingerprints([t or "" for t in b.column(1).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), own, *(b.column(c) for c in more)], ["doc_id", "fingerprint", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long, fingerprint binary", *(f"{c} long" for c in more)]))


def band_keys(fingerprint: Column, bands: int) -> Column:
    width = SLOTS // bands
    return F.array(*(F.xxhash64(F.lit(i), F.substring(fingerprint, 1 + i * width, width)) for i in range(bands)))


def _alike(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def unlinked_pairs(ids: np.ndarray, roots: np.ndarray, prints: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Links of one group that connect what the roots, and links before, do not connect yet."""
    label = np.unique(roots, return_inverse=True)[1]
    out = []
    for p in range(len(ids) - 1):
        other = np.flatnonzero(label[p + 1 :] != label[p]) + p + 1
        if len(other):
            like = (prints[other] == prints[p]).mean(axis=1)
            for q, x in zip(other[like >= least], like[like >= least].tolist(), strict=True):
                if label[q] != label[p]:
                    out.append((int(ids[p]), int(ids[q]), x))
                    label[label == label[q]] = label[p]
    return out


def near_links(classes: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """u, v, likeness: verified links between fingerprints of classes(fid, fingerprint) that share a band.

    A band of up to SMALL_GROUP fingerprints gives all its links. Of a larger one
    every member is compared with the first; where that leaves a band in several
    components, its members are searched in chunks, two at a time, for links that
    join them. So a large group of near copies costs a comparison a member, and no
    link between components of a band is lost.
    """
    banded = classes.select("fid", F.explode(band_keys(F.col("fingerprint"), bands)).alias("key"))
    sizes = materialize(banded.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("fid").alias("head")).where("n_rows > 1"))
    members = materialize(spread_join(banded, sizes.withColumn("n", F.col("n_rows")), "key").where("head is not null"))
    few, many = members.where(F.col("n") <= SMALL_GROUP), members.where(F.col("n") > SMALL_GROUP)
    both = few.select("key", F.col("fid").alias("u")).join(few.select("key", F.col("fid").alias("v")), "key").where("u < v").select("u", "v")
    pairs = materialize(both.unionByName(many.where("fid <> head").select(F.col("head").alias("u"), F.col("fid").alias("v"))).distinct())

    def with_print(rows: DataFrame, key: str, name: str) -> DataFrame:
        counts = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
        return spread_join(rows, counts.join(classes.select(F.col("fid").alias(key), F.col("fingerprint").alias(name)), key), key)

    scored = with_print(with_print(pairs, "u", "a"), "v", "b").select("u", "v", _alike(F.col("a"), F.col("b")).alias("likeness"))
    linked = materialize(scored.where(F.col("likeness") >= least))
    rooted = components(linked.select("u", "v"))
    placed = materialize(many.join(rooted, F.col("fid") == F.col("u"), "left").select("key", "fid", "n", F.coalesce("root", "fid").alias("root")))
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_rows")).where("lo < hi").select("key", "n_rows", F.lit(True).alias("open"))
    left = materialize(spread_join(placed, open_, "key").where("open"))
    if left.isEmpty():
        return linked
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = left.withColumn("i", F.pmod(F.xxhash64("fid"), chunks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = own.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fid", "root")

    def search(group: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(group.column("fingerprint").to_pylist()), np.uint8).reshape(-1, SLOTS)
        found = unlinked_pairs(group.column("fid").to_numpy(), group.column("root").to_numpy(), prints, least)
        return pa.table([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "likeness"])

    search.__annotations__ = {"group": pa.Table, "return": pa.Table}
    more = with_print(dealt, "fid", "fingerprint").groupBy("key", "lo", "hi").applyInArrow(search, "u long, v long, likeness double")
    return linked.unionByName(more).distinct()


def classes_of(prints: DataFrame) -> DataFrame:
    """fid, fingerprint, least (smallest doc_id), n_rows: distinct fingerprints of prints(doc_id, fingerprint), by a 64-bit hash."""
    keyed = prints.withColumn("fid", F.xxhash64("fingerprint"))
    return materialize(keyed.groupBy("fid").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """a, b, likeness: verified links between distinct fingerprints, a before b; see :func:`near_links`."""
    own = prints.select(F.col("doc_id") if "doc_id" in prints.columns else F.lit(None).cast("long").alias("doc_id"), "fingerprint")
    classes = classes_of(own)
    links = near_links(classes, least, bands)
    for key, name in (("u", "x"), ("v", "y")):
        links = links.join(classes.select(F.col("fid").alias(key), F.col("fingerprint").alias(name)), key)
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness").distinct()


def near_groups(prints: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """prints(doc_id, fingerprint, ...) without the fingerprint but with near_id: the smallest doc_id that links lead to.

    Equal fingerprints are of one group; it is null where no row of a group has an id.
    """
    classes = classes_of(prints)
    rooted = components(near_links(classes, least, bands).select("u", "v"))
    member = classes.join(rooted, F.col("fid") == F.col("u"), "left").select("fid", "n_rows", "least", F.coalesce("root", "fid").alias("root"))
    low = member.groupBy("root").agg(F.min("least").alias("near_id"))
    of = materialize(member.join(low, "root").select("fid", "n_rows", "near_id"))
    return spread_join(prints.withColumn("fid", F.xxhash64("fingerprint")).drop("fingerprint"), of, "fid").drop("fid")
