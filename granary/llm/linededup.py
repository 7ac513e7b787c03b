"""Exact line de-duplication that moves hashes, not text.

Every line's key is hashed to 128 bits. A task keeps the smallest document of
each key it sees and drops the key's other lines at once, so a line that half
the corpus shares leaves a task as one candidate. Candidates are partitioned
by hash range (equal widths: hashes are uniform), sorted by document, and the
first document of each run keeps its lines. What comes back is a compressed
keep bitmap per document; text meets it only when the bitmap is applied.

Defined cases: a null or empty text is one empty line; a null doc_id counts as
the smallest; rows with the same doc_id are one document (each text gets its
own bitmap); empty tables give no rows; further columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize, partitions

BLANK = " \t\n\v\f\r"
MIN_KEY = 10
#: Of a bitmap's columns beside those of documents, which may have any names.
PREFIX = "__line_dedup_"
#: Keys that a task holds before it hands them on.
HELD_KEYS = 150_000

FOUND = "h1 long, h2 long, doc_id long, text_hash long, lines array<int>"


def _found(min_key: int):
    """Candidates (h1 set) and lines that are dropped for sure (h1 null)."""

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        for lo in range(0, len(rows), 20_000):
            cols = zip(*rows[lo : lo + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h1", "h2", "doc_id", "text_hash", "lines"])

    def candidates(held: dict) -> Iterator[pa.RecordBatch]:
        rows = []
        for digest, (_, entries) in held.items():
            h1, h2 = (int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8))
            rows += [(h1, h2, *e) for e in entries]
        held.clear()
        yield from out(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[tuple, list[tuple]]] = {}
        for b in batches:
            dropped: list[tuple] = []
            for doc, text, th in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_key:
                        own.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()), []).append(i)
                order, more = (doc is not None, doc), []
                for digest, lines in own.items():
                    if (had := held.get(digest)) is None or order < had[0]:
                        if had:
                            more += [(d, t, x) for d, t, x in had[1]]
                        held[digest] = (order, [(doc, th, lines)])
                    elif order == had[0]:
                        if (doc, th, lines) not in had[1]:
                            had[1].append((doc, th, lines))
                    else:
                        more.append((doc, th, lines))
                by: dict[tuple, list[int]] = {}
                for d, t, x in more:
                    by.setdefault((d, t), []).extend(x)
                dropped += [(None, None, d, t, sorted(x)) for (d, t), x in by.items()]
            yield from out(dropped)
            if len(held) > HELD_KEYS:
                yield from candidates(held)
        yield from candidates(held)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by hash and document: those of all documents but the first."""
    last = first = None
    for b in batches:
        h1, h2 = b.column("h1").to_numpy(zero_copy_only=False), b.column("h2").to_numpy(zero_copy_only=False)
        docs, keep = b.column("doc_id").to_pylist(), np.zeros(b.num_rows, bool)
        same = np.zeros(b.num_rows, bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        for i in range(b.num_rows):
            if not same[i] and (i or last != (h1[i], h2[i])):
                first = docs[i]
            keep[i] = docs[i] != first
        if b.num_rows:
            last = (h1[-1], h2[-1])
        yield b.filter(pa.array(keep)).select(["doc_id", "text_hash", "lines"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, found in zip(b.column("n_lines").to_pylist(), b.column("found").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for lines in found:
                keep[lines] = False
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        cols = [b.column("doc_id"), b.column("text_hash"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def kept_lines(keep: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as booleans, one per line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: one row per document and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
    rows = docs.select(doc_id, text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = materialize(rows.mapInArrow(_found(min_key), FOUND))
    n = partitions(spark)
    at = F.floor((F.shiftright("h1", 32) + (1 << 31)) * F.lit(float(n)) / F.lit(float(1 << 32))).cast("int")
    ranged = found.where("h1 is not null").repartitionById(n, at).sortWithinPartitions("h1", "h2", F.asc_nulls_first("doc_id"))
    later = ranged.mapInArrow(_later, "doc_id long, text_hash long, lines array<int>")
    sizes = docs.select(doc_id, F.xxhash64(text).alias("text_hash"), F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    none = F.lit(None)
    dropped = found.where("h1 is null").select("doc_id", "text_hash", "lines").unionByName(later).withColumn("n_lines", none.cast("long"))
    both = sizes.withColumn("lines", none.cast("array<int>")).unionByName(dropped)
    per_doc = both.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("lines").alias("found"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def _kept(text: pd.Series, keep: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(t: str | None, m: bytes, n: int) -> str | None:
        return None if t is None else "\n".join(line for line, k in zip(t.split("\n"), kept_lines(m, n), strict=True) if k)

    return pd.Series([one(*x) for x in zip(text, keep, n_lines, strict=True)], dtype=object)


def kept_text() -> Column:
    """The lines that stay, joined; for rows of :func:`with_bitmaps`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    touched = F.when(F.col(f"{PREFIX}n_dropped") > 0, text)
    return F.coalesce(F.pandas_udf(_kept, "string")(touched, F.col(f"{PREFIX}keep"), F.col(f"{PREFIX}n_lines")), text)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs beside their bitmaps, whose columns get PREFIX."""
    b = bitmaps.select(*(F.col(c).alias(PREFIX + c) for c in bitmaps.columns))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{PREFIX}doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col(f"{PREFIX}text_hash"))
    return docs.join(b, same)


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the dropped lines gone from text; n_chars, where there is one, follows."""
    out = with_bitmaps(docs, bitmaps).withColumn("text", kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
