"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of their content. Pass two puts each bucket into a canonical order, shuffles it
with Fisher-Yates under a seed of its own, and writes it. Buckets one after
another are a uniform permutation of all records, whatever order they came in;
shard k of n takes the k-th n-th of it, so shard sizes differ by one row at most
(the law ``rows``).

A bucket that is far too large, as when a third of all records are the same,
is dealt further by row number; its records are all alike, so nothing but memory
depends on how. Buckets number 2**20 at most and go to 4,095 parts at most, so that
the driver's table of offsets stays small: beyond 32 TB of text buckets hold more
than ``BUCKET_BYTES``, and a bucket of more than 128 GB has larger parts. Raise
``bucket_bytes`` with the executors' memory there; the result is as exact.

Defined cases: null and empty texts are records of no text bytes; null ids and
repeated rows are records like others; an empty table gives no shards; columns
of any names pass through, those named like the operator's own are kept under
their names in the written buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize, partitions

SEED = 1009
#: Text bytes that a bucket holds on average, and the factor beyond which it is dealt further.
BUCKET_BYTES = 32 << 20
TOO_LARGE = 4
#: Bytes a record takes besides its text.
OVERHEAD = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + OVERHEAD


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of n positions."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n - 1, 0))
    at = (draws * np.arange(n, 1, -1)).astype(np.int64) if n > 1 else draws
    values = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), at.tolist(), strict=True):
        values[i], values[j] = values[j], values[i]
    return np.array(values, np.int64)


def _shuffled(seed: int, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: shuffle one bucket after another."""
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            bucket, deal = t.column("_bucket")[0].as_py(), t.column("_deal")[0].as_py()
            order = fisher_yates(t.num_rows, (seed, bucket, deal))
            for lo in range(0, t.num_rows, 2000):
                part = t.take(pa.array(order[lo : lo + 2000])).combine_chunks()
                place = pa.array(np.arange(lo, lo + part.num_rows))
                yield from part.append_column("_place", place).to_batches()
            held.clear()

        for b in batches:
            key = b.column("_bucket").to_numpy(zero_copy_only=False).astype(np.int64) * 4096 + b.column("_deal").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    if held and (held[0].column("_bucket")[0] != part.column("_bucket")[0] or held[0].column("_deal")[0] != part.column("_deal")[0]):
                        yield from out()
                    held.append(part)
        if held:
            yield from out()

    return run


def shuffle(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(buckets, offsets): the shuffled buckets as a written table, and the global position each begins at.

    buckets: the columns of docs, packed under ``record``, and _bucket, _deal, _place.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col("text").cast("string")
    content = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    n = min(max(partitions(spark), -(-total // bucket_bytes)), 1 << 20)
    keyed = docs.select(F.struct(*docs.columns).alias("record"), F.pmod(content, F.lit(n)).cast("int").alias("_bucket"), content.alias("_content"))
    sizes = docs.select(F.pmod(content, F.lit(n)).cast("int").alias("_bucket"), size_of(F.col("text")).alias("b")).groupBy("_bucket").agg(F.sum("b").alias("b"))
    # Buckets that are far too large and into how many parts they go: a TOO_LARGE-th of 2**20 rows at most.
    limit = TOO_LARGE * max(bucket_bytes, total // n)
    large = [(r["_bucket"], min(4095, -(-r["b"] // bucket_bytes))) for r in sizes.where(F.col("b") > limit).collect()]
    # Every bucket, and every part of a large one, is a partition of its own.
    extra, at = [], n
    for bucket, parts in large:
        extra.append((bucket, parts, at - 1))  # part 0 stays at its bucket's number, part k goes to at - 1 + k
        at += parts - 1
    parts, base = F.lit(1), F.lit(0)
    if large:
        keyed = keyed.join(F.broadcast(spark.createDataFrame(extra, "_bucket int, _parts int, _base int")), "_bucket", "left")
        parts, base = F.coalesce("_parts", F.lit(1)), F.coalesce("_base", F.lit(0))
    dealt = keyed.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    dealt = dealt.withColumn("_at", F.when(F.col("_deal") == 0, F.col("_bucket")).otherwise(base + F.col("_deal"))).drop("_parts", "_base")
    # doc_id first, then content: equal in both means equal records, up to columns that the permutation may break ties by.
    ordered = dealt.repartitionById(at, F.col("_at")).drop("_at").sortWithinPartitions("_bucket", "_deal", F.asc_nulls_first(F.col("record.doc_id")), "_content")
    schema = ordered.drop("_content").schema.add("_place", "long")
    buckets = materialize(ordered.drop("_content").mapInArrow(_shuffled(seed), schema))
    counts = buckets.groupBy("_bucket", "_deal").agg(F.count("*").alias("n"))
    return buckets, counts


def assign(buckets: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """buckets with shard and slot. The counts are one row a bucket; they and the offsets stay small."""
    spark = buckets.sparkSession
    at, rows = 0, []
    for r in sorted((r["_bucket"], r["_deal"], r["n"]) for r in counts.toLocalIterator()):
        rows.append((r[0], r[1], at))
        at += r[2]
    if not rows:
        return buckets.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    offsets = spark.createDataFrame(rows, "_bucket int, _deal int, _offset long")
    position = F.col("_offset") + F.col("_place")
    whole, odd = divmod(at, shards)
    # The first `odd` shards take one row more.
    head = odd * (whole + 1)
    shard = F.when(position < head, F.floor(position / (whole + 1))).otherwise(odd + F.floor((position - head) / max(whole, 1))).cast("int")
    begin = F.when(F.col("shard") < odd, F.col("shard") * (whole + 1)).otherwise(head + (F.col("shard") - odd) * whole).cast("long")
    return buckets.join(offsets, ["_bucket", "_deal"]).withColumn("shard", shard).withColumn("slot", position - begin).drop("_offset")


def write_shards(docs: DataFrame, shards: int, path: str, seed: int = SEED) -> None:
    """Parquet folders shard=0 ..., rows in slot order within each file."""
    placed = assign(*shuffle(docs, seed), shards)
    out = placed.select("record.*", "shard", "slot") if not {"shard", "slot"} & set(docs.columns) else placed.select("record", "shard", "slot")
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
