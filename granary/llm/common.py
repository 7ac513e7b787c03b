"""Shared plumbing of the operators: bounded batches and joins, partition counts, the held-out fold."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import discard, materialize, scratch, shared_dir

__all__ = ["bounded_batches", "discard", "featured", "held_out", "labelled", "lower_ascii", "materialize", "packed", "partitions", "perhaps_in", "scratch", "shared_dir", "spread_join", "summed", "unpacked", "utf8"]

#: A key with more than 1/HEAVY_SHARE of all rows is heavy, so at most this many keys are.
HEAVY_SHARE = 500
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of sums that the driver adds up itself.
SUMS_BYTES = 24 << 20
#: Bits of a block of a bitmap (of Spark's bitmap functions), and blocks of one at most: 8 MB.
BLOCK_BITS, MOST_BLOCKS = 1 << 15, 2048


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for a Python worker: by rows, and by bytes where texts are long.

    Spark reads these settings when a plan runs, so they cannot be put back here;
    they are only ever lowered, which changes no result.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(c: Column) -> Column:
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def held_out(doc_id: Column) -> Column:
    """The fold that never trains: crc32(doc_id as text) mod 5 = 0 (null ids too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, pick=F.min) -> DataFrame:
    """key, label, text: at most max_rows labelled rows of docs outside the held-out fold, drawn by hash of the id.

    Label rows without a label are left out; of repeated labels of an id the one
    that ``pick`` takes counts, of repeated rows of an id the smallest text. Only
    ids of docs are drawn, so docs that hold few labelled ids give all of them.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("_id")))
    present = docs.select(F.col("doc_id").cast("long").alias("_id"))
    # The ids are drawn first: the order by hash needs no text, and max_rows bounds the broadcast.
    drawn = own.join(present, "_id", "left_semi").groupBy("_id").agg(pick("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.first("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select(F.xxhash64("_id").alias("key"), "label", "text")


def featured(docs: DataFrame, labels: DataFrame, label: str, make: Callable[[str], bytes], part_bytes: int, pick=F.min) -> DataFrame:
    """part, key, label, made: what ``make`` says of the text of every labelled row of docs outside the held-out fold.

    Label rows count as in :func:`labelled`; of repeated rows of an id the text with
    the smallest hash does. A part holds rows of about ``part_bytes`` of text (a row
    counts as 1,000 bytes at least), drawn by id, in the order of their keys, which are hashes. Texts are made small before
    they are shuffled, as neither side has a size bound; most of those without a label are
    left out before (:func:`perhaps_in`), all of them by the join.
    """
    long = F.col("doc_id").cast("long").alias("_id")
    trains = F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    texts = docs.select(long, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(trains)
    size = texts.agg(F.sum(F.greatest(F.octet_length("text"), F.lit(1000)).cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([make(t.as_py()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_hash"), made], ["_id", "_hash", "made"])

    own = labels.select(long, F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & trains)
    made = perhaps_in(texts, own, "_id").select("_id", F.xxhash64("text").alias("_hash"), "text").mapInArrow(run, "_id long, _hash long, made binary")
    first = made.repartition(parts, "_id").groupBy("_id").agg(F.min(F.struct("_hash", "made"))["made"].alias("made"))
    rows = first.join(own.repartition(parts, "_id").groupBy("_id").agg(pick("label").alias("label")), "_id")
    return rows.select(F.xxhash64("_id").alias("key"), "label", "made").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), "key", "label", "made")


def perhaps_in(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in other, and some whose key does not: for a join that follows and would move all.

    The hashes of other's keys are marked in a bitmap of some ten bits a key, of which
    one in ten or so of the other rows hits a mark. It has 8 MB at most, so beyond about 6,700,000
    keys more of them do, and the join still decides.
    """
    blocks = min(MOST_BLOCKS, 1 + 10 * other.count() // BLOCK_BITS)
    at = F.pmod(F.xxhash64(key), F.lit(blocks * BLOCK_BITS))
    marks = other.select(F.bitmap_bucket_number(at).alias("_block"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    found = rows.withColumns({"_block": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}).join(F.broadcast(marks), "_block")
    byte = F.conv(F.hex(F.substring("_marks", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(rows.columns)


def packed(x: np.ndarray) -> bytes:
    """An array without loss where it holds whole numbers below 2**32, in the least bytes that hold them, and else in single precision; compressed."""
    x = np.ravel(x)
    whole = not len(x) or (x.min() >= 0 and x.max() < 1 << 32 and not (x % 1).any())
    kind = np.min_scalar_type(int(x.max(initial=0))).str if whole else "<f4"
    return kind.ljust(4).encode() + zlib.compress(x.astype(kind).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[4:]), b[:4].decode().strip()).astype(float)


def summed(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int = 1 << 20) -> np.ndarray | None:
    """The sum of the arrays, of ``width`` numbers at most, that ``run`` makes of a task's batches; flat. None if it makes none.

    Sums travel as :func:`packed` has them. They meet in as many groups as the root of
    their number, until at most SUMS_BYTES are left for the driver, in one order always.
    A group is one sum whatever number of partitions Spark deals groups to.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for x in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed(x)], pa.binary())], ["at", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g.as_py(), x.as_py()) for b in batches for g, x in zip(b.column("group"), b.column("sum"), strict=True))
        for g, own in groupby(rows, key=lambda r: r[0]):
            total: np.ndarray | float = 0.0
            for _, x in own:
                total = total + unpacked(x)
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([packed(total)], pa.binary())], ["at", "sum"])

    schema = "at long, sum binary"
    sums, tasks = table.mapInArrow(each, schema), table.rdd.getNumPartitions()
    while tasks > max(2, SUMS_BYTES // (4 * width)):
        tasks = int(tasks**0.5)
        sums = sums.withColumn("group", F.pmod("at", F.lit(tasks))).repartition(tasks, "group").sortWithinPartitions("group", "at").mapInArrow(add, schema)
    total = None
    for r in sorted(sums.collect(), key=lambda r: r["at"]):
        x = unpacked(r["sum"])
        total = x if total is None else total + x
    return total


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join on a key that may be very uneven on the left and is unique on the right.

    ``right`` must hold ``key`` and ``n_rows``, the number of left rows with it.
    Keys with more than 1/HEAVY_SHARE of all rows number HEAVY_SHARE at most,
    whatever the data: these few right rows are replicated ``salts`` times and
    their left rows salted, so that no task gets all rows of one key. A null
    key matches nothing.
    """
    total = right.agg(F.sum("n_rows")).first()[0] or 0
    heavy = [r[0] for r in right.where(F.col("n_rows") > max(1000, total // HEAVY_SHARE)).select(key).take(HEAVY_SHARE)]
    if not heavy:
        return left.join(right.drop("n_rows"), key, "left")
    is_heavy = F.col(key).isin(heavy)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    a = left.withColumn("_salt", F.when(is_heavy, salt).otherwise(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.drop("n_rows").withColumn("_salt", F.explode(F.when(is_heavy, every).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], "left").drop("_salt")
