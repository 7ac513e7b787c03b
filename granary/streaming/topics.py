"""Topics as a flow: raw records become extracted and failed ones, and of each product the last version is kept.

A raw record has value (JSON text) and version (a number that grows, such as the
place in its topic). Every step writes snapshots whose parts are named by batch:
a batch that is replayed finds its part committed and changes nothing, one that
died before its commit is written anew, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.sources import snapshots

RAW = "value string, version long"
PRODUCT = "product_id string, item_name string, brand string, category string, price double, dietary_tags array<string>, allergen_list array<string>"
LATEST = "product_id string, version long, payload string"


def read_raw(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Raw records of a folder of Parquet files as a stream, at most ``files`` new ones a batch."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw records of a Kafka topic (needs Spark's Kafka package); a version is the record's time in microseconds."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.col("value").cast("string"), F.unix_micros("timestamp").alias("version"))


def write_kafka(rows: DataFrame, servers: str, topic: str, key: str, checkpoint: str) -> StreamingQuery:
    """Rows as JSON to a Kafka topic, keyed (needs Spark's Kafka package). Kafka may see a replayed batch twice: versions tell."""
    out = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract(raw: DataFrame) -> DataFrame:
    """raw with p, the product it holds, and error: null for a sound one. For streams and tables; a null version counts as -1."""
    bad = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    out = raw.withColumn("version", F.coalesce("version", F.lit(-1))).withColumn("p", F.from_json("value", f"{PRODUCT}, _bad string", bad))
    p = F.col("p")
    error = (
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "value: empty")
        .when(p.isNull() | p["_bad"].isNotNull(), "value: not a JSON record")
        .when(F.coalesce(F.trim(p["product_id"]), F.lit("")) == "", "product_id: field required")
        .when(p["price"] < 0, "price: must be at least 0")
    )
    return out.withColumn("error", error).withColumn("p", p.dropFields("_bad"))


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["version", "payload"], kind="stable").drop_duplicates("product_id", keep="last")


def latest(extracted: DataFrame, keep_ms: int = 86_400_000) -> DataFrame:
    """A row whenever a product gets a newer version: product_id, version and payload (JSON); of equal versions the larger payload.

    State holds one version a product until it has been quiet for ``keep_ms``. It only
    spares rows: one that comes later than that may be given again, and :func:`current`
    knows the newest anyway, so late and repeated records never undo a newer one. A task
    sends on one row a product of each Arrow batch, so a product of very many records
    moves few of them.
    """

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _newest(part)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        best = known
        for part in parts:
            version, payload = part["version"].to_numpy(), part["payload"].to_numpy()
            mine = (int(version.max()), max(payload[version == version.max()]))
            best = mine if best is None or mine > tuple(best) else best
        state.setTimeoutDuration(keep_ms)
        if best != known:
            state.update(best)
            yield pd.DataFrame({"product_id": [key[0]], "version": [best[0]], "payload": [best[1]]})

    rows = extracted.where("error is null").select(F.col("p.product_id").alias("product_id"), "version", F.to_json("p").alias("payload"))
    return rows.mapInPandas(combine, LATEST).groupBy("product_id").applyInPandasWithState(update, LATEST, "version long, payload string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _sink(stream: DataFrame, tables, path: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                snapshots.append(batch.sparkSession, path, tables(batch), part=f"batch-{number:012d}")
        finally:
            batch.unpersist()

    # A state with time-outs asks for batches without data for ever, and a run over what is available would not end: time-outs wait for the next data.
    spark, empty = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)


def split(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Raw records into the tables ``extracted`` and ``failed`` of one snapshot: a batch is in both or in neither."""
    sound = lambda b: b.where("error is null").select("version", "p.*")
    return _sink(extract(raw), lambda b: {"extracted": sound(b), "failed": b.where("error is not null").select("version", "value", "error")}, path, checkpoint)


def keep_latest(raw: DataFrame, path: str, checkpoint: str, keep_ms: int = 86_400_000) -> StreamingQuery:
    """New versions of products into the table ``products`` of a snapshot."""
    return _sink(latest(extract(raw), keep_ms), lambda b: {"products": b}, path, checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each product that :func:`keep_latest` has written."""
    rows = snapshots.every(spark, path, "products").groupBy("product_id").agg(F.max(F.struct("version", "payload")).alias("m"))
    return rows.select("m.version", F.from_json("m.payload", PRODUCT).alias("p")).select("version", "p.*")
