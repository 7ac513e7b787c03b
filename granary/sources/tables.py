"""Tables in the folder that the driver and all executors share: where lineage ends.

A table that :func:`materialize` makes belongs to the innermost :func:`scratch`
block of its own thread, which deletes it at its end; outside of any block it stays
until :func:`clear` or the end of the process. Concurrent queries do not meet: a
block never owns what another thread writes.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paths that belong to no block.
_owned: list[str] = []
#: Paths of the innermost open scratch block of this thread (or task of an event loop); other threads do not see it.
_block: ContextVar[list[str] | None] = ContextVar("granary_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors share.

    It lies under ``spark.checkpoint.dir``. Only where that is unset and all of
    Spark runs in this process, as in local tests, a temporary folder of this
    machine is taken and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_granary_dir", None)
        if not base:
            held = tempfile.TemporaryDirectory(prefix="granary-")
            atexit.register(held.cleanup)
            base = spark._granary_dir = f"file://{held.name}"
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """A fresh shared folder that is deleted like the tables of :func:`materialize`."""
    path = shared_dir(spark)
    block = _block.get()
    (_owned if block is None else block).append(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    Lost executors then cost a re-read, not a recomputation. A table at a path
    that the caller names is the caller's to discard.
    """
    spark = df.sparkSession
    path = path or folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def cores(spark: SparkSession) -> int:
    """Into how many parts to deal rows: a part for each core, and as many as a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over all cores: for tables that are small as files, and so are read by a task or two, but whose rows take long."""
    return df.repartition(cores(df.sparkSession), key)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows' numbers, from 1, by a column: sorted in ranges, of which only the counts meet in one task."""
    rows = materialize(df)  # the ranges are found by a sample, which would compute df once more
    placed = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(before), "_range").withColumn(name, number).drop("_at", "_range", "_before")


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        where = t if isinstance(t, str) else getattr(t, "_granary_path", None)
        if where:
            p = jvm.org.apache.hadoop.fs.Path(where)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at the end of the block; write what outlives it to a path of its own."""
    own: list[str] = []
    token = _block.set(own)
    try:
        yield
    finally:
        _block.reset(token)
        discard(spark, *own)


def clear(spark: SparkSession) -> None:
    """Delete the process's own tables: for use between queries whose results have been consumed."""
    discard(spark, *_owned)
    _owned.clear()


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with suppress(Exception):  # the session may have ended by then
            clear(spark)
