"""Tables that grow by upserts: immutable parts, and a list of parts for each commit.

A commit is one file, ``commits/<number>``, that names the parts of the snapshot in
order; readers take the one with the highest number. It is moved to its name in
one step that fails if the name is taken, so a writer that dies at any moment
leaves the snapshot before it, and of two writers that meet the second appends to
what the first committed. A part is a folder of Parquet tables that nothing
changes after its commit; one that no commit names is waste for :func:`vacuum`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the number."""


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last commit (0 if there is none) and the parts that it names."""
    numbers = [n for n in _names(spark, f"{path}/commits") if n.isdigit()]
    if not numbers:
        return 0, []
    p, fs = _path(spark, f"{path}/commits/{numbers[-1]}")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return int(numbers[-1]), text.split()


def commit(spark: SparkSession, path: str, number: int, parts: list[str]) -> None:
    """Make a list of parts the snapshot of a number, or raise :class:`Conflict` if the number is taken."""
    from py4j.protocol import Py4JJavaError

    aside, fs = _path(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    to, _ = _path(spark, f"{path}/commits/{number:012d}")
    aside, to = fs.makeQualified(aside), fs.makeQualified(to)
    stream = fs.create(aside, False)
    stream.write("\n".join(parts).encode())
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(aside, to, never)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{path}: {number} is committed") from e
        raise


def append(spark: SparkSession, path: str, tables: dict[str, DataFrame], part: str | None = None) -> None:
    """Write the tables as one part and commit it after those that are there, whoever else commits meanwhile.

    A part that the caller names counts once: if the snapshot has it nothing is
    written, and what a writer of that name left without a commit is overwritten.
    """
    if part is not None and part in current(spark, path)[1]:
        return
    name_of = part or uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("overwrite" if part else "error").option("compression", "zstd").parquet(f"{path}/parts/{name_of}/{name}")
    while True:
        number, parts = current(spark, path)
        if part in parts:
            return
        try:
            return commit(spark, path, number + 1, [*parts, name_of])
        except Conflict:
            continue


def versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a table in all parts of the snapshot, with ``_version``, the place of their part."""
    _, parts = current(spark, path)
    if not parts:
        raise FileNotFoundError(f"{path} holds no snapshot")
    read = [spark.read.parquet(f"{path}/parts/{p}/{name}").withColumn("_version", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def every(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The distinct rows of all parts."""
    return versions(spark, path, name).drop("_version").distinct()


def last_of(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    """Of each key the rows of the last part that has it; rows without a key are one key."""
    rows = versions(spark, path, name)
    if len(current(spark, path)[1]) == 1:
        return rows.drop("_version")
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_version").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_version") == F.col("_last")), "left_semi").drop("_version")


def compact(spark: SparkSession, path: str, tables: dict[str, str | None]) -> None:
    """Commit one part in place of all: of tables with a key the last rows of each, of others the distinct rows.

    Raises :class:`Conflict`, and changes nothing, if another writer commits meanwhile.
    """
    number, parts = current(spark, path)
    if len(parts) < 2:
        return
    part = uuid.uuid4().hex
    for name, key in tables.items():
        df = every(spark, path, name) if key is None else last_of(spark, path, name, key)
        df.write.option("compression", "zstd").parquet(f"{path}/parts/{part}/{name}")
    commit(spark, path, number + 1, [part])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete parts that the last commit does not name: for times when nobody writes or reads an older one."""
    _, parts = current(spark, path)
    waste = [p for p in _names(spark, f"{path}/parts") if p not in parts]
    for p in waste:
        at, fs = _path(spark, f"{path}/parts/{p}")
        fs.delete(at, True)
    return waste
