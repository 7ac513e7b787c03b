"""An inverted-file index of vectors: each in the cell of its nearest centroid, cells as files, searches that read few of them.

Centroids are fitted on a bounded sample; every vector is indexed. Vectors that are
null, zero or not finite have no direction and lie in cell -1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from granary.operators import vector as vc

#: Vectors that centroids are fitted on, and cells, at most. Cells are read to the driver: 4,096 of 1,024 numbers are 32 MB.
MAX_SAMPLE, MAX_CELLS = 20_000, 4_096
NONE = -1


def _rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows of a matrix, and the places in the series that they are of; the rest has no direction."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    m = np.array([[np.nan if x is None else x for x in vectors.iloc[i]] for i in at], dtype="float64").reshape(len(at), -1 if at else 0)
    with np.errstate(invalid="ignore"):
        size = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return m[good] / size[good, None], np.array(at, dtype="int64")[good]


def fit(points: DataFrame, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centroids by k-means over the MAX_SAMPLE vectors with the smallest hashes, the same for any layout of the table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"1 to {MAX_CELLS} cells")
    doubles = F.col("vector").cast("array<double>")
    size = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x)
    sound = points.select(doubles.alias("vector")).where((size > 0) & (size < float("inf")))
    sample = sound.orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(MAX_SAMPLE).select(array_to_vector("vector").alias("features"))
    sample = sample.persist()
    try:
        if sample.isEmpty():
            return np.zeros((0, 0))
        centres = np.array(KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample).clusterCenters())
    finally:
        sample.unpersist()
    return centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True))


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points with cell, the nearest centroid, and near, the cosine to it."""

    def run(vectors: pd.Series) -> pd.DataFrame:
        cell, near = np.full(len(vectors), NONE), np.full(len(vectors), np.nan)
        unit, at = _rows(vectors)
        if len(at) and len(centroids):
            scores = unit @ centroids.T
            cell[at] = scores.argmax(axis=1)
            near[at] = scores.max(axis=1)
        return pd.DataFrame({"cell": cell, "near": near})

    run.__annotations__ = {"vectors": pd.Series, "return": pd.DataFrame}
    placed = F.pandas_udf(run, "cell int, near double")("vector")
    return points.withColumn("_p", placed).withColumns({"cell": F.col("_p.cell"), "near": F.col("_p.near")}).drop("_p")


def build(points: DataFrame, path: str, cells: int = 256, sort_by: Sequence[str] = (), seed: int = 42) -> None:
    """Write the index of points (product_id, vector, payload columns) under path.

    Ranges of cell and a hash make the files, so a cell of very many vectors is several.
    ``sort_by`` names payload columns by whose statistics filters skip parts of files.
    """
    spark = points.sparkSession
    centroids = fit(points, cells, seed)
    placed = assign(points, centroids).withColumn("_h", F.xxhash64("product_id"))
    placed = placed.repartitionByRange("cell", "_h").sortWithinPartitions("cell", *sort_by).drop("_h")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/vectors")
    points.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # an empty table has no cell to tell them
    odd = ~F.coalesce(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < float("inf"), F.lit(False)) & F.col("vector").isNotNull()
    stored = spark.read.schema(f"cell int, near double, vector {points.schema['vector'].dataType.simpleString()}").parquet(f"{path}/vectors")
    stats = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max(F.when(F.col("cell") == NONE, odd).otherwise(False)).alias("odd"))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    stats.join(F.broadcast(centres), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def bounds(spark: SparkSession, path: str, query: Sequence[float]) -> list[tuple[int, float, float]]:
    """cell, cosine of the query with its centroid, and the most that a member's cosine can be; nearest cells first.

    By the triangle inequality of angles. What has no direction scores 0 or null, or anything if it is not finite.
    """
    q = np.array(query, dtype="float64")
    size = np.sqrt(q @ q)
    out = []
    for r in spark.read.parquet(f"{path}/cells").collect():
        if r.centroid is None or size == 0:
            out.append((r.cell, -2.0, math.inf if r.odd or size == 0 else 0.0))
            continue
        s = float(np.clip(np.array(r.centroid) @ q / size, -1.0, 1.0))
        apart = math.acos(s) - math.acos(min(1.0, max(-1.0, r.least)))
        out.append((r.cell, s, math.cos(max(0.0, apart))))
    return sorted(out, key=lambda b: (-b[1], b[0]))


def search(spark: SparkSession, path: str, query: Sequence[float], top_k: int = 10, probes: int = 8, exact: bool = False, **filters) -> DataFrame:
    """The top_k points by cosine among those that meet the filters of :func:`granary.operators.vector.search`.

    Reads the ``probes`` nearest cells. ``exact`` then adds every cell whose bound
    reaches the last score found (all of them while fewer than top_k points are found),
    so the answer is that of a search over all vectors.
    """
    columns = spark.read.parquet(f"{path}/columns").schema
    stored = spark.read.schema(StructType([*columns, StructField("near", DoubleType()), StructField("cell", IntegerType())])).parquet(f"{path}/vectors")
    order = bounds(spark, path, query)

    def over(cells: list[int]) -> DataFrame:
        return vc.search(stored.where(F.col("cell").isin(cells)), query, top_k, **filters).drop("cell", "near")

    chosen = [c for c, _, _ in order[:probes]]
    if not exact:
        return over(chosen)
    found = over(chosen).select("score").collect()
    scores = [r.score for r in found if r.score is not None]
    # Scores have three places: what is within half of the last one, and rounding, may still be before it.
    least = min(scores) - 0.0006 if len(scores) == top_k else -math.inf
    return over(sorted({*chosen, *(c for c, _, most in order if most >= least)}))
