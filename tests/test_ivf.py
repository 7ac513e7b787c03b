"""The vector index: exact answers, recall of few probes, filters, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ivf
from granary.operators import vector as vc


@pytest.fixture(scope="module")
def table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    price = F.pmod(F.xxhash64("vec_id"), F.lit(100)).cast("double")
    return e.select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"), price.alias("price")).persist()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf"))
    ivf.build(table, path, cells=16, sort_by=["category", "price"])
    return path


def ids(df):
    return [r.product_id for r in df.collect()]


def test_every_vector_is_in_one_cell(spark, table, index):
    stored = spark.read.parquet(f"{index}/vectors")
    assert stored.count() == table.count() == stored.select("product_id").distinct().count()
    assert spark.read.parquet(f"{index}/cells").agg(F.sum("n")).first()[0] == table.count()


def recall(spark, table, index, probes):
    """Shares of the ten nearest of a search over all vectors that few probes find, without and with a filter."""
    queries = [r.vector for r in table.where("product_id % 200 = 0").orderBy("product_id").collect()]
    return [sum(len(set(ids(ivf.search(spark, index, q, 10, probes, **more))) & set(ids(vc.search(table, q, 10, **more)))) for q in queries) / len(queries) / 10 for more in ({}, {"max_price": 60.0})]


def test_vectors_on_all_sides(spark, table, index):
    """The given vectors have no clusters: 13 of 16 cells are needed, and exact searches are the answer."""
    assert min(recall(spark, table, index, 13)) >= 0.95
    for r in table.where("product_id in (1, 2)").collect():
        for more in ({}, {"category": "3", "max_price": 50.0}):
            a = ivf.search(spark, index, r.vector, 10, probes=1, exact=True, **more).select("product_id", "score").collect()
            assert a == vc.search(table, r.vector, 10, **more).select("product_id", "score").collect()


def test_vectors_in_clusters_are_found_in_few_files(spark, table, tmp_path):
    """The same vectors, those of a label moved together: 3 of 16 cells hold the nearest, and bounds leave the others unread."""
    label = F.col("category").cast("int")
    moved = table.withColumn("vector", F.transform("vector", lambda x, i: x + F.when(i == label, 4.0 * F.sqrt(F.lit(64.0))).otherwise(0.0)))
    path = str(tmp_path)
    ivf.build(moved, path, cells=16, sort_by=["price"])
    assert min(recall(spark, moved, path, 3)) >= 0.95
    q = moved.where("product_id = 1").first().vector
    near = ivf.search(spark, path, q, 10, probes=3)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().toString()
    files = spark.read.parquet(f"{path}/vectors").select("cell", F.col("_metadata.file_path").alias("f")).distinct()
    read = files.where(F.col("cell").isin([c for c, _, _ in ivf.bounds(spark, path, q)[:3]])).count()
    assert read <= 0.4 * files.count()
    last = near.agg(F.min("score")).first()[0]
    assert sum(b >= last - 0.0006 for _, _, b in ivf.bounds(spark, path, q)) <= 8
    assert ids(ivf.search(spark, path, q, 10, probes=1, exact=True)) == ids(vc.search(moved, q, 10))


def test_bounds_hold(spark, table, index):
    q = [((5 * i) % 11 - 5) / 7 for i in range(64)]
    best = spark.read.parquet(f"{index}/vectors").groupBy("cell").agg(F.max(vc.cosine(F.col("vector"), q)).alias("m")).collect()
    most = {c: b for c, _, b in ivf.bounds(spark, index, q)}
    assert all(r.m <= most[r.cell] + 1e-9 for r in best)


def test_vectors_without_direction(spark, tmp_path):
    """Null, zero, empty and tied vectors; a query of zeros; more cells than vectors; an empty table."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "product_id long, vector array<double>").withColumn("extra", F.lit("x"))
    ivf.build(df, f"{tmp_path}/a", cells=8)
    for q in ([1.0, 0.1], [-1.0, 0.0], [0.0, 0.0]):
        assert ids(ivf.search(spark, f"{tmp_path}/a", q, 6, probes=1, exact=True)) == ids(vc.search(df, q, 6))
        assert ids(ivf.search(spark, f"{tmp_path}/a", q, 2, probes=1, exact=True)) == ids(vc.search(df, q, 2))
    ivf.build(df.where("false"), f"{tmp_path}/b", cells=2)
    assert ids(ivf.search(spark, f"{tmp_path}/b", [1.0, 0.0], 3, exact=True)) == []
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0])], "product_id long, vector array<double>")
    ivf.build(odd, f"{tmp_path}/c", cells=2)
    assert ids(ivf.search(spark, f"{tmp_path}/c", [1.0, 0.0], 1, probes=1, exact=True)) == ids(vc.search(odd, [1.0, 0.0], 1))
    with pytest.raises(ValueError, match="cells"):
        ivf.fit(df, 0)


def test_the_sample_does_not_depend_on_layout(spark, table):
    assert np.allclose(ivf.fit(table.repartition(3), 4), ivf.fit(table.repartition(7), 4), atol=1e-6)
