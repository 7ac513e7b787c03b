import pytest

CLASHING = "score double, label string, predicted int, shard int, slot long, record string, _bucket int, n_lines long, keep string, component_id string, _id long, _keep string, key string, piece string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "\n".join(f"line number {i % 700} of a very long text with words {i}" for i in range(6000))
    shared = "This line occurs in several documents."
    rows = [
        (1, f"{shared}\nonly here one"), (2, f"{shared} \nonly here two"), (3, None), (4, ""), (5, "\n\n \t"), (6, long), (6, long),
        (7, "same id, first text here"), (7, "same id, second text here"), (None, f"{shared}\nno id"), (None, None), (8, "x"), (9, "x"), (10, "ÉTÉ « déjà » vu 漢字 \U0001f600"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    extra = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in CLASHING.split(", ")}
    return df.withColumns(extra | {"n_chars": F.length("text").cast("long"), "lang": F.lit("en"), "source": F.lit(None).cast("string")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
