"""Vector index and hybrid search as one plan: filters, joins, cosine, top k."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scoring import confidence_quality
from granary.operators import graph as gr


def embedding_text(name: Column, catalog: Column) -> Column:
    return F.substring(F.concat_ws(". ", name, catalog), 1, 512)


def point_id(sample_id: Column) -> Column:
    """A stable id below 2**53."""
    return F.pmod(F.xxhash64(sample_id), F.lit(1 << 53))


def points(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Payloads beside vectors: records and vectors meet on sample_id; the last record of an id wins."""
    payload = F.struct(
        "item_name", "brand", F.coalesce("category", F.lit("Unknown")).alias("category"), F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("dietary_tags", F.array().cast("array<string>")).alias("dietary_tags"), F.coalesce("allergen_list", F.array().cast("array<string>")).alias("allergens"),
        "quantity_value", "quantity_unit", confidence_quality(F.col("extraction_confidence")).alias("quality_score"), "extraction_confidence",
    )
    last = records.groupBy("sample_id").agg(F.max_by(payload, F.col("pos")).alias("p"))
    return last.join(vectors, "sample_id").select(point_id(F.col("sample_id")).alias("point_id"), F.col("sample_id").alias("product_id"), "p.*", "vector")


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a query vector; null for a null vector, 0 for a zero one."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.when(vector.isNull(), None).when((norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size or 1.0))).otherwise(0.0)


def search(points_: DataFrame, query: Sequence[float], top_k: int = 10, category: str | None = None, max_price: float | None = None, dietary_tags: Sequence[str] = ()) -> DataFrame:
    """The top_k points by cosine among those that meet the filters; score to three places."""
    df = points_
    if category is not None:
        df = df.where(F.col("category") == category)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    for t in dietary_tags:
        df = df.where(F.array_contains("dietary_tags", t))
    df = df.withColumn("_s", cosine(F.col("vector"), query))
    return df.orderBy(F.desc(F.round("_s", 6)), "product_id").limit(top_k).withColumn("score", F.bround(F.round("_s", 6), 3)).drop("_s", "vector")


def semantic_scores(ids: DataFrame, vectors: DataFrame, query: Sequence[float], missing: float = 0.5) -> DataFrame:
    """ids with semantic: one left join for all products; those without a vector get ``missing``."""
    scored = vectors.select(F.col("product_id"), F.round(cosine(F.col("vector"), query), 6).alias("semantic"))
    return ids.join(scored, "product_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(missing)))


def filter_first(g: gr.Graph, vectors: DataFrame, query: Sequence[float], top_k: int = 10, pool: int = 100, **constraints) -> DataFrame:
    """Constraints choose a pool (best quality first), vectors and quality rank it: 0.6 and 0.4."""
    chosen = gr.get_products(g, pool, **constraints)
    scored = semantic_scores(chosen, vectors, query)
    s = F.lit(0.6) * F.col("semantic") + F.lit(0.4) * F.coalesce("quality_score", F.lit(50)) / 100.0
    return scored.withColumn("score", F.bround(s, 3)).orderBy(F.desc("score"), "product_id").limit(top_k)


def semantic_first(g: gr.Graph, vectors: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """The nearest vectors, joined with their products (those without one drop): 0.7 and 0.3; a quality of 0 counts as 50."""
    near = vectors.select("product_id", F.round(cosine(F.col("vector"), query), 6).alias("semantic")).orderBy(F.desc("semantic"), "product_id").limit(top_k)
    q = F.coalesce(F.when(F.col("quality_score") != 0, F.col("quality_score")), F.lit(50))
    out = gr.lookup(g, near).join(near, "product_id")
    s = F.lit(0.7) * F.col("semantic") + F.lit(0.3) * q / 100.0
    return out.withColumn("score", F.bround(s, 3)).orderBy(F.desc("score"), "product_id").limit(top_k)


def hybrid(g: gr.Graph, vectors: DataFrame, query: Sequence[float], top_k: int = 10, **constraints) -> DataFrame:
    """Filter first if any constraint says something, else semantic first; 0 and empty lists say nothing."""
    live = {k: v for k, v in constraints.items() if v}
    return filter_first(g, vectors, query, top_k, **live) if live else semantic_first(g, vectors, query, top_k)


def embed(df: DataFrame, text: str, encode: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 32, name: str = "vector") -> DataFrame:
    """df with vectors of its texts from an encoder that takes lists of texts; a null text has no vector."""

    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None]
        for lo in range(0, len(at), batch):
            part = at[lo : lo + batch]
            for i, v in zip(part, encode([texts.iloc[i] for i in part]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(run, "array<float>")(text))
