"""Profiles of tables: counts, nulls, distributions, histograms, coverage, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import keyword_hits


def value_counts(df: DataFrame, column: Column, n: int | None = None, keep_null: bool = False) -> DataFrame:
    """value, n: most frequent first."""
    v = df.select(column.alias("value"))
    out = (v if keep_null else v.where("value is not null")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if n is None else out.limit(n)


def list_counts(df: DataFrame, column: Column, n: int | None = None) -> DataFrame:
    return value_counts(df.select(F.explode(column).alias("v")), F.col("v"), n)


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))


def describe(df: DataFrame, column: Column) -> DataFrame:
    """n, min, max, mean, median (exact) and sample standard deviation.

    The median comes from the counts of distinct values: their running total says
    which one or two lie in the middle, so no task holds all of them.
    """
    v = df.select(column.cast("double").alias("v"))
    row = v.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return row.crossJoin(median(v, "v")).select("n", "min", "max", "mean", "median", "std")


def median(df: DataFrame, column: str, parts: int = 4096) -> DataFrame:
    """median: one row, null if there are no values; values are counted in ``parts`` ranges first."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    edges = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))).otherwise(0)
    ranged = v.crossJoin(edges).withColumn("_part", at)
    own = Window.partitionBy("_part").orderBy("_v")
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.sum("_n").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(every), F.lit(0)))  # at most ``parts`` rows
    placed = ranged.join(before.select("_part", "_before"), "_part").withColumn("_end", F.col("_before") + F.sum("_n").over(own))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda k: (F.col("_end") - F.col("_n") < k) & (k <= F.col("_end"))
    return placed.agg(((F.min(F.when(holds(low), F.col("_v"))) + F.min(F.when(holds(high), F.col("_v")))) / 2).alias("median"))


def shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """name, n, share of rows that meet each condition: one pass."""
    row = df.agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(f"_{k}") for k, c in conditions.items()), F.count("*").alias("_total"))
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"_{k}").alias("n"), (F.col(f"_{k}") / F.col("_total")).alias("share")) for k in conditions))
    return row.select(F.explode(each).alias("r")).select("r.*")


def distinct_count(df: DataFrame, column: Column) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def histogram(df: DataFrame, column: Column, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, low, n: equal widths from low to high (the column's own range unless given; values beyond are clipped in)."""
    v = df.select(column.cast("double").alias("v")).where("v is not null")
    edges = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))  # one row
    lo = F.lit(float(low)) if low is not None else F.col("a")
    hi = F.lit(float(high)) if high is not None else F.col("b")
    width = (hi - lo) / bins
    at = F.when(width > 0, F.least(F.greatest(F.floor((F.least(F.greatest(F.col("v"), lo), hi) - lo) / width), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    return v.crossJoin(F.broadcast(edges)).select(at.cast("int").alias("bin"), (lo + at * width).alias("low")).groupBy("bin", "low").agg(F.count("*").alias("n")).orderBy("bin")


def score_buckets(df: DataFrame, score: Column, width: int) -> DataFrame:
    """bucket (its lower end), n of scores in steps of a width."""
    return df.groupBy((F.floor(score / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def draw(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    from granary.operators.datasets import draw_key

    return df.orderBy(draw_key(F.col(key), seed), key).limit(n)


def draw_union(parts: Sequence[DataFrame], df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of df drawn from each of the parts, n from each, each row once."""
    ids = None
    for p in parts:
        own = draw(p.select(key), key, n, seed)
        ids = own if ids is None else ids.union(own)
    return df.join(ids, key, "left_semi")


def keyword_coverage(df: DataFrame, text: Column, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """category, n: rows that contain any of a category's keywords, in one pass over a text for all of them."""
    hits = df.select(keyword_hits(text, keywords).alias("hits"))
    return shares(hits, {k: F.array_contains("hits", F.lit(i)) for i, k in enumerate(keywords)}).select(F.col("name").alias("category"), "n")


def aspect(width: Column, height: Column) -> Column:
    """ratio (0 for a height of 0), shortest and longest side."""
    return F.struct(F.when(height > 0, width / height).otherwise(0.0).alias("ratio"), F.least(width, height).alias("shortest"), F.greatest(width, height).alias("longest"))


def route(text_poor: Column, image_poor: Column) -> Column:
    """Who reads a row: multimodal, text_only (the image is poor) or human_review (both are)."""
    return F.when(text_poor & image_poor, "human_review").when(image_poor, "text_only").otherwise("multimodal")
