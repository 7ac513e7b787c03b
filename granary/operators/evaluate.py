"""Evaluation: field scores, targets, judge summaries, benchmark scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scoring import score_exact, score_list, score_numeric

# How fields are scored and what is expected of them.
EXACT_FIELDS = ["category", "quantity_unit", "brand", "pack_size"]
NUMERIC_FIELDS = ["price", "quantity_value"]
LIST_FIELDS = ["dietary_tags", "allergen_list"]
VISUAL_FIELDS = ["packaging_type", "packaging_color", "has_brand_logo"]
FIELDS = EXACT_FIELDS + NUMERIC_FIELDS + LIST_FIELDS + VISUAL_FIELDS
TEXT_TARGET, VISUAL_TARGET = 0.90, 0.80


def field_score(field: str, pred: Column, truth: Column) -> Column:
    if field in NUMERIC_FIELDS:
        return score_numeric(pred, truth)
    return score_list(pred, truth) if field in LIST_FIELDS else score_exact(pred, truth)


def score_fields(df: DataFrame, fields: Sequence[str] = FIELDS, pred: str = "prediction", truth: str = "ground_truth") -> DataFrame:
    """df with field_scores (a map) and overall_score (their mean)."""
    pairs = [x for f in fields for x in (F.lit(f), field_score(f, F.col(f"{pred}.{f}"), F.col(f"{truth}.{f}")))]
    out = df.withColumn("field_scores", F.create_map(*pairs))
    return out.withColumn("overall_score", F.aggregate(F.map_values("field_scores"), F.lit(0.0), lambda a, s: a + s) / len(fields))


def field_accuracy(scored: DataFrame) -> DataFrame:
    """field, accuracy, target, passed."""
    long = scored.select(F.explode("field_scores").alias("field", "score"))
    target = F.when(F.col("field").isin(VISUAL_FIELDS), VISUAL_TARGET).otherwise(TEXT_TARGET)
    return long.groupBy("field").agg(F.avg("score").alias("accuracy")).withColumn("target", target).withColumn("passed", F.col("accuracy") >= F.col("target"))


def overall(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("overall_score").alias("overall"), F.count("*").alias("examples"))


def judge_score(pred: Column, truth: Column, exact: Column, external: Column) -> Column:
    """5 if both are empty or equal, else the external score, 3 where that can't be read."""
    empty = lambda c: c.isNull() | (F.size(c) == 0)
    return F.when(empty(pred) & empty(truth), 5).when(exact == 1.0, 5).otherwise(F.coalesce(external.try_cast("int"), F.lit(3)))


def judge_summary(long: DataFrame) -> DataFrame:
    """Per field of (example, field, score, differs): mean, shares of 4-5, 3 and 1-2, scores of 5 that differ."""
    pct = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 1)
    s = F.col("score")
    return long.groupBy("field").agg(
        F.round(F.avg(s), 3).alias("avg_score"), pct(s >= 4).alias("pct_4_or_5"), pct(s == 3).alias("pct_3"), pct(s <= 2).alias("pct_1_or_2"),
        F.sum(F.when((s == 5) & F.col("differs"), 1).otherwise(0)).alias("false_negatives"),
    )


def semantic_accuracy(long: DataFrame) -> DataFrame:
    """Share of examples whose fields all score 4 or more."""
    per = long.groupBy("example").agg(F.min("score").alias("low"))
    return per.agg(F.round(F.avg(F.when(F.col("low") >= 4, 1.0).otherwise(0.0)) * 100, 1).alias("overall_semantic_accuracy"))


def check_results(results: DataFrame, check: Callable[[], Column]) -> DataFrame:
    """passed: there are results and the check holds for each."""
    return results.agg((F.count("*") > 0).alias("_some"), F.coalesce(F.min(check().cast("int")), F.lit(0)).alias("_all")).select((F.col("_some") & (F.col("_all") == 1)).alias("passed"))


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Per system and query type of (system, type, passed, latency): passed, total, mean latency."""
    return runs.groupBy("system", "type").agg(F.sum(F.col("passed").cast("int")).alias("passed"), F.count("*").alias("total"), F.round(F.avg("latency"), 2).alias("avg_latency"))


def recent_mean(runs: DataFrame, series: str, order: str, score: str, last: int = 10) -> DataFrame:
    """runs with the mean score of each row and the ``last`` - 1 before it in its series.

    A series is sorted in one task, as a run of evaluations is; it spills but isn't split.
    """
    w = Window.partitionBy(series).orderBy(order).rowsBetween(1 - last, 0)
    return runs.withColumn("recent_mean", F.avg(score).over(w))
