"""Active learning: which uncertain rows a person should look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scoring import disagreement, mean_entropy
from granary.functions.text import item_name

WEIGHTS = {"entropy": 0.5, "disagreement": 0.3, "rarity": 0.2}


def candidates(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("category_status") == "review")


def with_rarity(df: DataFrame, column: str = "category") -> DataFrame:
    """rarity_score: 1 / ln(1 + rows of the category), over the largest such value; 0 for a null category.

    Counts come from one aggregation, a row a category, so no window gathers a
    frequent category in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("_n"))
    raw = counts.withColumn("_r", 1 / F.log1p("_n"))
    most = raw.agg(F.max("_r").alias("_m"))
    share = F.coalesce(F.when(F.col("_m") > 0, F.col("_r") / F.col("_m")), F.lit(0.0))
    return df.join(raw.crossJoin(most), F.col(column) == F.col("_c"), "left").withColumn("rarity_score", share).drop("_c", "_n", "_r", "_m")


def score(df: DataFrame) -> DataFrame:
    """df with entropy_score, disagreement_score, rarity_score and uncertainty_score."""
    df = with_rarity(df).withColumns(
        {"entropy_score": mean_entropy(F.col("tag_probs"), F.col("category_prob")), "disagreement_score": disagreement(F.col("tag_statuses"))}
    )
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumns({f"{k}_score": F.bround(f"{k}_score", 4) for k in WEIGHTS} | {"uncertainty_score": F.bround(total, 4)})


def reason(e: Column, d: Column, r: Column) -> Column:
    """The dominant signal (the first of equals), then notable others. The texts are fixed values."""
    we, wd, wr = e * WEIGHTS["entropy"], d * WEIGHTS["disagreement"], r * WEIGHTS["rarity"]
    top = F.when((we >= wd) & (we >= wr), "e").when(wd >= wr, "d").otherwise("r")
    first = (
        F.when(top == "e", F.format_string("High model uncertainty (entropy=%.2f)", e))
        .when(top == "d", F.format_string("LF disagreement detected (score=%.2f)", d))
        .otherwise(F.format_string("Underrepresented category (rarity=%.2f)", r))
    )
    return F.concat_ws(
        "; ",
        first,
        F.when((top != "e") & (e > 0.5), F.format_string("also uncertain (entropy=%.2f)", e)),
        F.when((top != "d") & (d > 0.3), "LF conflict present"),
        F.when((top != "r") & (r > 0.7), "rare category"),
    )


def top(df: DataFrame, n: int = 50) -> DataFrame:
    """The n most uncertain rows, smaller ids first among equals."""
    return df.orderBy(F.desc("uncertainty_score"), F.asc("sample_id")).limit(n)


def review_queue(labels: DataFrame, catalog: DataFrame, n: int = 50) -> DataFrame:
    """The review queue with item names and reasons; n rows at most, so they are the broadcast side."""
    best = top(score(candidates(labels)), n)
    names = catalog.select("sample_id", item_name(F.col("catalog_content")).alias("item_name"))
    keep = ["sample_id", "item_name", "category", "category_prob", "category_status", "dietary_tags", "uncertainty_score", "entropy_score", "disagreement_score", "rarity_score"]
    joined = best.join(names, "sample_id", "left")
    why = reason(F.col("entropy_score"), F.col("disagreement_score"), F.col("rarity_score"))
    return joined.select(*keep, why.alias("reason")).orderBy(F.desc("uncertainty_score"), "sample_id")


def summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("category").agg(F.count("*").alias("n"), F.bround(F.avg("uncertainty_score"), 4).alias("avg_uncertainty"))
