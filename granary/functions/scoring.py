"""Scores and derived values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.normalize import strip


def unit_price(price: Column, pack: Column) -> Column:
    return F.when((price != 0) & (pack > 1), F.bround(price / pack, 4))


def has_tag(tags: Column, tag: str) -> Column:
    """Whether the list has the tag; null if there is no list or it is empty."""
    return F.when(F.size(tags) > 0, F.array_contains(tags, tag))


def _points(*rules: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for rule, n in rules:
        out = out + F.when(rule, n).otherwise(0)
    return out.cast("int")


def _some(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _any(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0)


def listing_quality(item_name: Column, brand: Column, category: Column, price: Column, quantity: Column, unit: Column, pack: Column, packaging: Column, bullets: Column, description: Column, tags: Column, allergens: Column) -> Column:
    """0 to 100 points for what a validated entity has; a quantity or pack of 0 counts as missing."""
    n = F.coalesce(F.when(bullets.isNotNull(), F.size(bullets)), F.lit(0))
    points = _points(
        (_some(item_name), 15), (_some(brand), 10), (_some(category), 10), (price.isNotNull(), 5),
        (quantity.isNotNull() & (quantity != 0), 5), (_some(unit), 5), (pack.isNotNull() & (pack != 0), 5),
        (packaging.isNotNull() & (packaging != "unknown"), 5), (n >= 5, 15), ((n >= 1) & (n < 5), 8),
        (_some(description), 10), (_any(tags), 8), (_any(allergens), 7),
    )
    return F.least(points, F.lit(100))


def record_quality(item_name: Column, brand: Column, category: Column, quantity: Column, unit: Column, price: Column, tags: Column, allergens: Column, confidence: Column) -> Column:
    """0 to 100: 40 for filled fields of nine, 40 for confidence, 20 if name, price and category are there. A 0 is filled."""
    filled = F.lit(0)
    for c in (_some(item_name), _some(brand), _some(category), quantity.isNotNull(), _some(unit), price.isNotNull(), _any(tags), _any(allergens), confidence.isNotNull()):
        filled = filled + c.cast("int")
    key = _some(item_name) & price.isNotNull() & _some(category)
    return (F.floor(filled / 9 * 40) + F.floor(F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)) * 40) + F.when(key, 20).otherwise(0)).cast("int")


def confidence_quality(confidence: Column) -> Column:
    return (confidence * 100).cast("int")


def entropy(p: Column) -> Column:
    """Binary entropy in bits; 0 outside the open unit interval."""
    return F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)


def mean_entropy(probs_json: Column, fallback: Column) -> Column:
    """Mean entropy over a JSON map of probabilities; that of the fallback if the map is bad or empty."""
    values = F.map_values(F.from_json(probs_json, "map<string,double>"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + entropy(v)) / F.size(values)
    return F.when(F.size(values) > 0, mean).otherwise(entropy(fallback))


def disagreement(statuses_json: Column) -> Column:
    """2 * min / sum of accepted and rejected in a JSON map of statuses; 0 if there are none."""
    values = F.map_values(F.from_json(statuses_json, "map<string,string>"))
    yes = F.size(F.filter(values, lambda v: v == "auto_accept"))
    no = F.size(F.filter(values, lambda v: v == "auto_reject"))
    return F.when(values.isNotNull() & (yes + no > 0), 2 * F.least(yes, no) / (yes + no)).otherwise(0.0)


def label_status(p: Column, accept: float = 0.85, review: float = 0.5) -> Column:
    return F.when(p >= accept, "auto_accept").when(p >= review, "review").otherwise("auto_reject")


def score_exact(pred: Column, truth: Column) -> Column:
    a, b = F.lower(strip(pred.cast("string"))), F.lower(strip(truth.cast("string")))
    return F.when(pred.isNull() & truth.isNull(), 1.0).when(pred.isNull() | truth.isNull(), 0.0).otherwise((a == b).cast("double"))


def score_numeric(pred: Column, truth: Column, tolerance: float = 0.05) -> Column:
    """1 within the tolerance of the truth (exactly 0 for a truth of 0), else 0; uncastable values score 0."""
    a, b = pred.cast("string").try_cast("double"), truth.cast("string").try_cast("double")
    near = F.when(b == 0, (a == 0).cast("double")).otherwise((F.abs(a - b) / F.abs(b) <= tolerance).cast("double"))
    return F.when(pred.isNull() & truth.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def score_list(pred: Column, truth: Column) -> Column:
    """Jaccard similarity of two lists as lower-cased sets; 1 if both are empty."""
    none = F.array().cast("array<string>")
    clean = lambda c: F.transform(F.coalesce(c, none), lambda v: F.lower(strip(v)))
    a, b = clean(pred), clean(truth)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
