"""Validation of extracted records: parse, normalise, check, gate, dead-letter, retry.

A record goes through its stages as top-level columns, one projection a stage:
an expression that a later stage names several times is computed once and the
plan stays as large as the sum of its stages.

Defined cases: a null answer, one that is not a JSON object and an empty one fail
at ``json_parse``; missing lists are empty ones and leave null; a missing
confidence is 0; columns of the input stay, but ``step``, ``error`` and ``entity``
are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import normalize as nz
from granary.functions import scoring as sc
from granary.functions import vocab
from granary.functions.text import content_tier, strip_fence
from granary.sources.tables import materialize

MIN_CONFIDENCE = 0.6
# The steps that a record can fail at.
JSON_PARSE, SCHEMA, CONFIDENCE = "json_parse", "pydantic", "confidence"
# Kinds of packaging and image quality.
PACKAGING = ["bottle", "bag", "box", "jar", "can", "sachet", "pouch", "tube", "carton", "unknown"]
IMAGE_QUALITY = ["high", "medium", "low"]
VISUAL = "struct<packaging_type:string,packaging_color:string,has_brand_logo:boolean,image_quality:string>"
RECORD = (
    "item_name string, brand string, category string, quantity_value double, quantity_unit string, pack_size int, price double, "
    "dietary_tags array<string>, allergen_list array<string>, description string, bullet_points array<string>, ingredients array<string>, "
    f"visual {VISUAL}, image_url string, extraction_confidence double, _bad string"
)
Fields = Column | Mapping[str, Column]
_OWN = "__validate_"


def parse(answer: Column) -> Column:
    """The record in a (fenced) answer; its ``_bad`` says what could not be parsed."""
    return F.from_json(strip_fence(answer), RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def field_errors(e: Fields, adapter: vocab.Adapter = vocab.RETAIL) -> Column:
    """Messages for each field that breaks its contract, in field order.

    Lengths hold for the raw value, the name's lower bound after trimming too.
    """
    trimmed, visual = nz.strip(e["item_name"]), e["visual"]
    bad = [
        (e["product_id"].isNull() | (nz.strip(e["product_id"]) == ""), "product_id: must not be empty"),
        (e["item_name"].isNull(), "item_name: field required"),
        ((F.length(e["item_name"]) < 2) | (F.length(e["item_name"]) > 500) | (F.length(trimmed) < 2), "item_name: must have 2 to 500 characters"),
        (F.length(e["brand"]) > 100, "brand: must have at most 100 characters"),
        (~e["category"].isin(adapter.categories), "category: not in the vocabulary"),
        (e["quantity_value"] < 0, "quantity_value: must be at least 0"),
        (~e["quantity_unit"].isin(adapter.units), "quantity_unit: not in the vocabulary"),
        ((e["pack_size"] < 1) | (e["pack_size"] > 1000), "pack_size: must be 1 to 1000"),
        (e["price"].isNull(), "price: field required"),
        (e["price"] < 0, "price: must be at least 0"),
        (F.size(F.array_except(clean_list(e["dietary_tags"]), F.array(*map(F.lit, adapter.tags)))) > 0, "dietary_tags: not in the vocabulary"),
        (F.size(F.array_except(clean_list(e["allergen_list"], lower=True), F.array(*map(F.lit, adapter.allergens)))) > 0, "allergen_list: not in the vocabulary"),
        (F.length(e["description"]) > 5000, "description: must have at most 5000 characters"),
        (~visual["packaging_type"].isin(PACKAGING), "visual -> packaging_type: not in the vocabulary"),
        (F.length(visual["packaging_color"]) > 50, "visual -> packaging_color: must have at most 50 characters"),
        (~visual["image_quality"].isin(IMAGE_QUALITY), "visual -> image_quality: not in the vocabulary"),
        ((e["extraction_confidence"] < 0) | (e["extraction_confidence"] > 1), "extraction_confidence: must be 0 to 1"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in bad)))


def clean_list(c: Column, lower: bool = False) -> Column:
    """Trimmed, distinct in order; null if empty."""
    own = F.array_distinct(F.transform(c, lambda v: F.lower(nz.strip(v)) if lower else nz.strip(v)))
    return F.when(F.size(own) > 0, own)


def clean_texts(c: Column) -> Column:
    """Trimmed, without blank ones; null if none is left."""
    own = F.filter(F.transform(c, nz.strip), lambda v: v != "")
    return F.when(F.size(own) > 0, own)


def clean_visual(v: Column) -> Column:
    """Visual attributes with their defaults; a blank colour is none."""
    color = F.nullif(F.lower(nz.strip(v["packaging_color"])), F.lit(""))
    own = F.struct(
        F.coalesce(v["packaging_type"], F.lit("unknown")).alias("packaging_type"),
        color.alias("packaging_color"),
        v["has_brand_logo"].alias("has_brand_logo"),
        F.coalesce(v["image_quality"], F.lit("high")).alias("image_quality"),
    )
    return F.when(v.isNotNull(), own)


def cleaned(e: Fields) -> dict[str, Column]:
    """The fields that an entity holds in another form than its record."""
    return {
        "item_name": nz.strip(e["item_name"]),
        "brand": F.nullif(nz.strip(e["brand"]), F.lit("")),
        "dietary_tags": clean_list(e["dietary_tags"]),
        "allergen_list": clean_list(e["allergen_list"], lower=True),
        "bullet_points": clean_texts(e["bullet_points"]),
        "ingredients": clean_texts(e["ingredients"]),
        "visual": clean_visual(e["visual"]),
    }


PLAIN = ("product_id", "item_name", "brand", "category", "quantity_value", "quantity_unit", "pack_size", "price")


def derive(e: Fields) -> Column:
    """The entity of cleaned fields with its derived ones: unit price, flags, tier, quality."""
    n = F.coalesce(F.when(e["bullet_points"].isNotNull(), F.size(e["bullet_points"])), F.lit(0))
    points = sc.listing_quality(
        e["item_name"], e["brand"], e["category"], e["price"], e["quantity_value"], e["quantity_unit"], e["pack_size"],
        e["visual"]["packaging_type"], e["bullet_points"], e["description"], e["dietary_tags"], e["allergen_list"],
    )
    return F.struct(
        *(e[c].alias(c) for c in PLAIN),
        sc.unit_price(e["price"], e["pack_size"]).alias("unit_price"),
        e["dietary_tags"].alias("dietary_tags"),
        e["allergen_list"].alias("allergen_list"),
        sc.has_tag(e["dietary_tags"], "organic").alias("is_organic"),
        sc.has_tag(e["dietary_tags"], "kosher").alias("is_kosher"),
        *(e[c].alias(c) for c in ("description", "bullet_points", "ingredients", "visual", "image_url")),
        points.alias("quality_score"),
        content_tier(n, e["description"]).alias("content_tier"),
        F.coalesce(e["extraction_confidence"], F.lit(0.0)).alias("extraction_confidence"),
    )


def validate(df: DataFrame, answer: str, product_id: str, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """df with step (null if valid), error, and entity (null unless valid)."""
    names = [x.split()[0] for x in RECORD.split(", ") if not x.startswith("_")]
    mine = lambda name: F.col(_OWN + name)
    own = df.withColumn(f"{_OWN}record", parse(F.col(answer)))
    record = mine("record")
    draft = {"product_id": F.col(product_id).cast("string")} | {n: record[n] for n in names}
    own = own.withColumns({_OWN + n: c for n, c in nz.product_fields(draft, adapter, fuzzy).items()})
    fields = {n: mine(n) for n in draft}
    unparsed = F.col(answer).isNull() | record.isNull() | record["_bad"].isNotNull()
    own = own.withColumns({f"{_OWN}errors": field_errors(fields, adapter), f"{_OWN}unparsed": F.coalesce(unparsed, F.lit(True))})
    errors, low = mine("errors"), fields["extraction_confidence"] < min_confidence
    step = F.when(mine("unparsed"), JSON_PARSE).when(F.size(errors) > 0, SCHEMA).when(low, CONFIDENCE)
    listed = F.array_join(F.transform(errors, lambda m: F.concat(F.lit("  - "), m)), "\n")
    gate = F.concat(F.lit("extraction_confidence="), fields["extraction_confidence"].cast("string"), F.lit(f" is below minimum {min_confidence}"))
    error = F.when(mine("unparsed"), "not a JSON object").when(F.size(errors) > 0, listed).when(low, gate)
    own = own.withColumns({f"{_OWN}step": step, f"{_OWN}error": error} | {_OWN + n: c for n, c in cleaned(fields).items()})
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("step", "error", "entity")]
    return own.select(*kept, mine("step").alias("step"), mine("error").alias("error"), F.when(mine("step").isNull(), derive(fields)).alias("entity"))


def retry_message(step: Column, error: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    return (
        F.when(step == JSON_PARSE, F.concat(F.lit("The answer is not valid JSON.\nError: "), error, F.lit("\nAnswer with JSON only, without fences.")))
        .when(step == SCHEMA, F.concat(F.lit("The JSON breaks the schema.\nErrors:\n"), error, F.lit("\nCorrect these fields.")))
        .when(step == CONFIDENCE, F.lit(f"The confidence is below {min_confidence}. Read the product again."))
        .otherwise(F.concat(F.lit("Validation failed at "), step, F.lit(": "), error))
    )


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters) of rows that are judged once: their table is written first, unless they come from one."""
    validated = validated if hasattr(validated, "_granary_path") else materialize(validated)
    return validated.where("step is null"), validated.where("step is not null")


def with_retries(df: DataFrame, answer: str, product_id: str, again: Callable[[DataFrame], DataFrame], attempts: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters) after up to ``attempts`` rounds.

    ``again`` gets the failed rows with retry_message and attempt and returns
    them with a new answer. Every round is written to the shared folder before
    the next one starts, so ``again`` answers each failed row once a round,
    whatever is done with the result, and accepted and dead rows never contradict
    each other. A round without failures is the last.
    """
    accepted, rows, bad = None, df, None
    for attempt in range(1, attempts + 1):
        judged = materialize(validate(rows, answer, product_id, **options).withColumn("attempt", F.lit(attempt)))
        ok, bad = split(judged)
        accepted = ok if accepted is None else accepted.unionByName(ok)
        if attempt == attempts or bad.isEmpty():
            break
        told = bad.withColumn("retry_message", retry_message(F.col("step"), F.col("error"), options.get("min_confidence", MIN_CONFIDENCE)))
        rows = again(told).select(*(F.col(f"`{c}`") for c in df.columns))
    return accepted, bad


def dead_letters(failed: DataFrame, product_id: str = "product_id") -> DataFrame:
    """What the dead-letter log holds: errors are cut at 500 characters."""
    return failed.select(F.current_timestamp().alias("at"), F.col(product_id).alias("product_id"), "attempt", "step", F.substring("error", 1, 500).alias("error"))


def merge_corrections(df: DataFrame, corrections: DataFrame, key: str = "product_id", adapter: vocab.Adapter = vocab.RETAIL) -> DataFrame:
    """df with corrected category and tags: unknown categories become Unknown, tags outside the vocabulary go."""
    c = corrections.select(F.col(key).alias("_k"), F.col("category").alias("_c"), F.col("dietary_tags").alias("_t"))
    known = F.when(F.col("_c").isin(adapter.categories), F.col("_c")).otherwise("Unknown")
    tags = F.filter("_t", lambda t: t.isin(adapter.tags))
    out = df.join(c, F.col(key) == F.col("_k"), "left")
    return out.withColumns({"category": F.when(F.col("_c").isNotNull(), known).otherwise(F.col("category")), "dietary_tags": F.coalesce(tags, "dietary_tags")}).drop("_k", "_c", "_t")
