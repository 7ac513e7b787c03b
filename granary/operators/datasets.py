"""Training sets: samples, splits, merges, chat messages, synthetic rows.

Draws are by hash order: exact in size, the same in every run, whatever the
partitioning. A stratum may hold most rows: its draw is a limit of map-side
top-k lists or a threshold, never a sort of the stratum in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw_key(id_: Column, seed: int = 42) -> Column:
    """The order of draws: a portable hash of the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def quotas(counts: Mapping[str, int], n: int, least: int = 10) -> dict[str, int]:
    """Proportional quotas with a floor, scaled down (floor again) if they exceed n."""
    total = sum(counts.values())
    if not total:
        return {}
    out = {k: max(least, n * c // total) for k, c in counts.items()}
    if (given := sum(out.values())) > n:
        out = {k: max(least, int(v * n / given)) for k, v in out.items()}
    return out


def take_per_group(df: DataFrame, group: str, id_: str, quota: Mapping[str, int], seed: int = 42) -> DataFrame:
    """The first quota[g] rows of each group in draw order (all of smaller groups).

    One top-k per group: each task keeps at most the quota, so a frequent group
    is cut down before anything moves.
    """
    out = None
    for g, n in sorted(quota.items()):
        own = df.where(F.col(group) == g).orderBy(draw_key(F.col(id_), seed), id_).limit(n)
        out = own if out is None else out.unionByName(own)
    return df.limit(0) if out is None else out


def stratified_sample(df: DataFrame, labels: DataFrame, n: int, id_: str = "sample_id", category: str = "category", seed: int = 42) -> DataFrame:
    """n rows of df: proportional to accepted labels' categories, the rest from what is left."""
    accepted = labels.where(F.col("category_status") == "auto_accept").select(id_, F.col(category).alias("_c"))
    merged = df.join(accepted, id_)
    counts = {r["_c"]: r["n"] for r in merged.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # a row a category
    part = take_per_group(merged, "_c", id_, quotas(counts, n), seed).drop("_c").dropDuplicates([id_])
    rest = df.join(part.select(id_), id_, "left_anti").orderBy(draw_key(F.col(id_), seed), id_).limit(max(0, n - part.count()))
    return part.unionByName(rest)


def tier_sample(df: DataFrame, tier: str, quota: Mapping[str, int], id_: str, keep: DataFrame | None = None, done: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """A fixed quota for each tier among rows in keep (if given) and not in done (if given)."""
    if keep is not None:
        df = df.join(keep.select(id_), id_, "left_semi")
    if done is not None:
        df = df.join(done.select(id_), id_, "left_anti")
    return take_per_group(df, tier, id_, quota, seed)


def exact_split(df: DataFrame, id_: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split: train for exactly floor(n * share) rows in draw order, val for the others.

    Counts by the hash's first three digits (4096 rows) say in which such range
    the cut lies; rows are ranked within their range only.
    """
    keyed = df.withColumn("_k", draw_key(F.col(id_), seed)).withColumn("_p", F.substring("_k", 1, 3))
    counts = sorted((r["_p"], r["n"]) for r in keyed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    need, cut = int(sum(n for _, n in counts) * share), "~"
    for prefix, n in counts:
        if need < n:
            cut = prefix
            break
        need -= n
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_k", id_))
    first = (F.col("_p") < cut) | ((F.col("_p") == cut) & (rank <= need))
    return keyed.withColumn("split", F.when(first, "train").otherwise("val")).drop("_k", "_p")


def resume(df: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """Rows that a checkpoint doesn't name."""
    return df.join(done.where("success").select(id_).distinct() if "success" in done.columns else done.select(id_).distinct(), id_, "left_anti")


def synthetic_quotas(categories: Sequence[str], real: int, ratio: float = 0.2, least: int = 50) -> dict[str, int]:
    """At most ratio * real in all, at least ``least`` a category as long as they last."""
    left = int(real * ratio)
    each = max(least, left // max(1, len(categories)))
    out: dict[str, int] = {}
    for c in categories:
        out[c] = min(each, left)
        left -= out[c]
        if left <= 0:
            break
    return out


def _listing_text() -> Column:
    return F.concat(F.lit("Item Name: "), "item_name", F.lit("\nBullet Point 1: "), F.array_join("dietary_tags", ", "), F.lit("\nValue: "), F.col("quantity_value").cast("string"), F.lit("\nUnit: "), "quantity_unit")


def quotas_of(real: DataFrame, category: str, ratio: float = 0.2, least: int = 50) -> DataFrame:
    """category, quota: :func:`synthetic_quotas` for the categories that the real rows have, in order of their names; rows without one count for none."""
    counts = real.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a category
    left = F.floor(F.sum("n").over(every) * ratio)
    each = F.greatest(F.lit(least), F.floor(left / F.count("*").over(every)))
    before = (F.row_number().over(every.orderBy("category")) - 1) * each
    return counts.select("category", F.least(each, left - before).alias("quota")).where("quota > 0")


def listings_of(quotas: DataFrame, adjectives: Sequence[str], nouns: Sequence[str], brands: Sequence[str], units: Sequence[str], tags: Sequence[str], seed: int = 42) -> DataFrame:
    """As many listings of each category with their true records as its quota says, reproducible from the seed whatever the layout."""
    i = F.concat_ws("-", "category", F.col("_k").cast("string"))
    value = (portable(i, "value", seed) % 640 + 10) / 10.0
    price = (portable(i, "price", seed) % 4800 + 199) / 100.0
    name = F.concat_ws(" ", pick(brands, i, "brand", seed), pick(adjectives, i, "adjective", seed), pick(nouns, i, "product", seed))
    # Quotas are cut into ranges of a thousand, so a large category is many tasks' work.
    ranges = quotas.where("quota > 0").select("category", "quota", F.explode(F.expr("sequence(0, cast((quota - 1) div 1000 as int))")).alias("_r"))
    rows = ranges.repartition("category", "_r").select("category", F.explode(F.expr("sequence(_r * 1000, least((_r + 1) * 1000, quota) - 1)")).alias("_k"))
    out = rows.select(
        F.concat(F.lit("syn-"), i).alias("sample_id"), name.alias("item_name"), "category", value.alias("quantity_value"),
        pick(units, i, "unit", seed).alias("quantity_unit"), price.alias("price"), F.array(pick(tags, i, "tag", seed)).alias("dietary_tags"),
    )
    return out.withColumn("catalog_content", _listing_text())


def portable(id_: Column, salt: str, seed: int = 42) -> Column:
    """A number of 32 bits by a hash of seed, salt and id that any engine has."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), id_.cast("string"))), 1, 8), 16, 10).cast("long")


def pick(options: Sequence[str], id_: Column, salt: str, seed: int = 42) -> Column:
    """One of the options by hash of the id."""
    return F.get(F.array(*map(F.lit, options)), (portable(id_, salt, seed) % len(options)).cast("int"))


def synthetic_listings(spark: SparkSession, quota: Mapping[str, int], adjectives: Sequence[str], products: Mapping[str, Sequence[str]], brands: Sequence[str], units: Sequence[str], tags: Sequence[str], seed: int = 42) -> DataFrame:
    """Listings with their true records, quota[c] of each category, reproducible from the seed."""
    out = None
    for k, (category, n) in enumerate(sorted(quota.items())):
        i = F.concat(F.lit(f"{k}-"), F.col("id").cast("string"))
        value = (portable(i, "value", seed) % 640 + 10) / 10.0
        price = (portable(i, "price", seed) % 4800 + 199) / 100.0
        name = F.concat_ws(" ", pick(brands, i, "brand", seed), pick(adjectives, i, "adjective", seed), pick(products[category], i, "product", seed))
        rows = spark.range(n).select(
            F.concat(F.lit("syn-"), i).alias("sample_id"), name.alias("item_name"), F.lit(category).alias("category"), value.alias("quantity_value"),
            pick(units, i, "unit", seed).alias("quantity_unit"), price.alias("price"), F.array(pick(tags, i, "tag", seed)).alias("dietary_tags"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("catalog_content", _listing_text())


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def clean_prediction(p: Column) -> Column:
    """The eight fields of the training schema with their defaults."""
    none = F.array().cast("array<string>")
    return F.struct(
        p["item_name"].alias("item_name"), p["price"].alias("price"), F.coalesce(p["quantity_value"], F.lit(1.0)).alias("quantity_value"),
        F.coalesce(p["quantity_unit"], F.lit("ct")).alias("quantity_unit"), p["category"].alias("category"), F.coalesce(p["dietary_tags"], none).alias("dietary_tags"),
        F.coalesce(p["allergen_list"], none).alias("allergen_list"), F.coalesce(p["extraction_confidence"], F.lit(0.85)).alias("extraction_confidence"),
    )


def user_prompt(instruction: str, listing: Column, price: Column) -> Column:
    """Instruction, listing and price; the price is not added to a listing that has one."""
    body = F.regexp_replace(listing, r"(?U)^\s+|\s+$", "")
    priced = F.when(price.isNotNull() & ~F.contains(body, F.lit("Price:")), F.concat(body, F.lit("\nPrice: "), price.cast("string"))).otherwise(body)
    return F.concat(F.lit(instruction + "\n\nProduct listing:\n"), priced)


def training_pair(system: str, instruction: str, listing: Column, price: Column, prediction: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", user_prompt(instruction, listing, price)), message("assistant", F.to_json(clean_prediction(prediction), {"ignoreNullFields": "false"})))


def retry_messages(messages: Column, failed: Column, error: Column) -> Column:
    """The conversation with the failed answer and a request to correct it."""
    told = F.concat(F.lit("That output failed validation:\n"), error, F.lit("\n\nReturn only the corrected JSON object."))
    return F.concat(messages, F.array(message("assistant", failed), message("user", told)))


def token_estimate(messages: Column) -> Column:
    """Characters of all contents over four, rounded down."""
    return F.floor(F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0))) / 4)


def last_of_role(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def roles_complete(messages: Column, roles: Sequence[str] = ("system", "user", "assistant")) -> Column:
    own = F.transform(messages, lambda m: m["role"])
    out = F.lit(True)
    for r in roles:
        out = out & F.array_contains(own, r)
    return F.coalesce(out, F.lit(False))


def merge(original: DataFrame, extracted: DataFrame, pair: Column) -> DataFrame:
    """Original pairs and those of high-confidence extractions with a listing (UNION ALL)."""
    good = extracted.where((F.col("bucket") == "high_conf") & F.col("prediction").isNotNull() & (F.col("catalog_content") != ""))
    return original.select("messages").unionByName(good.select(pair.alias("messages")))


def structure_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row of counters over JSON lines of training pairs: total, parse errors, bad roles, bad answers."""
    schema = "messages array<struct<role:string,content:string>>, _bad string"
    p = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = lines.where(F.trim(column) != "").select(p.alias("p"))
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull()
    m = F.col("p.messages")
    answer = F.try_parse_json(last_of_role(m, "assistant"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.agg(F.count("*").alias("lines"), n(bad)("parse_errors"), n(~bad)("total"), n(~bad & ~roles_complete(m))("bad_messages"), n(~bad & roles_complete(m) & answer.isNull())("bad_answers"))


def full_prompt(system: str, examples: Sequence[tuple[str, str]], instruction: str, listing: Column, price: Column) -> Column:
    """System message, worked examples (listing, answer) and the question."""
    shots = [m for x, y in examples for m in (message("user", F.lit(f"{instruction}\n\nProduct listing:\n{x}")), message("assistant", F.lit(y)))]
    return F.array(message("system", F.lit(system)), *shots, message("user", user_prompt(instruction, listing, price)))


def answer_histogram(pairs: DataFrame, field: str) -> DataFrame:
    """value, n of a field of the assistants' answers; answers that are not JSON are left out."""
    answer = F.from_json(last_of_role(F.col("messages"), "assistant"), "map<string,string>")
    return pairs.select(answer[field].alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def manifest(split: DataFrame) -> DataFrame:
    """Rows of each part of a split."""
    return split.groupBy("split").agg(F.count("*").alias("n"))


def pair_manifest(pairs: DataFrame, id_: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """messages, category, item_name of the answer and split of synthetic pairs (messages, category)."""
    answer = F.from_json(last_of_role(F.col("messages"), "assistant"), "item_name string")["item_name"]
    return exact_split(pairs, id_, share, seed).select("messages", "category", F.coalesce(answer, F.lit("")).alias("item_name"), "split")


def append_pairs(pairs: DataFrame, id_: str, path: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Append pairs to path/train and path/val as JSON lines and to path/manifest as CSV; returns the manifest's rows."""
    listed = pair_manifest(pairs, id_, share, seed)
    for part in ("train", "val"):
        listed.where(F.col("split") == part).select("messages").write.mode("append").json(f"{path}/{part}")
    rows = listed.select("category", "split", "item_name")
    rows.write.mode("append").options(header=True, escape='"', emptyValue="").csv(f"{path}/manifest")
    return rows
