"""Product graph: node and edge tables, and the queries over them.

A graph is five DataFrames. Constraints are columns and literals, never text;
every ordered result has a total order (the product id breaks ties). Nulls sort
as the largest value: last ascending, first descending.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import strip
from granary.functions.scoring import record_quality


@dataclass(frozen=True)
class Graph:
    """products: product_id, item_name, price, quality_score, ...; edges: product_id and a name."""

    products: DataFrame
    brand_edges: DataFrame
    category_edges: DataFrame
    tag_edges: DataFrame
    allergen_edges: DataFrame


def build(records: DataFrame, order: str = "pos") -> Graph:
    """Records (product_id, item_name, brand, category, price, tags, ...) as a graph.

    Properties come from a product's last record, edges from all of its records.
    The last record is a map-side maximum by position.
    """
    none = F.array().cast("array<string>")
    q = record_quality(F.col("item_name"), F.col("brand"), F.col("category"), F.col("quantity_value"), F.col("quantity_unit"), F.col("price"), F.col("dietary_tags"), F.col("allergen_list"), F.col("extraction_confidence"))
    scored = records.withColumn("quality_score", q)
    value = F.struct(
        F.coalesce("item_name", F.lit("")).alias("item_name"),
        F.col("price"),
        F.col("quantity_value"),
        F.coalesce("quantity_unit", F.lit("")).alias("quantity_unit"),
        F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence"),
        F.col("quality_score"),
        F.substring("catalog_content", 1, 500).alias("catalog_content"),
    )
    products = scored.groupBy("product_id").agg(F.max_by(value, F.col(order)).alias("v")).select("product_id", "v.*")

    def edge(name: Column, into: str) -> DataFrame:
        return scored.select("product_id", name.alias(into)).where(F.col(into).isNotNull() & (F.col(into) != "")).distinct()

    return Graph(
        products,
        edge(strip(F.col("brand")), "brand"),
        edge(F.coalesce(F.nullif(strip(F.col("category")), F.lit("")), F.lit("Unknown")), "category"),
        edge(F.explode(F.transform(F.coalesce("dietary_tags", none), strip)), "tag"),
        edge(F.explode(F.transform(F.coalesce("allergen_list", none), lambda a: F.lower(strip(a)))), "allergen"),
    )


def summary(g: Graph) -> DataFrame:
    """kind, n: nodes and edges of each kind, in one union of counts."""
    parts = [(g.products, None, "product")] + [(e, c, c) for e, c in ((g.brand_edges, "brand"), (g.category_edges, "category"), (g.tag_edges, "tag"), (g.allergen_edges, "allergen"))]
    out = None
    for df, column, kind in parts:
        n = F.count("*") if column is None else F.countDistinct(column)
        rows = [df.agg(n.alias("n")).select(F.lit(f"{kind}_nodes").alias("kind"), "n")]
        if column:
            rows.append(df.agg(F.count("*").alias("n")).select(F.lit(f"{kind}_edges").alias("kind"), "n"))
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


def _with_names(df: DataFrame, g: Graph) -> DataFrame:
    return df.join(g.brand_edges, "product_id", "left").join(g.category_edges, "product_id", "left")


COLUMNS = ["product_id", "item_name", "price", "quality_score", "brand", "category"]


def constrained(
    g: Graph,
    tags: Sequence[str] = (),
    category: str | None = None,
    max_price: float | None = None,
    min_price: float | None = None,
    exclude_allergens: Sequence[str] = (),
    brand: str | None = None,
) -> DataFrame:
    """Products that meet every constraint: all tags, no excluded allergen, prices inclusive."""
    df = g.products
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if category is not None:
        df = df.join(g.category_edges.where(F.col("category") == category).select("product_id"), "product_id", "left_semi")
    if brand is not None:
        df = df.join(g.brand_edges.where(F.col("brand") == brand).select("product_id"), "product_id", "left_semi")
    if tags:
        wanted = sorted(set(tags))
        have = g.tag_edges.where(F.col("tag").isin(wanted)).groupBy("product_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted))
        df = df.join(have.select("product_id"), "product_id", "left_semi")
    if exclude_allergens:
        bad = g.allergen_edges.where(F.col("allergen").isin([a.lower() for a in exclude_allergens]))
        df = df.join(bad.select("product_id"), "product_id", "left_anti")
    return df


def best_first(df: DataFrame, limit: int | None) -> DataFrame:
    out = df.orderBy(F.desc_nulls_first("quality_score"), "product_id")
    return out.limit(limit) if limit is not None else out


def cheapest_first(df: DataFrame, limit: int | None) -> DataFrame:
    out = df.orderBy(F.asc_nulls_last("price"), "product_id")
    return out.limit(limit) if limit is not None else out


def _ranked(g: Graph, products: DataFrame, order: Callable[[DataFrame, int | None], DataFrame], limit: int | None) -> DataFrame:
    """Products in order with their names, which are looked up for the first ones only.

    A product of several brands or categories has several rows, and the limit
    holds for rows; rows of the first products are the first rows.
    """
    first = products if limit is None else order(products, limit)
    return order(_with_names(first, g).select(*COLUMNS), limit)


def get_products(g: Graph, limit: int | None = 20, **constraints) -> DataFrame:
    return _ranked(g, constrained(g, **constraints), best_first, limit)


def get_products_by_brand(g: Graph, brand: str, limit: int | None = 20) -> DataFrame:
    return _ranked(g, constrained(g, brand=brand), cheapest_first, limit)


def get_products_by_category(g: Graph, category: str, limit: int | None = 20) -> DataFrame:
    return _ranked(g, constrained(g, category=category), best_first, limit)


def get_similar_products(g: Graph, product_id, limit: int | None = 10) -> DataFrame:
    """Others of the same category that share tags, most shared tags first."""
    own_tags = g.tag_edges.where(F.col("product_id") == product_id).select("tag")
    own_cat = g.category_edges.where(F.col("product_id") == product_id).select("category")
    peers = g.category_edges.join(own_cat, "category", "left_semi").where(F.col("product_id") != product_id)
    shared = g.tag_edges.where(F.col("product_id") != product_id).join(own_tags, "tag", "left_semi").groupBy("product_id").agg(F.count("*").alias("shared_tags"))
    near = peers.join(shared, "product_id").join(g.products.select("product_id"), "product_id", "left_semi")

    def best(df: DataFrame) -> DataFrame:
        out = df.orderBy(F.desc("shared_tags"), "product_id")
        return out.limit(limit) if limit is not None else out

    # Properties and brands are looked up for the first ones only.
    return best(best(near).join(g.products, "product_id").join(g.brand_edges, "product_id", "left").select(*COLUMNS, "shared_tags"))


def get_allergen_safe_products(g: Graph, allergens: Sequence[str], category: str | None = None, limit: int | None = 20) -> DataFrame:
    return get_products(g, limit, category=category, exclude_allergens=allergens)


def get_brand_stats(g: Graph, brand: str, fanout: bool = False) -> DataFrame:
    """Count, prices, categories and tags of a brand. With ``fanout`` prices count once for each tag of a product."""
    own = constrained(g, brand=brand).join(g.category_edges, "product_id", "left").join(g.tag_edges, "product_id", "left")
    lists = own.agg(F.countDistinct("product_id").alias("product_count"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("tag")).alias("tags"))
    prices = (own if fanout else own.select("product_id", "price").distinct()).agg(F.round(F.avg("price"), 2).alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return lists.crossJoin(prices).select(F.lit(brand).alias("brand"), "product_count", "avg_price", "min_price", "max_price", "categories", "tags")


def get_category_stats(g: Graph) -> DataFrame:
    per = g.category_edges.join(g.products, "product_id").groupBy("category")
    return per.agg(F.count("*").alias("product_count"), F.round(F.avg("price"), 2).alias("avg_price"), F.round(F.min("price"), 2).alias("min_price"), F.round(F.max("price"), 2).alias("max_price")).orderBy(F.desc("product_count"), "category")


def get_dietary_tag_stats(g: Graph) -> DataFrame:
    return g.tag_edges.groupBy("tag").agg(F.count("*").alias("product_count")).orderBy(F.desc("product_count"), "tag")


def get_top_brands(g: Graph, limit: int = 10) -> DataFrame:
    per = g.brand_edges.join(g.products, "product_id").groupBy("brand").agg(F.count("*").alias("product_count"), F.round(F.avg("price"), 2).alias("avg_price"))
    return per.orderBy(F.desc("product_count"), "brand").limit(limit)


def get_products_by_price_range(g: Graph, low: float, high: float, category: str | None = None, limit: int | None = 20) -> DataFrame:
    return _ranked(g, constrained(g, category=category, min_price=low, max_price=high), cheapest_first, limit)


def get_product_detail(g: Graph, product_id) -> DataFrame:
    """One row with sorted lists of tags and allergens; none if there is no such product."""
    own = F.col("product_id") == product_id
    lists = [e.where(own).groupBy("product_id").agg(F.array_sort(F.collect_set(c)).alias(n)) for e, c, n in ((g.tag_edges, "tag", "tags"), (g.allergen_edges, "allergen", "allergens"))]
    out = _with_names(g.products.where(own), g).select(*COLUMNS)
    for df in lists:
        out = out.join(df, "product_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({n: F.coalesce(n, none) for n in ("tags", "allergens")})


def get_detail_similar(g: Graph, product_id, limit: int = 5) -> DataFrame:
    """Others of the same category, by id."""
    own = g.category_edges.where(F.col("product_id") == product_id).select("category")
    peers = g.category_edges.join(own, "category", "left_semi").where(F.col("product_id") != product_id)
    return peers.join(g.products, "product_id").select("product_id", "item_name", "price", "category").orderBy("product_id").limit(limit)


def lookup(g: Graph, ids: DataFrame) -> DataFrame:
    """Products whose ids are in ids(product_id)."""
    return _with_names(g.products.join(ids.select("product_id").distinct(), "product_id", "left_semi"), g).select(*COLUMNS)


def set_image_urls(products: DataFrame, base: str) -> DataFrame:
    from granary.functions.text import image_url

    return products.withColumn("image_url", image_url(F.col("product_id").cast("string"), base))


def duplicates_of_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that break the uniqueness of a key: the check that stands for a unique constraint."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
