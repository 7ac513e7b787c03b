"""Registry of the engine's own queries and their SQL twins.

The tables of the test star schema stand for a catalog: parts are products,
their brands, types and name words are brands, categories and tags, the nations
of their suppliers are allergens, embeddings share the part's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import normalize as nz
from granary.functions import scoring as sc
from granary.functions import text as tx
from granary.functions import vocab
from granary.operators import active, datasets, dedup, evaluate, profile, validate, weak
from granary.operators import graph as gr
from granary.operators import vector as vc
from granary.plans.registry import ORACLE, QUERIES, query, table  # noqa: F401
from granary.sources.tables import spread

def product_graph(spark: SparkSession, sf_dir: str) -> gr.Graph:
    part = table(spark, sf_dir, "part")
    i = F.col("p_partkey").alias("product_id")
    products = part.select(i, F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 2).alias("quality_score"))
    supplied = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("s_suppkey"))
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("allergen"))
    return gr.Graph(
        products,
        part.select(i, F.col("p_brand").alias("brand")),
        part.select(i, F.col("p_type").alias("category")),
        part.select(i, F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag")),
        supplied.join(nations, "s_suppkey").select("product_id", "allergen").distinct(),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))


def probe() -> list[float]:
    """A fixed query vector of 64 numbers."""
    return [((7 * i) % 13 - 6) / 10 for i in range(64)]


G = """with products as (
  select p_partkey as product_id, p_name as item_name, p_retailprice as price, 2 * p_size as quality_score, p_brand as brand, p_type as category from part
), tags as (
  select distinct p_partkey as product_id, unnest(string_split(p_name, ' ')) as tag from part
), allergens as (
  select distinct l_partkey as product_id, lower(n_name) as allergen from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
)
"""
PROBE_SQL = "[" + ", ".join(f"{x!r}::double" for x in probe()) + "]"
COSINE = f"""round(list_inner_product(embedding::double[], {PROBE_SQL}) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product({PROBE_SQL}, {PROBE_SQL}))), 6)"""


# ---- graph ---------------------------------------------------------------------------------------------------------
@query(G + """select product_id, item_name, price, quality_score, brand, category from products p
where category = 'ECONOMY' and price <= 980.0 and price >= 901.0
  and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'red')
  and not exists (select 1 from allergens a where a.product_id = p.product_id and a.allergen = 'nation_3')
order by quality_score desc nulls first, product_id limit 20""")
def graph_filter_products(spark, sf_dir):
    return gr.get_products(product_graph(spark, sf_dir), 20, tags=["red"], category="ECONOMY", max_price=980.0, min_price=901.0, exclude_allergens=["NATION_3"])


@query(G + "select product_id, item_name, price, quality_score, brand, category from products where brand = 'Brand#2' order by price asc nulls last, product_id limit 20")
def graph_by_brand(spark, sf_dir):
    return gr.get_products_by_brand(product_graph(spark, sf_dir), "Brand#2", 20)


@query(G + "select product_id, item_name, price, quality_score, brand, category from products where category = 'ECONOMY' order by quality_score desc nulls first, product_id limit 20")
def graph_by_category(spark, sf_dir):
    return gr.get_products_by_category(product_graph(spark, sf_dir), "ECONOMY", 20)


@query(G + """select p.product_id, item_name, price, quality_score, brand, category, s.shared_tags from products p
join (select product_id, count(*) as shared_tags from tags where tag in (select tag from tags where product_id = 1) group by 1) s using (product_id)
where category = (select category from products where product_id = 1) and p.product_id <> 1 order by shared_tags desc, p.product_id limit 10""")
def graph_similar(spark, sf_dir):
    return gr.get_similar_products(product_graph(spark, sf_dir), 1, 10)


@query(G + """select product_id, item_name, price, quality_score, brand, category from products p
where category = 'PROMO' and not exists (select 1 from allergens a where a.product_id = p.product_id and a.allergen = 'nation_5')
order by quality_score desc nulls first, product_id limit 20""")
def graph_allergen_safe(spark, sf_dir):
    return gr.get_allergen_safe_products(product_graph(spark, sf_dir), ["NATION_5"], "PROMO", 20)


_BRAND = """select 'Brand#3' as brand, count(distinct product_id) as product_count, {avg} as avg_price, min(price) as min_price, max(price) as max_price,
list_sort(list(distinct category)) as categories, list_sort(list(distinct tag)) as tags from products left join tags using (product_id) where brand = 'Brand#3'"""


@query(G + _BRAND.format(avg="round((select avg(price) from products where brand = 'Brand#3'), 2)"))
def graph_brand_stats(spark, sf_dir):
    return gr.get_brand_stats(product_graph(spark, sf_dir), "Brand#3")


@query(G + _BRAND.format(avg="round(avg(price), 2)"))
def graph_brand_stats_fanout(spark, sf_dir):
    return gr.get_brand_stats(product_graph(spark, sf_dir), "Brand#3", fanout=True)


@query(G + "select category, count(*) as product_count, round(avg(price), 2) as avg_price, round(min(price), 2) as min_price, round(max(price), 2) as max_price from products group by 1")
def graph_category_stats(spark, sf_dir):
    return gr.get_category_stats(product_graph(spark, sf_dir))


@query(G + "select tag, count(*) as product_count from tags group by 1")
def graph_tag_stats(spark, sf_dir):
    return gr.get_dietary_tag_stats(product_graph(spark, sf_dir))


@query(G + "select brand, count(*) as product_count, round(avg(price), 2) as avg_price from products group by 1 order by 2 desc, 1 limit 10")
def graph_top_brands(spark, sf_dir):
    return gr.get_top_brands(product_graph(spark, sf_dir), 10)


@query(G + "select product_id, item_name, price, quality_score, brand, category from products where price between 905.0 and 920.0 and category = 'PROMO' order by price, product_id limit 20")
def graph_price_range(spark, sf_dir):
    return gr.get_products_by_price_range(product_graph(spark, sf_dir), 905.0, 920.0, "PROMO", 20)


@query(G + """select product_id, item_name, price, quality_score, brand, category,
(select list_sort(list(tag)) from tags where product_id = 7) as tags, (select list_sort(list(allergen)) from allergens where product_id = 7) as allergens from products where product_id = 7""")
def graph_detail(spark, sf_dir):
    return gr.get_product_detail(product_graph(spark, sf_dir), 7)


@query(G + "select product_id, item_name, price, category from products where category = (select category from products where product_id = 7) and product_id <> 7 order by product_id limit 5")
def graph_detail_similar(spark, sf_dir):
    return gr.get_detail_similar(product_graph(spark, sf_dir), 7)


@query(G + "select product_id, item_name, price, quality_score, brand, category from products where product_id in (select vec_id from embeddings where label = 3)")
def graph_batch_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("product_id"))
    return gr.lookup(product_graph(spark, sf_dir), ids)


@query(G + """select 'product_nodes' as kind, count(*) as n from products
union all select 'brand_nodes', count(distinct brand) from products union all select 'brand_edges', count(*) from products
union all select 'category_nodes', count(distinct category) from products union all select 'category_edges', count(*) from products
union all select 'tag_nodes', count(distinct tag) from tags union all select 'tag_edges', count(*) from tags
union all select 'allergen_nodes', count(distinct allergen) from allergens union all select 'allergen_edges', count(*) from allergens""")
def graph_summary(spark, sf_dir):
    return gr.summary(product_graph(spark, sf_dir))


def event_records(spark, sf_dir) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("product_id"), F.col("event_type").alias("item_name"), F.lit(" ").alias("brand"), F.col("event_type").alias("category"),
        F.col("value").alias("price"), F.lit(None).cast("double").alias("quantity_value"), F.lit(None).cast("string").alias("quantity_unit"), F.array(F.col("event_type")).alias("dietary_tags"),
        none.alias("allergen_list"), F.lit(0.9).alias("extraction_confidence"), F.col("props").alias("catalog_content"),
    )


@query("""select user_id as product_id, arg_max(event_type, event_id) as item_name, arg_max(value, event_id) as price, cast(null as double) as quantity_value, '' as quantity_unit, 0.9::double as extraction_confidence,
cast(floor(6 / 9.0 * 40) + floor(0.9 * 40) + 20 as integer) as quality_score, arg_max(props, event_id) as catalog_content from events group by 1""")
def graph_build_nodes(spark, sf_dir):
    return gr.build(event_records(spark, sf_dir)).products


@query("select distinct user_id as product_id, event_type as category from events")
def graph_build_edges(spark, sf_dir):
    return gr.build(event_records(spark, sf_dir)).category_edges


# ---- vectors -------------------------------------------------------------------------------------------------------
@query(f"select vec_id as product_id, round_even({COSINE}, 3) as score from embeddings order by {COSINE} desc, vec_id limit 10")
def vector_topk(spark, sf_dir):
    return vc.search(vectors(spark, sf_dir), probe(), 10).select("product_id", "score")


@query(f"""with near as (select vec_id as product_id, {COSINE} as semantic from embeddings order by 2 desc, 1 limit 10)
select product_id, p_name as item_name, p_retailprice as price, 2 * p_size as quality_score, p_brand as brand, p_type as category, semantic,
round_even(0.7::double * semantic + 0.3::double * (case when p_size <> 0 then 2 * p_size else 50 end) / 100.0::double, 3) as score from near join part on p_partkey = product_id""")
def hybrid_semantic_first(spark, sf_dir):
    return vc.semantic_first(product_graph(spark, sf_dir), vectors(spark, sf_dir), probe(), 10)


@query(G + f""", pool as (
  select product_id, item_name, price, quality_score, brand, category from products p where category = 'ECONOMY' and price <= 990.0
    and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'red')
    and not exists (select 1 from allergens a where a.product_id = p.product_id and a.allergen = 'nation_3')
  order by quality_score desc nulls first, product_id limit 100
), scored as (
  select pool.*, coalesce(s.semantic, 0.5::double) as semantic from pool left join (select vec_id, {COSINE} as semantic from embeddings) s on vec_id = product_id
)
select *, round_even(0.6::double * semantic + 0.4::double * quality_score / 100.0::double, 3) as score from scored order by score desc, product_id limit 10""")
def hybrid_filter_first(spark, sf_dir):
    return vc.hybrid(product_graph(spark, sf_dir), vectors(spark, sf_dir), probe(), 10, tags=["red"], category="ECONOMY", max_price=990.0, exclude_allergens=["NATION_3"])


@query(G + f""", pool as (
  select product_id, item_name, price, quality_score, brand, category from products p where price <= 990.0
    and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'gear')
    and not exists (select 1 from allergens a where a.product_id = p.product_id and a.allergen = 'nation_5')
  order by quality_score desc nulls first, product_id limit 100
), scored as (
  select pool.*, coalesce(s.semantic, 0.5::double) as semantic from pool left join (select vec_id, {COSINE} as semantic from embeddings) s on vec_id = product_id
)
select *, round_even(0.6::double * semantic + 0.4::double * quality_score / 100.0::double, 3) as score from scored order by score desc, product_id limit 10""")
def flagship(spark, sf_dir):
    """Gear under a price without an allergen, ranked by meaning and quality."""
    return vc.hybrid(product_graph(spark, sf_dir), vectors(spark, sf_dir), probe(), 10, tags=["gear"], max_price=990.0, exclude_allergens=["NATION_5"])


# ---- parsing -------------------------------------------------------------------------------------------------------
@query("select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title from pages")
def parse_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.found(F.col("html"), r"<title>([^<]*)</title>").alias("title"))


@query("select page_id, len(regexp_extract_all(html, '<p>([^<]*)', 1)) as n_blocks, contains(html, '<nav>') as has_nav, length(html) as n_chars from pages")
def parse_blocks(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(tx.found_all(h, "<p>([^<]*)")).cast("long").alias("n_blocks"), F.contains(h, F.lit("<nav>")).alias("has_nav"), F.length(h).cast("long").alias("n_chars"))


LISTING = r"concat('Item Name: ', p_name, chr(10), 'Bullet Point 1: made by ', p_brand, chr(10), 'Bullet Point 2: ', p_type, chr(10), 'Product Description: a ', p_name, chr(10), 'Value: ', cast(p_size as varchar), chr(10), 'Unit: ounce')"


def listings(spark, sf_dir) -> DataFrame:
    c = F.concat(F.lit("Item Name: "), "p_name", F.lit("\nBullet Point 1: made by "), "p_brand", F.lit("\nBullet Point 2: "), "p_type", F.lit("\nProduct Description: a "), "p_name", F.lit("\nValue: "), F.col("p_size").cast("string"), F.lit("\nUnit: ounce"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("sample_id"), c.alias("catalog_content"), F.col("p_retailprice").alias("price"), F.col("p_name"), F.col("p_size"))


@query("select p_partkey as sample_id, p_name as item_name, 2 as n_bullets, 'a ' || p_name as description, p_size::double as value, 'ounce' as unit from part")
def parse_listing(spark, sf_dir):
    p = tx.parse_listing(F.col("catalog_content"))
    return listings(spark, sf_dir).select("sample_id", p.alias("p")).select("sample_id", "p.item_name", F.size("p.bullets").alias("n_bullets"), "p.description", "p.value", "p.unit")


@query("select regexp_extract(text, '(\\S+)', 1) as value, count(*) as n from documents where regexp_matches(text, '\\S') group by 1 order by 2 desc, 1 limit 20")
def brand_candidate(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "documents"), tx.brand_candidate(F.col("text")), 20)


KEYWORDS = {"license": ["license", "copyright", "permission"], "contact": ["@", "phone"], "question": ["?"]}
_KEY = {k: " or ".join(f"contains(lower(text), '{w}')" for w in ws) for k, ws in KEYWORDS.items()}


@query(f"select doc_id, case {' '.join(f'''when {c} then '{k}' ''' for k, c in _KEY.items())} else 'Unknown' end as category from documents")
def keyword_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_category(F.col("text"), KEYWORDS).alias("category"))


SCAN = ["the", "and", "not", "zzz"]


@query("select v as value, count(*) as n from documents, (values ('the'), ('and'), ('not'), ('zzz')) t(v) where contains(lower(text), v) group by 1")
def keyword_scan(spark, sf_dir):
    return profile.list_counts(table(spark, sf_dir, "documents"), tx.scan(F.col("text"), SCAN))


@query("select case when n_chars <= 150 then 'bare' when n_chars <= 600 then 'medium' else 'rich' end as tier, count(*) as n from documents group by 1")
def text_tier(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(tx.text_tier(F.col("n_chars")).alias("tier")).agg(F.count("*").alias("n"))


@query("""select page_id, case when n >= 5 and t <> '' then 'rich' when n >= 1 then 'medium' else 'bare' end as tier
from (select page_id, len(regexp_extract_all(html, '<p>', 0)) as n, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as t from pages)""")
def content_tier(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", tx.content_tier(F.size(F.regexp_extract_all(h, F.lit("<p>"), 0)), tx.found(h, r"<title>([^<]*)</title>")).alias("tier"))


@query("""select event_id, case when event_id % 3 = 0 then '{"k": 1}' else props end as clean from events""")
def strip_fence(spark, sf_dir):
    answer = F.when(F.col("event_id") % 3 == 0, F.lit('```json\n{"k": 1}\n```')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tx.strip_fence(answer).alias("clean"))


# ---- normalisation -------------------------------------------------------------------------------------------------
SPELLED = ["Ounces", "fluid oz", "LBS", "nothing", " kg "]


@query("""select p_partkey, case p_partkey % 5 when 0 then 'oz' when 1 then 'fl oz' when 2 then 'lb' when 4 then 'kg' end as unit from part""")
def normalize_alias(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, SPELLED)), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", nz.unit(raw, fuzzy=False).alias("unit"))


@query("select p_partkey, case when p_partkey % 2 = 0 then ['vegan', 'gluten-free'] else ['sugar-free'] end as tags from part where p_partkey % 3 <> 0 union all select p_partkey, cast(null as varchar[]) from part where p_partkey % 3 = 0")
def normalize_list(spark, sf_dir):
    even = F.array(*map(F.lit, ["Plant-Based", "GLUTEN FREE", "vegan", "other"]))
    odd = F.array(*map(F.lit, ["unsweetened", "No Sugar"]))
    i = F.col("p_partkey")
    raw = F.when(i % 3 == 0, F.array(F.lit("other"))).when(i % 2 == 0, even).otherwise(odd)
    return table(spark, sf_dir, "part").select("p_partkey", nz.dietary_tags(raw, fuzzy=False).alias("tags"))


@query("select p_partkey, case when p_size > 1 then p_size end as pack from part")
def pack_size(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nz.pack_size(F.concat(F.col("p_name"), F.lit(" Pack of "), F.col("p_size").cast("string"))).alias("pack"))


@query(r"""with c as (select doc_id, rtrim(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^\x20-\x7E]', '', 'g'), '\s{2,}', ' ', 'g'), '.,;:') as c from documents)
select doc_id, md5(case when length(c) >= 2 then c end) as clean_md5 from c""")
def clean_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(nz.clean_name(F.col("text"))).alias("clean_md5"))


@query("""select p_partkey, cast(null as varchar) as unit, case p_partkey % 3 when 0 then 'Snacks & Candy' when 1 then 'Beverages' else 'Coffee & Tea' end as category,
case p_partkey % 3 when 0 then 'O''Neil Foods' when 1 then 'ACME' else 'Red Bull' end as brand from part""")
def normalize_fuzzy(spark, sf_dir):
    """Values that similarity must resolve or leave: units too far from any, categories in another order, brands."""
    words = {"u": ["ounzes", "kilograms.", "xx"], "c": ["Snacks Candy &", "Beverage", "Tea & Coffee"], "b": ["o'neil foods", "ACME", "red bull"]}
    pick = lambda k: F.get(F.array(*map(F.lit, words[k])), (F.col("p_partkey") % 3).cast("int"))
    adapter = vocab.Adapter(brand_aliases={"redbull": "Red Bull"})
    return table(spark, sf_dir, "part").select("p_partkey", nz.unit(pick("u")).alias("unit"), nz.category(pick("c")).alias("category"), nz.brand(pick("b"), adapter).alias("brand"))


# ---- validation and scores -----------------------------------------------------------------------------------------
@query("""select event_type, count(*) as n, sum(case when k is null then 1 else 0 end) as bad, round(avg(k), 4) as avg_k
from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1""")
def json_parse_validate(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("k").isNull(), 1).otherwise(0)).alias("bad"), F.round(F.avg("k"), 4).alias("avg_k"))


@query("select p_partkey, case when p_size > 1 then round_even(p_retailprice / p_size, 4) end as unit_price from part")
def derived_unit_price(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.unit_price(F.col("p_retailprice"), F.col("p_size")).alias("unit_price"))


@query("select p_partkey, cast(15 + 10 + 10 + 5 + (case when p_size > 1 then 5 else 0 end) + 5 + (case when p_size >= 25 then 15 else 8 end) + 8 as integer) as quality from part")
def quality_score_a(spark, sf_dir):
    nothing, size = F.lit(None).cast("string"), F.col("p_size")
    bullets = F.transform(F.sequence(F.lit(1), F.when(size >= 25, 5).otherwise(1)), lambda i: i.cast("string"))
    q = sc.listing_quality(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_retailprice"), F.when(size > 1, size.cast("double")), F.lit("oz"), F.lit(None).cast("int"), nothing, bullets, nothing, F.split("p_name", " "), F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("quality"))


@query("select p_partkey, cast(floor((6 + (case when p_size > 1 then 1 else 0 end)) / 9.0::double * 40) + floor(least(p_size / 50.0::double, 1.0) * 40) + 20 as integer) as quality from part")
def quality_score_b(spark, sf_dir):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    q = sc.record_quality(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.when(size > 1, size), F.lit(""), F.col("p_retailprice"), F.split("p_name", " "), none, size / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("quality"))


def answers(spark, sf_dir) -> DataFrame:
    """Extraction answers, good and bad, that exercise every rule of an entity."""
    i, text = F.col("p_partkey"), lambda *v: F.array(*map(F.lit, v))
    bullets = F.concat(F.transform(F.sequence(F.lit(1), i % 6 + 1), lambda k: F.concat(F.lit(" point "), k.cast("string"))), text(" "))
    record = F.struct(
        F.when(i % 13 != 0, F.col("p_name")).alias("item_name"),
        F.col("p_brand").alias("brand"),
        F.when(i % 3 == 0, "Beverages").when(i % 3 == 1, "No such").alias("category"),
        F.col("p_size").cast("double").alias("quantity_value"),
        F.when(i % 4 == 0, "Ounces").when(i % 4 == 1, "L").otherwise("xyz").alias("quantity_unit"),
        F.when(i % 9 == 0, 6).alias("pack_size"),
        F.when(i % 5 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(i % 2 == 0, text("Plant-Based", "usda organic", "vegan")).alias("dietary_tags"),
        F.when(i % 4 == 0, text("Eggs", "milk", "bogus")).alias("allergen_list"),
        F.when(i % 4 == 1, "a description").alias("description"),
        F.when(i % 6 != 5, bullets).otherwise(text(" ")).alias("bullet_points"),
        text("sugar ", " ").alias("ingredients"),
        F.when(i % 3 == 0, F.struct(F.lit("box").alias("packaging_type"), F.lit(" Red").alias("packaging_color"))).when(i % 3 == 1, F.struct(F.lit(None).cast("string").alias("packaging_type"), F.lit(" ").alias("packaging_color"))).alias("visual"),
        F.when(i % 7 == 0, 0.5).otherwise(0.9).alias("extraction_confidence"),
    )
    answer = F.when(i % 11 == 0, F.lit("{no json")).when(i % 4 == 3, F.concat(F.lit("```json\n"), F.to_json(record), F.lit("\n```"))).otherwise(F.to_json(record))
    return table(spark, sf_dir, "part").select(i.alias("product_id"), answer.alias("answer"))


_STEP = "case when p_partkey % 11 = 0 then 'json_parse' when p_partkey % 5 = 0 or p_partkey % 13 = 0 then 'pydantic' when p_partkey % 7 = 0 then 'confidence' end"


@query(f"select coalesce(step, 'ok') as step, count(*) as n from (select {_STEP} as step from part) group by 1")
def dead_letter_split(spark, sf_dir):
    v = validate.validate(answers(spark, sf_dir), "answer", "product_id", fuzzy=False)
    return v.groupBy(F.coalesce("step", F.lit("ok")).alias("step")).agg(F.count("*").alias("n"))


@query(f"""with r as (
  select p_partkey as product_id, {_STEP} as step, p_partkey as i, p_size as size, p_retailprice as price, p_brand as brand, p_name as name,
         case when p_partkey % 6 = 5 then 0 else p_partkey % 6 + 1 end as bullets from part
), d as (
  select *, case i % 3 when 0 then 'Beverages' when 1 then 'Unknown' end as category, case i % 4 when 0 then 'oz' when 1 then 'L' end as unit, case when i % 9 = 0 then 6 end as pack,
         case when i % 2 = 0 then ['vegan', 'organic'] end as tags, case when i % 4 = 0 then ['egg', 'milk'] end as allergens, case when i % 4 = 1 then 'a description' end as description from r
)
select product_id, step,
  case step when 'json_parse' then 'not a JSON object' when 'confidence' then 'extraction_confidence=0.5 is below minimum 0.6'
    when 'pydantic' then concat_ws(chr(10), case when i % 13 = 0 then '  - item_name: field required' end, case when i % 5 = 0 then '  - price: must be at least 0' end) end as error,
  case when step is null then least(100, 15 + 10 + (category is not null)::int * 10 + 5 + (size <> 0)::int * 5 + (unit is not null)::int * 5 + (pack is not null)::int * 5 + (i % 3 = 0)::int * 5
    + case when bullets >= 5 then 15 when bullets >= 1 then 8 else 0 end + (description is not null)::int * 10 + (tags is not null)::int * 8 + (allergens is not null)::int * 7)::int end as quality_score,
  case when step is null then case when bullets >= 5 and description is not null then 'rich' when bullets >= 1 then 'medium' else 'bare' end end as content_tier,
  case when step is null and pack > 1 then round_even(price / pack, 4) end as unit_price,
  case when step is null then name end as item_name, case when step is null then brand end as brand, case when step is null then category end as category, case when step is null then unit end as quantity_unit,
  case when step is null then tags end as dietary_tags, case when step is null then allergens end as allergen_list, case when step is null and tags is not null then true end as is_organic, case when step is null and tags is not null then false end as is_kosher,
  case when step is null and bullets > 0 then ['point ' || k for k in range(1, bullets + 1)] end as bullet_points, case when step is null then ['sugar'] end as ingredients,
  case when step is null then case i % 3 when 0 then 'box' when 1 then 'unknown' end end as packaging_type, case when step is null and i % 3 = 0 then 'red' end as packaging_color
from d""")
def validate_entities(spark, sf_dir):
    e = F.col("entity")
    names = ["quality_score", "content_tier", "unit_price", "item_name", "brand", "category", "quantity_unit", "dietary_tags", "allergen_list", "is_organic", "is_kosher", "bullet_points", "ingredients"]
    v = validate.validate(answers(spark, sf_dir), "answer", "product_id", fuzzy=False)
    return v.select("product_id", "step", "error", *(e[n].alias(n) for n in names), e["visual"]["packaging_type"].alias("packaging_type"), e["visual"]["packaging_color"].alias("packaging_color"))


@query("""select p_partkey as product_id, case when p_partkey % 4 = 0 then 'Beverages' when p_partkey % 4 = 2 then 'Unknown' else p_type end as category,
case when p_partkey % 2 = 0 then ['vegan'] else string_split(p_name, ' ') end as dietary_tags from part""")
def verify_merge(spark, sf_dir):
    i = F.col("p_partkey").alias("product_id")
    base = table(spark, sf_dir, "part").select(i, F.col("p_type").alias("category"), F.split("p_name", " ").alias("dietary_tags"))
    fixes = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(i, F.when(F.col("p_partkey") % 4 == 0, "Beverages").otherwise("No such").alias("category"), F.array(F.lit("vegan"), F.lit("bogus")).alias("dietary_tags"))
    return validate.merge_corrections(base, fixes)


# ---- weak supervision ----------------------------------------------------------------------------------------------
RULES = [("license", r"licen[sc]e|copyright", 1), ("email", r"[a-z0-9.]+@[a-z0-9.]+", 1), ("junk", r"!!|###|\*\*\*", 0), ("the", r"\bthe\b", 1)]
_VOTE = [f"case when regexp_matches(lower(text), '{p}') then {v} else -1 end" for _, p, v in RULES]


def document_labelers() -> list[weak.Labeler]:
    return [weak.Labeler(n, weak.matches(F.col("text"), p), v) for n, p, v in RULES]


def voted(spark, sf_dir) -> DataFrame:
    return weak.votes(table(spark, sf_dir, "documents").select("doc_id", "text"), document_labelers()).select("doc_id", "votes")


_VOTED = f"with v as (select doc_id, [{', '.join(_VOTE)}]::integer[] as votes from documents) "


@query(_VOTED + "select doc_id, votes from v")
def lf_votes(spark, sf_dir):
    return voted(spark, sf_dir)


def _analysis(j: int) -> str:
    own = f"votes[{j + 1}]"
    rest = [f"votes[{i + 1}]" for i in range(len(RULES)) if i != j]
    over = " or ".join(f"{r} <> -1" for r in rest)
    conf = " or ".join(f"({r} <> -1 and {r} <> {own})" for r in rest)
    return f"select '{RULES[j][0]}' as name, round(avg(({own} <> -1)::int), 6) as coverage, round(avg(({own} <> -1 and ({over}))::int), 6) as overlaps, round(avg(({own} <> -1 and ({conf}))::int), 6) as conflicts from v"


@query(_VOTED + " union all ".join(_analysis(j) for j in range(len(RULES))))
def lf_analysis(spark, sf_dir):
    out = weak.analyze(voted(spark, sf_dir), [n for n, _, _ in RULES])
    return out.select("name", *(F.round(c, 6).alias(c) for c in ("coverage", "overlaps", "conflicts")))


@query(_VOTED + """, c as (select doc_id, (votes[1] = 0)::int + (votes[2] = 0)::int + (votes[3] = 0)::int + (votes[4] = 0)::int as n0, (votes[1] = 1)::int + (votes[2] = 1)::int + (votes[3] = 1)::int + (votes[4] = 1)::int as n1 from v)
select doc_id, case when n0 = 0 and n1 = 0 then null when n0 >= n1 then 0 else 1 end as label from c""")
def majority_label(spark, sf_dir):
    return voted(spark, sf_dir).select("doc_id", weak.majority(F.col("votes"), 2).alias("label"))


@query("select vec_id, case when abs(embedding[1]::double) * 4 >= 0.85 then 'auto_accept' when abs(embedding[1]::double) * 4 >= 0.5 then 'review' else 'auto_reject' end as status from embeddings")
def label_status(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sc.label_status(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4).alias("status"))


@query("""select status, count(*) as n, round(count(*) / (select count(*) from embeddings)::double, 6) as share from (select case when abs(embedding[1]::double) * 4 >= 0.85 then 'auto_accept' when abs(embedding[1]::double) * 4 >= 0.5 then 'review' else 'auto_reject' end as status from embeddings) group by 1""")
def label_distribution(spark, sf_dir):
    return weak.status_summary(label_status(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query()
def weak_label_pipeline(spark, sf_dir):
    """Thirty-one labeling functions, label models and statuses over listings."""
    catalog = listings(spark, sf_dir).select("sample_id", "catalog_content", "price", F.lit("https://example.com/tea.jpg").alias("image_link"))
    return weak.to_csv_columns(weak.run_pipeline(catalog))


# ---- active learning -----------------------------------------------------------------------------------------------
_P = "least(abs(embedding[1]::double) * 4, 1.0)"


def weak_labels(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    p = lambda i: F.least(F.abs(F.get(e, F.lit(i)).cast("double")) * 4, F.lit(1.0))
    a, b = sc.label_status(p(1)), sc.label_status(p(2))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), p(0).alias("category_prob"), sc.label_status(p(0)).alias("category_status"),
        F.lit("a|b").alias("dietary_tags"), F.when(F.col("vec_id") % 10 == 0, "broken").otherwise(F.to_json(F.create_map(F.lit("a"), p(1), F.lit("b"), p(2)))).alias("tag_probs"),
        F.to_json(F.create_map(F.lit("a"), a, F.lit("b"), b)).alias("tag_statuses"),
    )


_ST = "case when {p} >= 0.85 then 'auto_accept' when {p} >= 0.5 then 'review' else 'auto_reject' end"
_H = "(case when {p} > 0 and {p} < 1 then -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) else 0.0 end)"
_W = f"""with p as (select vec_id as sample_id, 'c' || label as category, {_P} as p0, {_P.replace('[1]', '[2]')} as p1, {_P.replace('[1]', '[3]')} as p2 from embeddings
), s as (select *, {_ST.format(p='p0')} as s0, {_ST.format(p='p1')} as s1, {_ST.format(p='p2')} as s2 from p
), c as (select * from s where s0 = 'review'
), n as (select category, 1 / ln(1 + count(*)) as r from c group by 1
), f as (select c.*, r / (select max(r) from n) as rarity,
  case when sample_id % 10 = 0 then {_H.format(p='p0')} else ({_H.format(p='p1')} + {_H.format(p='p2')}) / 2 end as entropy,
  (s1 = 'auto_accept')::int + (s2 = 'auto_accept')::int as yes, (s1 = 'auto_reject')::int + (s2 = 'auto_reject')::int as no from c join n using (category)
), d as (select *, case when yes + no > 0 then 2.0::double * least(yes, no) / (yes + no) else 0.0::double end as dis from f)
"""


@query(_W + "select sample_id, round(entropy, 3) as entropy, round(dis, 3) as disagreement, round(rarity, 3) as rarity from d")
def uncertainty_scores(spark, sf_dir):
    s = active.score(active.candidates(weak_labels(spark, sf_dir)))
    c = active.candidates(weak_labels(spark, sf_dir))
    raw = active.with_rarity(c).select("sample_id", F.round(sc.mean_entropy(F.col("tag_probs"), F.col("category_prob")), 3).alias("entropy"), F.round(sc.disagreement(F.col("tag_statuses")), 3).alias("disagreement"), F.round("rarity_score", 3).alias("rarity"))
    return raw.join(s.select("sample_id"), "sample_id", "left_semi")


@query(_W + f""", q as (select sample_id, category, p0 as category_prob, s0 as category_status, round_even(entropy, 4) as e, round_even(dis, 4) as f, round_even(rarity, 4) as r, round_even(0.5 * entropy + 0.3 * dis + 0.2 * rarity, 4) as u from d order by u desc, sample_id limit 25
), w as (select *, case when 0.5 * e >= 0.3 * f and 0.5 * e >= 0.2 * r then 'e' when 0.3 * f >= 0.2 * r then 'd' else 'r' end as top from q)
select sample_id, p_name as item_name, category, round(category_prob, 6) as category_prob, category_status, 'a|b' as dietary_tags, u as uncertainty_score, e as entropy_score, f as disagreement_score, r as rarity_score,
  case top when 'e' then 'High model uncertainty (entropy=#)' when 'd' then 'LF disagreement detected (score=#)' else 'Underrepresented category (rarity=#)' end
  || case when top <> 'e' and e > 0.5 then '; also uncertain (entropy=#)' else '' end || case when top <> 'd' and f > 0.3 then '; LF conflict present' else '' end || case when top <> 'r' and r > 0.7 then '; rare category' else '' end as reason
from w left join part on p_partkey = sample_id""")
def review_queue(spark, sf_dir):
    """All columns; numbers in the reason, which are those of the columns to two places, are masked."""
    queue = active.review_queue(weak_labels(spark, sf_dir), listings(spark, sf_dir), 25)
    return queue.withColumns({"reason": F.regexp_replace("reason", r"=[0-9.]+", "=#"), "category_prob": F.round("category_prob", 6)})


# ---- duplicates ----------------------------------------------------------------------------------------------------
@query("select doc_id from documents d where not exists (select 1 from documents e where lower(trim(e.text)) = lower(trim(d.text)) and e.lang = d.lang and e.doc_id < d.doc_id)")
def dedup_exact(spark, sf_dir):
    key = dedup.exact_key(F.col("text"), F.col("lang"), F.lit(0), F.lit(None))
    return dedup.exact(table(spark, sf_dir, "documents"), key, "doc_id")[0].select("doc_id")


@query("""with k as (select doc_id, min(doc_id) over (partition by lower(trim(text)), lang) as original from documents)
select doc_id as duplicate, original, 100.0::double as similarity from k where original < doc_id""")
def dedup_pairs_exact(spark, sf_dir):
    key = dedup.exact_key(F.col("text"), F.col("lang"), F.lit(0), F.lit(None))
    return dedup.exact(table(spark, sf_dir, "documents"), key, "doc_id")[1]


def fuzzy_names(spark, sf_dir) -> DataFrame:
    """Names that differ a little: a word, a brand and a number."""
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(i.alias("pos"), F.concat_ws(" ", "p_name", "p_type", F.lower("p_brand"), F.floor(i / 7).cast("string")).alias("item_name"))


@query("""with recursive named as (
  select p_partkey as pos, array_to_string(list_sort(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || cast(p_partkey // 7 as bigint)), ' ')), ' ') as s from part
), names as (
  select s, min(pos) as pos, length(s) as n from named group by s
), pairs as (
  select a.s as x, b.s as y, a.n + b.n as total from names a join names b on a.s < b.s and abs(a.n - b.n) <= 0.08 * (a.n + b.n) + 1e-9
  where levenshtein(a.s, b.s) <= 0.08 * (a.n + b.n) + 1e-9
), lengths as (  -- of the longest common subsequence of the first i characters of x and each start of y
  select x, y, total, 0 as i, list_transform(range(length(y) + 1), lambda j: 0) as row from pairs
  union all
  select x, y, total, i + 1, list_transform(range(length(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k:
    case when k > 0 and substr(y, k, 1) = substr(x, i + 1, 1) then row[k] + 1 else row[k + 1] end))) from lengths where i < length(x)
), scored as (
  select x, y, 200.0 * row[length(y) + 1] / total as similarity from lengths where i = length(x) and 200.0 * row[length(y) + 1] / total >= 92
), options as (
  select x as s, y as t, similarity from scored union all select y, x, similarity from scored union all select s, s, 100.0 from names
)
select n.pos as duplicate, min(t.pos) as original, arg_min(o.similarity, t.pos)::double as similarity
from named n join options o on o.s = n.s join names t on t.s = o.t where t.pos < n.pos group by n.pos""")
def dedup_fuzzy(spark, sf_dir):
    """Similar names, each with its first earlier one."""
    return dedup.similar(fuzzy_names(spark, sf_dir), "item_name", "pos")


# ---- data sets -----------------------------------------------------------------------------------------------------
def messages(spark, sf_dir) -> DataFrame:
    m = F.struct("turn", "role", F.col("text").alias("content"))
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return per.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("select conv_id from conversations group by 1 having count(distinct role) filter (where role in ('system', 'user', 'assistant')) = 3")
def roles_complete(spark, sf_dir):
    return messages(spark, sf_dir).where(datasets.roles_complete(F.col("messages"))).select("conv_id")


@query("select conv_id, arg_max(text, turn) filter (where role = 'assistant') as answer from conversations group by 1")
def last_assistant(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", datasets.last_of_role(F.col("messages"), "assistant").alias("answer"))


@query("select conv_id, cast(floor(sum(length(text)) / 4.0) as bigint) as tokens from conversations group by 1")
def token_estimate(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", datasets.token_estimate(F.col("messages")).alias("tokens"))


@query("select lang, count(*) as n from (select lang from documents where n_chars > 500 union all select d.lang from documents d join labels l using (doc_id) where l.quality = 1) group by 1")
def union_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("messages", F.array(datasets.message("user", F.col("lang"))))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select(F.lit("high_conf").alias("bucket"), F.col("lang").alias("prediction"), F.col("text").alias("catalog_content"), "messages")
    both = datasets.merge(docs.where("n_chars > 500"), good, F.col("messages"))
    return both.groupBy(F.get("messages", F.lit(0))["content"].alias("lang")).agg(F.count("*").alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return datasets.resume(table(spark, sf_dir, "documents"), done, "doc_id").select("doc_id")


@query("""with labelled as (select d.doc_id, d.lang, l.quality from documents d join labels l using (doc_id) where l.toxic = 0
), c as (select lang, count(*) as c from labelled group by 1
), q as (select lang, c, greatest(10, 60 * c // sum(c) over ()) as q from c
), s as (select lang, case when sum(q) over () > 60 then greatest(10, cast(floor(q * 60 / sum(q) over ()) as bigint)) else q end as quota from q
), r as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as k from labelled
), part as (select doc_id from r join s using (lang) where k <= quota
), rest as (select doc_id from documents where doc_id not in (select doc_id from part) order by md5('42:' || doc_id), doc_id limit greatest(0, 60 - (select count(*) from part)))
select doc_id from part union all select doc_id from rest""")
def stratified_sample(spark, sf_dir):
    """60 documents in proportion to the languages of those labelled, filled up from the others."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    accepted = labels.select("doc_id", "lang", F.when(F.col("toxic") == 0, "auto_accept").otherwise("review").alias("category_status"))
    return datasets.stratified_sample(table(spark, sf_dir, "documents").select("doc_id"), accepted, 60, "doc_id", "lang")


@query("""with r as (select doc_id, n_chars, case when n_chars <= 150 then 'bare' when n_chars <= 600 then 'medium' else 'rich' end as tier from documents where doc_id not in (select doc_id from labels where toxic = 1)
), k as (select *, row_number() over (partition by tier order by md5('42:' || doc_id), doc_id) as n from r)
select doc_id, tier from k where n <= case tier when 'rich' then 30 when 'medium' then 15 else 5 end""")
def tier_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.text_tier(F.col("n_chars")).alias("tier"))
    done = table(spark, sf_dir, "labels").where("toxic = 1")
    return datasets.tier_sample(docs, "tier", {"rich": 30, "medium": 15, "bare": 5}, "doc_id", done=done)


@query("""with r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as k, count(*) over () as n from documents)
select doc_id, case when k <= floor(n * 0.8) then 'train' else 'val' end as split from r""")
def exact_split(spark, sf_dir):
    return datasets.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _picked(options: str, salt: str) -> str:
    return f"[{options}][(('0x' || substr(md5('42:{salt}:' || i), 1, 8))::bigint % len([{options}])) + 1]"


def _hashed(salt: str) -> str:
    return f"('0x' || substr(md5('42:{salt}:' || i), 1, 8))::bigint"


@query(f"""with c as (select lang as category, count(*) as n from documents where lang is not null group by 1
), r as (select category, row_number() over (order by category) - 1 as k, floor(sum(n) over () * 0.2)::bigint as total, greatest(20, floor(sum(n) over () * 0.2)::bigint // count(*) over ()) as each from c
), g as (select category || '-' || unnest(range(least(each, total - k * each))) as i, category from r where total > k * each
), s as (select 'syn-' || i as sample_id, {_picked("'Acme', 'Zest'", 'brand')} || ' ' || {_picked("'organic', 'pure'", 'adjective')} || ' ' || {_picked("'juice', 'soda', 'almonds'", 'product')} as item_name, category,
  ({_hashed('value')} % 640 + 10) / 10.0::double as quantity_value, {_picked("'oz', 'ct'", 'unit')} as quantity_unit, ({_hashed('price')} % 4800 + 199) / 100.0::double as price, [{_picked("'vegan', 'kosher'", 'tag')}] as dietary_tags from g)
select *, 'Item Name: ' || item_name || chr(10) || 'Bullet Point 1: ' || dietary_tags[1] || chr(10) || 'Value: ' || quantity_value || chr(10) || 'Unit: ' || quantity_unit as catalog_content from s""")
def synthetic_listings(spark, sf_dir):
    """Generated listings with true records: a fifth as many as there are real documents, by language."""
    quotas = datasets.quotas_of(table(spark, sf_dir, "documents"), "lang", 0.2, 20)
    return datasets.listings_of(quotas, ["organic", "pure"], ["juice", "soda", "almonds"], ["Acme", "Zest"], ["oz", "ct"], ["vegan", "kosher"])


@query("select count(*) as lines, sum((event_id % 4 = 0)::int) as parse_errors, sum((event_id % 4 <> 0)::int) as total, sum((event_id % 4 = 1)::int) as bad_messages, sum((event_id % 4 = 2)::int) as bad_answers from events")
def structure_report(spark, sf_dir):
    i = F.col("event_id") % 4
    full = lambda answer: F.to_json(F.struct(F.array(datasets.message("system", F.lit("s")), datasets.message("user", F.lit("u")), datasets.message("assistant", answer)).alias("messages")))
    line = F.when(i == 0, "{oops").when(i == 1, '{"messages": [{"role": "user", "content": "x"}]}').when(i == 2, full(F.lit("not json"))).otherwise(full(F.col("props")))
    return datasets.structure_report(table(spark, sf_dir, "events").select(line.alias("value")))


# ---- evaluation ----------------------------------------------------------------------------------------------------
_J = "from part a join part b on b.p_partkey = a.p_partkey + 1"


def pairs(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rec = lambda n: F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("quantity_value"), F.split("p_name", " ").alias("dietary_tags")).alias(n)
    a = part.select(F.col("p_partkey").alias("i"), rec("prediction"))
    return a.join(part.select((F.col("p_partkey") - 1).alias("i"), rec("ground_truth")), "i")


_S = f"""select a.p_partkey as i, (lower(a.p_brand) = lower(b.p_brand))::int::double as brand, (lower(a.p_type) = lower(b.p_type))::int::double as category,
(abs(a.p_retailprice - b.p_retailprice) / b.p_retailprice <= 0.05)::int::double as price, (case when b.p_size = 0 then a.p_size = 0 else abs(a.p_size - b.p_size) / b.p_size::double <= 0.05 end)::int::double as quantity_value,
len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::double / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) as dietary_tags {_J}"""
SCORED = ["brand", "category", "price", "quantity_value", "dietary_tags"]


@query(f"select i, round((brand + category + price + quantity_value + dietary_tags) / 5, 6) as overall_score, round(dietary_tags, 6) as jaccard from ({_S})")
def score_examples(spark, sf_dir):
    s = evaluate.score_fields(pairs(spark, sf_dir), SCORED)
    return s.select("i", F.round("overall_score", 6).alias("overall_score"), F.round(F.col("field_scores")["dietary_tags"], 6).alias("jaccard"))


@query(" union all ".join(f"select '{f}' as field, round(avg({f}), 6) as accuracy, 0.9::double as target, avg({f}) >= 0.9 as passed from ({_S})" for f in SCORED))
def field_accuracy(spark, sf_dir):
    return evaluate.field_accuracy(evaluate.score_fields(pairs(spark, sf_dir), SCORED)).withColumn("accuracy", F.round("accuracy", 6))


@query("""select event_type as field, round(avg(k), 3) as avg_score, round(avg((k >= 4)::int) * 100, 1) as pct_4_or_5, round(avg((k = 3)::int) * 100, 1) as pct_3, round(avg((k <= 2)::int) * 100, 1) as pct_1_or_2,
sum((k = 5 and user_id % 2 = 0)::int) as false_negatives from (select event_type, user_id, event_id % 5 + 1 as k from events) group by 1""")
def judge_summary(spark, sf_dir):
    long = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), (F.col("event_id") % 5 + 1).alias("score"), (F.col("user_id") % 2 == 0).alias("differs"))
    return evaluate.judge_summary(long)


@query("select round(avg((low >= 4)::int) * 100, 1) as overall_semantic_accuracy from (select floor(event_id / 3) as e, min(event_id % 7) as low from events group by 1)")
def semantic_accuracy(spark, sf_dir):
    return evaluate.semantic_accuracy(table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("example"), (F.col("event_id") % 7).alias("score")))


@query("select event_type as system, user_id % 3 as type, sum((value > 10)::int) as passed, count(*) as total, round(avg(user_id % 10), 2) as avg_latency from events group by 1, 2")
def bench_score(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), (F.col("user_id") % 3).alias("type"), (F.col("value") > 10).alias("passed"), (F.col("user_id") % 10).alias("latency"))
    return evaluate.benchmark_summary(runs)


# ---- profiles ------------------------------------------------------------------------------------------------------
@query("select count(n_chars) as n, min(n_chars)::double as min, max(n_chars)::double as max, round(avg(n_chars), 4) as mean, quantile_cont(n_chars::double, 0.5) as median, round(stddev_samp(n_chars), 4) as std from documents")
def profile_describe(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "documents"), F.col("n_chars")).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("select lang as value, count(*) as n from documents group by 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "documents"), F.col("lang"))


@query("select count(*) - count(doc_id) as doc_id, count(*) - count(text) as text, count(*) - count(lang) as lang, count(*) - count(source) as source, count(*) - count(n_chars) as n_chars from documents")
def null_counts(spark, sf_dir):
    return profile.null_counts(table(spark, sf_dir, "documents"))


@query("select least(floor((least(greatest(n_chars, 0), 5000) - 0) / 100.0)::int, 49) as bin, least(floor(least(n_chars, 5000) / 100.0), 49) * 100.0 as low, count(*) as n from documents group by 1, 2")
def histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), 50, 0, 5000)


@query("select doc_id from documents where n_chars < 500 intersect select doc_id from labels where quality = 0")
def id_intersect(spark, sf_dir):
    return profile.in_both(table(spark, sf_dir, "documents").where("n_chars < 500"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query(" union all ".join(f"select '{k}' as category, sum(({c})::int) as n from documents" for k, c in _KEY.items()))
def coverage(spark, sf_dir):
    return profile.keyword_coverage(table(spark, sf_dir, "documents"), F.col("text"), KEYWORDS)


@query("select case when short and poor then 'human_review' when poor then 'text_only' else 'multimodal' end as route, count(*) as n from (select n_chars < 500 as short, doc_id % 10 = 0 as poor from documents) group by 1")
def routing(spark, sf_dir):
    r = profile.route(F.col("n_chars") < 500, F.col("doc_id") % 10 == 0)
    return table(spark, sf_dir, "documents").groupBy(r.alias("route")).agg(F.count("*").alias("n"))


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 100")
def seeded_draw(spark, sf_dir):
    return profile.draw(table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


# ---- streams -------------------------------------------------------------------------------------------------------
@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 4) as avg_value from events group by 1, 2")
def windowed_events(spark, sf_dir):
    from granary.streaming import events

    out = events.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("avg_value", 4).alias("avg_value"))


# ---- reports -------------------------------------------------------------------------------------------------------
@query("""with k as (select doc_id, min(doc_id) over (partition by lower(trim(text)), lang) as original from documents)
select 'exact' as match_type, count(*) as n, 100.0::double as avg_similarity from k where original < doc_id""")
def dedup_summary(spark, sf_dir):
    return dedup.summary(dedup_pairs_exact(spark, sf_dir).withColumn("match_type", F.lit("exact")))


@query("select event_id, round(avg(value) over (partition by event_type order by event_id rows between 9 preceding and current row), 4) as recent_mean from events")
def recent_mean(spark, sf_dir):
    return evaluate.recent_mean(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_id", F.round("recent_mean", 4).alias("recent_mean"))


@query("select value, count(*) as n from (select json_extract_string(props, '$.k') as value from events) where value is not null group by 1")
def answer_histogram(spark, sf_dir):
    m = F.array(datasets.message("assistant", F.col("props")))
    return datasets.answer_histogram(table(spark, sf_dir, "events").select(m.alias("messages")), "k")


@query("select event_type, case when event_id % 2 = 0 then [event_type] else cast([] as varchar[]) end as tags, event_id from events")
def null_lists(spark, sf_dir):
    tags = F.when(F.col("event_id") % 2 == 0, F.array("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", tx.null_lists(tags).alias("tags"))


@query("select cast(floor(quality / 10) * 10 as bigint) as bucket, count(*) as n from (select 15 + 10 + 10 + 5 + (case when p_size > 1 then 5 else 0 end) + 5 + (case when p_size >= 25 then 15 else 8 end) + 8 as quality from part) group by 1")
def score_distribution(spark, sf_dir):
    return profile.score_buckets(quality_score_a(spark, sf_dir), F.col("quality"), 10)


@query("select split, count(*) as n from (select case when row_number() over (order by md5('42:' || doc_id), doc_id) <= floor(count(*) over () * 0.8) then 'train' else 'val' end as split from documents) group by 1")
def split_manifest(spark, sf_dir):
    return datasets.manifest(exact_split(spark, sf_dir))


@query("select p_partkey, 'https://images.example.com/' || p_partkey || '.jpg' as image_url from part")
def image_urls(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    return gr.set_image_urls(products, "https://images.example.com/").select(F.col("product_id").alias("p_partkey"), "image_url")


@query("select page_id, left(concat_ws('. ', url, html), 512) as text from pages")
def embedding_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", vc.embedding_text(F.col("url"), F.col("html")).alias("text"))
