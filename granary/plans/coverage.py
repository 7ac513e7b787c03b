"""More queries with SQL twins: sources and sinks by a round trip, normalisation, labeling functions, intents, evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import fuzzy as fz
from granary.functions import normalize as nz
from granary.functions import scoring as sc
from granary.functions import text as tx
from granary.functions import vocab
from granary.operators import active, datasets, dedup, evaluate, profile, validate, weak
from granary.operators import graph as gr
from granary.operators import vector as vc
from granary.plans import catalog as ca
from granary.plans import intent
from granary.plans.registry import query, table
from granary.sources import files
from granary.sources.tables import cores, folder, numbered, spread


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pairs_table(d: dict[str, str]) -> str:
    return "(values " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in d.items()) + ")"


# ---- sources and sinks ---------------------------------------------------------------------------------------------
@query(f"select p_partkey as sample_id, md5({ca.LISTING} || chr(10) || 'a \"quoted\", line ') as content_md5, p_retailprice as price from part")
def io_csv_catalog(spark, sf_dir):
    path = folder(spark)
    content = F.concat("catalog_content", F.lit('\na "quoted", line '))
    files.write_csv(ca.listings(spark, sf_dir).select("sample_id", content.alias("catalog_content"), F.lit("u").alias("image_link"), "price"), path)
    return files.read_catalog(spark, path, ["sample_id", "catalog_content", "price"]).select("sample_id", F.md5("catalog_content").alias("content_md5"), "price")


@query("select cast(event_id as varchar) as sample_id, event_type as item_name, cast(user_id as varchar) as product_id, value as price, row_number() over (order by event_id) as place from events where event_id % 4 <> 0 and event_id % 2 = 1 and event_id % 3 <> 0")
def io_json_lines(spark, sf_dir):
    """Bad lines are skipped, low buckets and missing predictions filtered, the file's order kept."""
    path, i = folder(spark), F.col("event_id")
    prediction = F.when(i % 3 != 0, F.struct(F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("item_name"), F.col("value").alias("price")))
    record = F.struct(i.cast("string").alias("sample_id"), F.lit("c").alias("catalog_content"), F.when(i % 2 == 1, "high_conf").otherwise("low").alias("bucket"), prediction.alias("prediction"))
    line = F.when(i % 4 == 0, F.lit("{bad")).otherwise(F.to_json(record))
    table(spark, sf_dir, "events").select(line.alias("value"), "event_id").repartitionByRange(max(3, cores(spark)), "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    got = files.records(files.read_products(spark, path)).select("sample_id", "item_name", "product_id", "price", "pos")
    # the number of a line in the whole file, for the comparison only
    return numbered(got, "pos", "place").drop("pos")


@query("""select cast(vec_id as varchar) as sample_id, case when vec_id % 2 = 0 then 'organic|vegan' else '' end as dietary_tags,
'{"organic":' || ['0.0', '0.25', '0.5', '0.75'][vec_id % 4 + 1] || '}' as tag_probs, '{"organic":"' || case when vec_id % 4 >= 2 then 'review' else 'auto_reject' end || '"}' as tag_statuses from embeddings""")
def io_weak_labels_csv(spark, sf_dir):
    path, i = folder(spark), F.col("vec_id")
    p = (i % 4) / 4.0
    labels = table(spark, sf_dir, "embeddings").select(
        i.alias("sample_id"), F.when(i % 2 == 0, F.array(F.lit("organic"), F.lit("vegan"))).otherwise(F.array().cast("array<string>")).alias("dietary_tags"),
        F.create_map(F.lit("organic"), p).alias("tag_probs"), F.create_map(F.lit("organic"), sc.label_status(p)).alias("tag_statuses"),
    )
    files.write_csv(weak.to_csv_columns(labels), path)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return back.withColumn("dietary_tags", F.coalesce("dietary_tags", F.lit("")))


@query(ca._W + "select count(*) as n, count(distinct category) as categories, round(sum(u), 3) as total from (select category, round_even(0.5 * entropy + 0.3 * dis + 0.2 * rarity, 4) as u from d order by u desc, sample_id limit 40)")
def io_review_csv(spark, sf_dir):
    path = folder(spark)
    files.write_csv(active.review_queue(ca.weak_labels(spark, sf_dir), ca.listings(spark, sf_dir), 40), path)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    assert len(back.columns) == 11
    return back.agg(F.count("sample_id").alias("n"), F.countDistinct("category").alias("categories"), F.round(F.sum(F.col("uncertainty_score").cast("double")), 3).alias("total"))


@query("""with k as (select doc_id, min(doc_id) over (partition by lower(trim(text)), lang) as original from documents)
select cast(doc_id as varchar) as duplicate, cast(original as varchar) as original, '100.0' as similarity, 'exact' as match_type from k where original < doc_id""")
def io_duplicate_log(spark, sf_dir):
    path = folder(spark)
    files.write_csv(dedup.log_lines(ca.dedup_pairs_exact(spark, sf_dir).withColumn("match_type", F.lit("exact"))), path)
    return spark.read.option("header", True).csv(path).select("duplicate", "original", "similarity", "match_type")


@query(f"""select cast(p_partkey as varchar) as product_id, '1' as attempt, {ca._STEP} as step, length(case {ca._STEP} when 'json_parse' then 'not a JSON object' when 'confidence' then 'extraction_confidence=0.5 is below minimum 0.6'
else concat_ws('|', case when p_partkey % 13 = 0 then '  - item_name: field required' end, case when p_partkey % 5 = 0 then '  - price: must be at least 0' end) end) as error_chars from part where {ca._STEP} is not null""")
def io_dead_letters(spark, sf_dir):
    """Failures appended to a log in two goes."""
    path = folder(spark)
    _, failed = validate.split(validate.validate(ca.answers(spark, sf_dir), "answer", "product_id", fuzzy=False).withColumn("attempt", F.lit(1)))
    for part in range(2):
        files.write_csv(validate.dead_letters(failed.where(F.col("product_id") % 2 == part)), path, "append")
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return back.select("product_id", "attempt", "step", F.length("error").alias("error_chars"))


@query(f"select p_partkey as sample_id, left(repeat({ca.LISTING}, 4), 200) as catalog_content, left(repeat(p_name, 100), 300) as error from part")
def io_failure_log(spark, sf_dir):
    path = folder(spark)
    rows = ca.listings(spark, sf_dir).select("sample_id", F.repeat("catalog_content", F.lit(4)).alias("catalog_content"), F.repeat("p_name", F.lit(100)).alias("error"))
    files.write_failures(rows, path)
    return spark.read.schema("sample_id long, catalog_content string, error string").options(header=True, escape='"', multiLine=True).csv(path)


_PAIR = f"""select p_partkey as sample_id, 3 as n, md5('Extract.' || chr(10) || chr(10) || 'Product listing:' || chr(10) || {ca.LISTING} || chr(10) || 'Price: ' || p_retailprice) as user_md5, p_name as item_name, 'ct' as quantity_unit, 0.85::double as confidence from part"""


@query(_PAIR)
def io_training_pairs(spark, sf_dir):
    """Training pairs written as JSON lines and read back."""
    path, none = folder(spark), F.lit(None)
    p = F.struct(
        F.col("p_name").alias("item_name"), F.col("price").alias("price"), none.cast("double").alias("quantity_value"), none.cast("string").alias("quantity_unit"), F.lit("Beverages").alias("category"),
        none.cast("array<string>").alias("dietary_tags"), none.cast("array<string>").alias("allergen_list"), none.cast("double").alias("extraction_confidence"),
    )
    rows = ca.listings(spark, sf_dir).select("sample_id", datasets.training_pair("You extract.", "Extract.", F.col("catalog_content"), F.col("price"), p).alias("messages"))
    files.write_json_lines(rows, path)
    back = spark.read.schema("sample_id long, messages array<struct<role:string,content:string>>").json(path)
    answer = F.from_json(datasets.last_of_role(F.col("messages"), "assistant"), "item_name string, quantity_unit string, extraction_confidence double")
    return back.select("sample_id", F.size("messages").alias("n"), F.md5(datasets.last_of_role(F.col("messages"), "user")).alias("user_md5"), answer["item_name"].alias("item_name"), answer["quantity_unit"].alias("quantity_unit"), answer["extraction_confidence"].alias("confidence"))


@query("select doc_id from documents where doc_id % 3 <> 0")
def io_checkpoint(spark, sf_dir):
    """Work that a checkpoint, written in two goes, doesn't name as done."""
    path, docs = folder(spark), table(spark, sf_dir, "documents").select("doc_id")
    for part in range(2):
        files.write_checkpoint(docs.where(F.col("doc_id") % 2 == part).select("doc_id", (F.col("doc_id") % 3 == 0).alias("success")), path)
    return datasets.resume(docs, spark.read.parquet(path), "doc_id")


def _versions(spark, sf_dir) -> list[DataFrame]:
    """Records of events in two deliveries; names and tags differ between versions of a product."""
    rows = ca.event_records(spark, sf_dir).withColumns({"brand": F.concat(F.lit(" B"), (F.col("pos") % 7).cast("string"), F.lit(" ")), "dietary_tags": F.array(F.concat(F.lit("T"), (F.col("pos") % 5).cast("string"), F.lit(" "))), "allergen_list": F.array(F.concat(F.lit(" Milk"), (F.col("pos") % 3).cast("string")))})
    return [rows.where(F.col("pos") % 2 == part) for part in range(2)]


@query("""with e as (select *, event_id + (event_id % 2) * 1000000000 as seq from events)
select user_id as product_id, arg_max(event_type, seq) as item_name, arg_max(value, seq) as price, list_sort(list(distinct 'B' || event_id % 7)) as brands, list_sort(list(distinct 'T' || event_id % 5)) as tags,
list_sort(list(distinct 'milk' || event_id % 3)) as allergens, list_sort(list(distinct event_type)) as categories from e group by 1""")
def io_graph_upsert(spark, sf_dir):
    """A graph stored in two deliveries: properties of the later one, edges of both."""
    path = folder(spark)
    for rows in _versions(spark, sf_dir):
        files.write_graph(gr.build(rows), path)
    g = files.read_graph(spark, path)
    out = g.products.select("product_id", "item_name", "price")
    for edges, name, column in ((g.brand_edges, "brand", "brands"), (g.tag_edges, "tag", "tags"), (g.allergen_edges, "allergen", "allergens"), (g.category_edges, "category", "categories")):
        out = out.join(edges.groupBy("product_id").agg(F.array_sort(F.collect_set(name)).alias(column)), "product_id", "left")
    return out


@query("""with r as (select user_id as sample_id, arg_max(event_type, event_id) as category, arg_max(value, event_id) as price from events where event_id % 2 = 1 group by 1
), o as (select user_id as sample_id, arg_max(event_type, event_id) as category, arg_max(value, event_id) as price from events where event_id % 2 = 0 group by 1
), u as (select * from r union all select * from o where sample_id not in (select sample_id from r))
select sample_id as product_id, category, coalesce(price, 0.0) as price, 90 as quality_score, len(embedding) as width from u join embeddings on vec_id = sample_id""")
def io_vector_upsert(spark, sf_dir):
    """Payloads beside vectors, stored in two deliveries by point id."""
    path = folder(spark)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("vector"))
    for rows in _versions(spark, sf_dir):
        files.write_vectors(vc.points(rows.withColumn("sample_id", F.col("product_id")), vectors), path)
    back = files.read_vectors(spark, path)
    assert back.where(~F.col("point_id").between(0, (1 << 53) - 1)).isEmpty()
    return back.select("product_id", "category", "price", "quality_score", F.size("vector").alias("width"))


@query("select lang, count(*) as n, list_sort(list(distinct source)) as sources from documents group by 1")
def io_reports(spark, sf_dir):
    """A report and a list of ids per language, written as JSON and read back."""
    path, docs = folder(spark), table(spark, sf_dir, "documents")
    files.write_report(docs.groupBy("lang").agg(F.count("*").alias("n")), f"{path}/report")
    files.write_ids(docs.select(F.concat_ws("|", "lang", "source").alias("id")), "id", f"{path}/ids")
    ids = spark.read.json(f"{path}/ids").select(F.split("id", "\\|").alias("x")).groupBy(F.get("x", F.lit(0)).alias("lang")).agg(F.array_sort(F.collect_set(F.get("x", F.lit(1)))).alias("sources"))
    return spark.read.schema("lang string, n long").json(f"{path}/report").join(ids, "lang")


@query("select user_id, count(*) as n from events group by 1 having count(*) > 1")
def unique_keys(spark, sf_dir):
    return gr.duplicates_of_key(table(spark, sf_dir, "events"), "user_id")


# ---- parsing -------------------------------------------------------------------------------------------------------
_UNIT = "case p_partkey % 4 when 0 then 'Fluid Ounce' when 1 then 'None' when 2 then 'Pack' else 'bushel' end"


def drafts(spark, sf_dir) -> DataFrame:
    i = F.col("sample_id")
    unit = F.when(i % 4 == 0, "Fluid Ounce").when(i % 4 == 1, "None").when(i % 4 == 2, "Pack").otherwise("bushel")
    extra = F.when(i % 3 == 0, " Plant-Based KETO diet").when(i % 3 == 1, " gluten free, kosher").otherwise("")
    content = F.concat(F.lit("Item Name:  "), "p_name", F.lit(" (pack of "), F.col("p_size").cast("string"), F.lit(")"), extra, F.lit("\nBullet Point 1:  tasty \nProduct Description: "), F.repeat("p_name", F.lit(900)), F.lit("\nValue: 1.5\nUnit: "), unit)
    return ca.listings(spark, sf_dir).select("sample_id", content.alias("catalog_content"), "price", "p_name")


@query(f"""select cast(p_partkey as varchar) as product_id, p_name || ' (pack of ' || p_size || ')' || case p_partkey % 3 when 0 then ' Plant-Based KETO diet' when 1 then ' gluten free, kosher' else '' end as item_name, p_retailprice as price, 1.5::double as quantity_value,
case {_UNIT} when 'Fluid Ounce' then 'fl oz' when 'Pack' then 'ct' when 'bushel' then 'bushel' end as quantity_unit, p_size as pack_size, left(repeat(p_name, 900), 5000) as description, ['tasty'] as bullet_points,
case p_partkey % 3 when 0 then ['keto', 'vegan'] when 1 then ['gluten-free', 'kosher'] end as dietary_tags from part""")
def parse_product(spark, sf_dir):
    d = drafts(spark, sf_dir)
    p = tx.parse_product(F.col("sample_id"), F.col("catalog_content"), F.col("price"), F.lit("u"))
    names = ["product_id", "item_name", "price", "quantity_value", "quantity_unit", "pack_size", "description", "dietary_tags"]
    return d.select(p.alias("p")).select(*(F.col(f"p.{n}") for n in names), F.transform("p.bullet_points", nz.strip).alias("bullet_points"))


@query("""select doc_id, case when doc_id % 2 = 0 then lang || ' ' || source else left(text, 80) end as name, case when doc_id % 2 = 0 then lower(lang || ' ' || source) else '' end as low from documents""")
def item_names(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ITEM NAME: no\nItem Name:  "), "lang", F.lit(" "), "source", F.lit("  \n"), "text")).otherwise(F.col("text"))
    low = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(t, "^ITEM NAME: no\n", "")).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", tx.item_name(t).alias("name"), tx.item_name_lower(low).alias("low"))


_SCANNED = "lower(p_name || case p_partkey % 4 when 0 then ' with Eggs and Tree Nuts' when 1 then ' Wheat-free, FISH' when 2 then ' organic Sugar Free vegan' else ' non-GMO soy-free' end)"


def _scanned(spark, sf_dir) -> DataFrame:
    i = F.col("p_partkey")
    more = F.when(i % 4 == 0, " with Eggs and Tree Nuts").when(i % 4 == 1, " Wheat-free, FISH").when(i % 4 == 2, " organic Sugar Free vegan").otherwise(" non-GMO soy-free")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", more).alias("t"))


@query(f"select p_partkey, [v for v in {text_list(vocab.SCAN_ALLERGENS)} if contains({_SCANNED}, v)] as allergens, [v for v in {text_list(vocab.SCAN_TAGS)} if contains({_SCANNED}, v)] as tags from part")
def scan_literals(spark, sf_dir):
    return _scanned(spark, sf_dir).select("p_partkey", tx.scan(F.col("t"), vocab.SCAN_ALLERGENS).alias("allergens"), tx.scan(F.col("t"), vocab.SCAN_TAGS).alias("tags"))


@query("select p_partkey, case when p_size % 5 = 0 then 0.0 else 100 * p_size / (p_size % 5)::double end as ratio, least(100 * p_size, p_size % 5) as shortest, greatest(100 * p_size, p_size % 5) as longest from part")
def image_sides(spark, sf_dir):
    a = profile.aspect(F.col("p_size") * 100, F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a")).select("p_partkey", "a.*")


@query("""select event_id, case event_id % 3 when 0 then props when 1 then '{"k": 1}' else 'plain' end as inner_text from events""")
def between_fences(spark, sf_dir):
    i = F.col("event_id")
    answer = F.when(i % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nand ```more```"))).when(i % 3 == 1, F.lit('```\n{"k": 1}\n```')).otherwise(F.lit("  plain\n"))
    return table(spark, sf_dir, "events").select("event_id", tx.between_fences(answer).alias("inner_text"))


@query("""select event_id, event_type as item_name, value as price, case when event_id % 2 = 0 then 3.0 else 1.0 end as quantity_value, case when event_id % 3 = 0 then 'oz' else 'ct' end as quantity_unit,
case when event_id % 2 = 0 then [event_type] else [] end as dietary_tags, [] as allergen_list, case when event_id % 5 = 0 then 0.5 else 0.85 end as extraction_confidence from events""")
def clean_predictions(spark, sf_dir):
    i = F.col("event_id")
    p = F.struct(
        F.col("event_type").alias("item_name"), F.col("value").alias("price"), F.when(i % 2 == 0, 3.0).alias("quantity_value"), F.when(i % 3 == 0, "oz").alias("quantity_unit"), F.lit("c").alias("category"),
        F.when(i % 2 == 0, F.array("event_type")).alias("dietary_tags"), F.lit(None).cast("array<string>").alias("allergen_list"), F.when(i % 5 == 0, 0.5).alias("extraction_confidence"),
    )
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", datasets.clean_prediction(F.col("p")).alias("c")).select("event_id", "c.*").drop("category").withColumn("allergen_list", F.col("allergen_list").cast("array<int>"))


# ---- normalisation -------------------------------------------------------------------------------------------------
RAW_UNITS = sorted({*vocab.UNIT_ALIASES, *(a.upper() for a in vocab.UNIT_ALIASES), *(f" {u} " for u in vocab.UNITS), "None", "", "l", "bushel"})


@query(f"""with a(alias, canonical) as {pairs_table(vocab.UNIT_ALIASES)}, n as (select *, row_number() over () as k from a), low as (select lower(alias) as alias, arg_min(canonical, k) as canonical from n group by 1
), x as (select p_partkey, {text_list(RAW_UNITS)}[p_partkey % {len(RAW_UNITS)} + 1] as raw from part)
select p_partkey, raw, case when trim(raw) <> '' and lower(trim(raw)) <> 'none' then coalesce(a.canonical, low.canonical, case when list_contains({text_list(vocab.UNITS)}, trim(raw)) then trim(raw) end) end as unit
from x left join a on a.alias = trim(raw) left join low on low.alias = lower(trim(raw))""")
def normalize_units(spark, sf_dir):
    """A unit for every part: every alias, in capitals too, canonical units and what is none; by look-up alone."""
    raw = F.get(F.array(*map(F.lit, RAW_UNITS)), (F.col("p_partkey") % len(RAW_UNITS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("unit", nz.unit(F.col("raw"), fuzzy=False))


RAW_ALLERGENS = ["Eggs", "milk", " MILK ", "Tree Nuts", "tree_nut", "bogus", "fish", "eggs"]
RAW_TAGS = [*list(vocab.TAG_ALIASES)[:20], "NON-GMO", "non-GMO", "Kosher Pareve", "caffeine-free", "none of these"]


def _normalized(values: str, aliases: dict[str, str], known: list[str], lower_known: bool) -> str:
    own = "lower(trim(v))" if lower_known else "trim(v)"
    return f"""with a(alias, canonical) as {pairs_table(aliases)}, x as (
  select p_partkey, unnest({values}) as v, unnest(range(len({values}))) as k from part
), c as (select p_partkey, k, coalesce(a.canonical, b.canonical, case when list_contains({text_list(known)}, {own}) then {own} end) as c from x left join a on a.alias = lower(trim(v)) left join a b on b.alias = trim(v)
), f as (select p_partkey, c, min(k) as k from c where c is not null group by 1, 2), g as (select p_partkey, list(c order by k) as out from f group by 1)
select p_partkey, out from part left join g using (p_partkey)"""


def _rotated(values: list[str]):
    """Five values from the list, starting at a place that the key gives."""
    n, i = len(values), F.col("p_partkey")
    every = F.array(*map(F.lit, [*values, *values]))
    return F.slice(every, (i % n + 1).cast("int"), F.lit(5))


def _rotated_sql(values: list[str]) -> str:
    return f"list_slice({text_list([*values, *values])}, p_partkey % {len(values)} + 1, p_partkey % {len(values)} + 5)"


@query(_normalized(_rotated_sql(RAW_ALLERGENS), vocab.ALLERGEN_ALIASES, vocab.ALLERGENS, True))
def normalize_allergens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nz.allergens(_rotated(RAW_ALLERGENS), fuzzy=False).alias("out"))


@query(_normalized(_rotated_sql(RAW_TAGS), vocab.TAG_ALIASES, vocab.DIETARY_TAGS, False))
def normalize_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nz.dietary_tags(_rotated(RAW_TAGS), fuzzy=False).alias("out"))


RAW_BRANDS = [*list(vocab.BRAND_ALIASES)[::7], "KIZE", " Sara LEE ", "ACME", "o'neil foods", "plain brand", "3m", " "]
# What a brand without an alias becomes.
OTHER_BRANDS = {"ACME": "ACME", "o'neil foods": "O'Neil Foods", "plain brand": "Plain Brand", "3m": "3M"}


@query(f"""with a(alias, canonical) as {pairs_table(vocab.BRAND_ALIASES)}, o(alias, canonical) as {pairs_table(OTHER_BRANDS)}, r as (select p_partkey, {text_list(RAW_BRANDS)}[p_partkey % {len(RAW_BRANDS)} + 1] as raw from part)
select p_partkey, raw, coalesce(a.canonical, o.canonical) as brand from r left join a on a.alias = lower(trim(raw)) left join o on o.alias = raw""")
def normalize_brands(spark, sf_dir):
    """Aliases in any case, brands without capitals in title case, others as they are."""
    raw = F.get(F.array(*map(F.lit, RAW_BRANDS)), (F.col("p_partkey") % len(RAW_BRANDS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), nz.brand(raw, fuzzy=False).alias("brand"))


RAW_CATEGORIES = [*vocab.CATEGORIES, "beverages", "", "No such thing"]


@query(f"""select p_partkey, raw, case when raw <> '' then case when list_contains({text_list(vocab.CATEGORIES)}, raw) then raw else 'Unknown' end end as category
from (select p_partkey, {text_list(RAW_CATEGORIES)}[p_partkey % {len(RAW_CATEGORIES)} + 1] as raw from part)""")
def normalize_categories(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, RAW_CATEGORIES)), (F.col("p_partkey") % len(RAW_CATEGORIES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), nz.category(raw, fuzzy=False).alias("category"))


PACKED = ["Pack of {}", "{} pack", "{}-Pack", "{} Count", "set of {}", "Box of {}", "case of {}", "({}) ct", "{} pieces"]


@query(f"""with r as (select p_partkey, p_partkey % {len(PACKED)} as k, case when p_partkey % 5 = 0 then 1 when p_partkey % 7 = 0 then 1001 else p_size end as n from part)
select p_partkey, case when n > 1 and n <= 1000 and k < {len(PACKED) - 1} then n end as pack from r""")
def pack_patterns(spark, sf_dir):
    """All seven patterns, numbers in and out of range, and a text with none of them."""
    i = F.col("p_partkey")
    n = F.when(i % 5 == 0, 1).when(i % 7 == 0, 1001).otherwise(F.col("p_size")).cast("string")
    texts = F.array(*(F.concat(F.lit("Tea, " + a), n, F.lit(b)) for a, b in (p.split("{}") for p in PACKED)))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", nz.pack_size(F.get(texts, (i % len(PACKED)).cast("int"))).alias("pack"))


@query("""with recursive pairs as (select a.p_partkey, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1
), lcs as (select p_partkey, a, b, 0 as i, [0 for x in range(length(b) + 1)] as row from pairs
  union all select p_partkey, a, b, i + 1, [list_max([greatest(row[j], case when j > 1 and substr(a, i + 1, 1) = substr(b, j - 1, 1) then row[j - 1] + 1 else 0 end) for j in range(1, k + 1)]) for k in range(1, len(row) + 1)] from lcs where i < length(a))
select p_partkey, a, b, round(200.0 * list_max(row) / (length(a) + length(b)), 6) as ratio from lcs where i = length(a)""")
def fuzzy_ratios(spark, sf_dir):
    """Similarity of every part's name to the next part's; the twin computes the table of subsequences row by row."""
    part = table(spark, sf_dir, "part")
    both = part.select("p_partkey", F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return both.select("p_partkey", "a", "b", F.round(fz.ratio_column(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("select distinct p_name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') as tokens from part")
def sorted_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", fz.sorted_tokens(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " \t "))).alias("tokens")).distinct()


@query("""select p_partkey, case p_partkey % 4 when 0 then 'oz' when 1 then 'kg' when 2 then 'fl oz' end as unit, case p_partkey % 4 when 0 then ['vegan'] when 1 then ['gluten-free', 'vegan'] when 2 then ['kosher'] end as tags,
case p_partkey % 4 when 0 then 'Beverages' when 1 then 'Coffee & Tea' when 2 then 'Snacks & Candy' else 'Unknown' end as category from part""")
def normalize_similar(spark, sf_dir):
    """Misspelt values that only similarity resolves, and some that it must not."""
    pick = lambda values: F.get(F.array(*values), (F.col("p_partkey") % 4).cast("int"))
    unit = pick([F.lit("ozz"), F.lit("kgg"), F.lit("fl.oz"), F.lit("zzz")])
    tags = pick([F.array(*map(F.lit, x)) for x in (["vegans"], ["gluten--free", "vegann"], ["koshers", "qqq"], ["qqq"])])
    category = pick([F.lit("Beverage"), F.lit("Tea & Coffee"), F.lit("Candy & Snacks"), F.lit("qqq")])
    return table(spark, sf_dir, "part").select("p_partkey", nz.unit(unit).alias("unit"), nz.dietary_tags(tags).alias("tags"), nz.category(category).alias("category"))


# ---- validation ----------------------------------------------------------------------------------------------------
@query("""select p_partkey, [e for e in [case when p_partkey % 17 = 0 then 'brand: must have at most 100 characters' end, case when p_partkey % 3 = 0 then 'category: not in the vocabulary' end, case when p_size % 4 = 0 then 'quantity_value: must be at least 0' end,
case when p_partkey % 5 = 0 then 'quantity_unit: not in the vocabulary' end, case when p_size > 25 then 'pack_size: must be 1 to 1000' end, case when p_partkey % 2 = 0 then 'dietary_tags: not in the vocabulary' end,
case when p_partkey % 7 = 0 then 'allergen_list: not in the vocabulary' end, case when p_partkey % 6 = 0 then 'visual -> image_quality: not in the vocabulary' end, case when p_partkey % 10 = 0 then 'extraction_confidence: must be 0 to 1' end] if e is not null] as errors from part""")
def field_errors(spark, sf_dir):
    """The contract of every field on raw records, bad tags and allergens among them."""
    i, none, text = F.col("p_partkey"), F.lit(None), lambda *v: F.array(*map(F.lit, v))
    e = F.struct(
        i.cast("string").alias("product_id"), F.col("p_name").alias("item_name"), F.when(i % 17 == 0, F.repeat("p_brand", F.lit(30))).otherwise(F.col("p_brand")).alias("brand"),
        F.when(i % 3 == 0, "No such").otherwise("Beverages").alias("category"), F.when(F.col("p_size") % 4 == 0, -1.0).alias("quantity_value"), F.when(i % 5 == 0, "l").otherwise("L").alias("quantity_unit"),
        F.when(F.col("p_size") > 25, 1001).otherwise(1).alias("pack_size"), F.col("p_retailprice").alias("price"), F.when(i % 2 == 0, text("vegan", "keto-friendly")).otherwise(text("vegan ", "keto")).alias("dietary_tags"),
        F.when(i % 7 == 0, text("eggs")).otherwise(text(" EGG", "milk")).alias("allergen_list"), none.cast("string").alias("description"),
        F.struct(F.lit("jar").alias("packaging_type"), none.cast("string").alias("packaging_color"), none.cast("boolean").alias("has_brand_logo"), F.when(i % 6 == 0, "blurry").alias("image_quality")).alias("visual"),
        F.when(i % 10 == 0, 1.5).otherwise(1.0).alias("extraction_confidence"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", validate.field_errors(e).alias("errors"))


@query("select p_partkey, cast(trunc(p_size / 64.0::double * 100) as integer) as quality from part")
def quality_score_c(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.confidence_quality(F.col("p_size") / 64.0).alias("quality"))


@query(f"""select product_id, attempt, outcome from (select p_partkey as product_id, case when {ca._STEP} is null then 1 when p_partkey % 2 = 0 then 2 else 3 end as attempt, case when {ca._STEP} is null or p_partkey % 3 <> 0 then 'accepted' else 'dead' end as outcome from part)
where outcome = 'accepted' union all select p_partkey, 3, 'dead' from part where {ca._STEP} is not null and p_partkey % 3 = 0""")
def validate_with_retries(spark, sf_dir):
    """Rows are corrected in the second or third round, every third one never."""

    def again(failed: DataFrame) -> DataFrame:
        i = F.col("product_id")
        mended = (i % 3 != 0) & ((i % 2 == 0) | (F.col("attempt") == 2))
        good = F.to_json(F.struct(F.lit("Tea").alias("item_name"), F.lit(1.0).alias("price"), F.lit(0.9).alias("extraction_confidence")))
        return failed.withColumn("answer", F.when(mended & F.contains("retry_message", F.lit("\n")) | mended & (F.col("step") == "confidence"), good).otherwise(F.lit("still not")))

    ok, bad = validate.with_retries(ca.answers(spark, sf_dir), "answer", "product_id", again, fuzzy=False)
    rows = [df.select("product_id", "attempt", F.lit(outcome).alias("outcome")) for df, outcome in ((ok, "accepted"), (bad, "dead"))]
    return rows[0].unionByName(rows[1])


@query(f"""select p_partkey as product_id, case {ca._STEP} when 'json_parse' then 'The answer is not valid JSON.' when 'pydantic' then 'The JSON breaks the schema.' else 'The confidence is below 0.6. Read the product again.' end as told from part where {ca._STEP} is not null""")
def retry_messages(spark, sf_dir):
    _, failed = validate.split(validate.validate(ca.answers(spark, sf_dir), "answer", "product_id", fuzzy=False))
    return failed.select("product_id", F.get(F.split(validate.retry_message(F.col("step"), F.col("error")), "\n"), F.lit(0)).alias("told"))


# ---- weak supervision ----------------------------------------------------------------------------------------------
PHRASES = [
    "certified organic tea", "inorganic salt", "kosher dairy", "ok then", "gluten free oats", "gluten-free", "non gmo corn", "plant-based milk", "100% plant", "vegan cheese", "ketogenic bar", "paleo friendly",
    "lactose-free", "no added sugar", "tree nut free", "soy-free", "good source of protein", "sparkling water", "green tea", "trail mix", "hot sauce", "kidney beans", "garlic powder", "fish oil", "chia seeds", "olive oil",
    "clif bar", "garam masala", "chana dal", "pure honey", "contains soy and milk", "contains soy. milk", "low calorie", "light beer", "decaf", "free from nuts", "unsweetened steak", "artisan bread", "nothing here", "Chips & Juice",
]


def _phrase(k: int) -> str:
    return f"{text_list(PHRASES)}[(p_partkey * {k}) % {len(PHRASES)} + 1]"


_TEXT = f"lower({_phrase(1)} || '. ' || {_phrase(7)})"


def phrased(spark, sf_dir) -> DataFrame:
    own = lambda k: F.get(F.array(*map(F.lit, PHRASES)), ((F.col("p_partkey") * k) % len(PHRASES)).cast("int"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("sample_id"), F.concat(own(1), F.lit(". "), own(7)).alias("catalog_content"), (F.col("p_size") * 2.0).alias("price"), F.concat(F.lit("https://e.com/"), own(1), F.lit(".jpg")).alias("image_link"))


def _hit(p: str) -> str:
    return "regexp_matches({}, '(?i){}')".format(_TEXT, p.replace("'", "''"))


def _vote(condition: str, vote: int) -> str:
    return f"case when {condition} then {vote} else -1 end"


_DIETARY = [_vote(_hit(p), 1) for _, _, p in weak.TAG_PATTERNS]
_DIETARY[12:12] = [
    _vote(f"{_hit(weak.VEGAN_CLAIM)} and {_hit(weak.DAIRY_WORD)}", 0),
    _vote(f"p_size * 2.0 > 50 and {_hit(weak.PREMIUM_WORD)}", 1),
    _vote(_hit(weak.CONTAINS_ANIMAL), 0),
]
_CATEGORY = [_vote(_hit(p), k) for _, k, p in weak.CATEGORY_PATTERNS] + [_vote(" or ".join(f"contains(lower({_phrase(1)}), '{w}')" for w in weak.COFFEE_IN_URL), 2)]
_VOTES = f"select p_partkey as sample_id, [{', '.join(_CATEGORY)}]::integer[] as category_votes, [{', '.join(_DIETARY)}]::integer[] as dietary_votes from part"


def both_votes(spark, sf_dir) -> DataFrame:
    return weak.listing_votes(phrased(spark, sf_dir), "category_votes", "dietary_votes")


@query(_VOTES)
def labeling_functions(spark, sf_dir):
    """The votes of all thirty-one labeling functions."""
    return both_votes(spark, sf_dir)


@query(f"""with v as ({_VOTES}), x as (select unnest(range(18)) as j)
select j, round(avg((dietary_votes[j + 1] <> -1)::int), 6) as coverage from v, x group by 1""")
def labeling_coverage(spark, sf_dir):
    out = weak.analyze(both_votes(spark, sf_dir), [str(j) for j in range(18)], "dietary_votes")
    return out.select(F.col("name").cast("long").alias("j"), F.round("coverage", 6).alias("coverage"))


_EM = """patterns as (select v, count(*) as n from votes group by 1), em as (
  select 0 as step, [0.7::double for x in range({m})] as acc
  union all select step + 1, (select [case when list_sum([p.n * (p.v[j] >= 0)::int for p in ps]) > 0 then
      least(0.99, greatest(0.501, (list_sum([case when p.v[j] >= 0 then p.n * (case when p.v[j] = 1 then p.p1 else 1 - p.p1 end) else 0 end for p in ps]) + 1.4) / (list_sum([p.n * (p.v[j] >= 0)::int for p in ps]) + 2)))
      else acc[j] end for j in range(1, {m} + 1)]
    from (select list({{'v': v, 'n': n::double, 'p1': 1 / (1 + exp(-list_sum([case v[j] when 1 then ln(acc[j] / (1 - acc[j])) when 0 then -ln(acc[j] / (1 - acc[j])) else 0 end for j in range(1, {m} + 1)])))}}) as ps from patterns))
  from em where step < 100)"""


@query(ca._VOTED.replace("with v as", "with recursive v as").rstrip() + ", votes as (select votes as v from v), " + _EM.format(m=len(ca.RULES)) + f""", final as (select acc from em where step = 100
), d as (select doc_id, 1 / (1 + exp(-list_sum([case votes[j] when 1 then ln(acc[j] / (1 - acc[j])) when 0 then -ln(acc[j] / (1 - acc[j])) else 0 end for j in range(1, {len(ca.RULES)} + 1)]))) as p from v, final)
select doc_id, round(p, 4) as p1, case when greatest(round_even(p, 4), round_even(1 - p, 4)) >= 0.85 then 'auto_accept' else 'review' end as status from d""")
def label_model_posterior(spark, sf_dir):
    """Class probabilities of a label model over vote patterns; the twin runs the same hundred steps in SQL."""
    df = ca.voted(spark, sf_dir)
    return weak.predict(df, weak.fit(df, 2), "votes").select("doc_id", F.round(F.get("probs", F.lit(1)), 4).alias("p1"), weak.label(F.col("probs"), ["no", "yes"])["status"].alias("status"))


# ---- vectors -------------------------------------------------------------------------------------------------------
@query(f"""select vec_id as product_id, p_type as category, p_retailprice as price, round_even({ca.COSINE}, 3) as score from embeddings join part on p_partkey = vec_id
where p_type = 'PROMO' and p_retailprice <= 980.0 and list_contains(string_split(p_name, ' '), 'red') order by {ca.COSINE} desc, vec_id limit 10""")
def vector_topk_filtered(spark, sf_dir):
    """Nearest vectors among those of a category, up to a price, with all tags."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sample_id"), F.lit(1).alias("pos"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("dietary_tags"),
        F.lit(None).cast("array<string>").alias("allergen_list"), F.lit(1.0).alias("quantity_value"), F.lit("oz").alias("quantity_unit"), F.lit(0.9).alias("extraction_confidence"),
    )
    points = vc.points(rows, ca.vectors(spark, sf_dir).select(F.col("product_id").alias("sample_id"), "vector"))
    return vc.search(points, ca.probe(), 10, category="PROMO", max_price=980.0, dietary_tags=["red"]).select("product_id", "category", "price", "score")


@query("select product_id, item_name, price, category, allergens, quality_score from (select p_partkey as product_id, case when p_partkey % 2 = 0 then p_name end as item_name, case when p_partkey % 3 = 0 then 0.0 else p_retailprice end as price, case when p_partkey % 5 = 0 then 'Unknown' else p_type end as category, [] as allergens, cast(trunc(p_size / 64.0::double * 100) as integer) as quality_score from part join embeddings on vec_id = p_partkey)")
def vector_payloads(spark, sf_dir):
    """Payloads with their defaults; only products with a vector are points."""
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        i.alias("sample_id"), F.lit(1).alias("pos"), F.when(i % 2 == 0, F.col("p_name")).alias("item_name"), F.col("p_brand").alias("brand"), F.when(i % 5 != 0, F.col("p_type")).alias("category"), F.when(i % 3 != 0, F.col("p_retailprice")).alias("price"),
        F.lit(None).cast("array<string>").alias("dietary_tags"), F.lit(None).cast("array<string>").alias("allergen_list"), F.lit(1.0).alias("quantity_value"), F.lit("oz").alias("quantity_unit"), (F.col("p_size") / 64.0).alias("extraction_confidence"),
    )
    points = vc.points(rows, ca.vectors(spark, sf_dir).select(F.col("product_id").alias("sample_id"), "vector"))
    return points.select("product_id", "item_name", "price", "category", F.col("allergens").cast("array<int>").alias("allergens"), "quality_score")


@query("select vec_id, [length(p_name)::double, p_size::double] as vector from embeddings left join part on p_partkey = vec_id where p_partkey is not null union all select vec_id, null from embeddings where vec_id not in (select p_partkey from part)")
def embed_texts(spark, sf_dir):
    """An encoder called on batches of texts; rows without a text get no vector."""
    df = table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("text")), "vec_id", "left")
    out = vc.embed(df, "text", lambda texts: [[len(t.split("|")[0]), int(t.split("|")[1])] for t in texts])
    return out.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))


@query(f"select vec_id as product_id, round_even({ca.COSINE}, 3) as score from embeddings where label % 2 = 0 order by {ca.COSINE} desc, vec_id limit 20")
def vector_topk_indexed(spark, sf_dir):
    """An exact search over the stored index, with a filter; cells whose bound is below the last score are not read."""
    from granary.operators import ivf

    path = folder(spark)
    payload = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("category"))
    ivf.build(payload, path, cells=16, sort_by=["category"])
    return ivf.search(spark, path, ca.probe(), 20, probes=4, exact=True, category="even").select("product_id", "score")


@query("select vec_id as sample_id, true as in_range, true as stable from embeddings")
def point_ids(spark, sf_dir):
    """Ids of points are below 2**53, alike in every run, and no two rows of one table meet."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), vc.point_id(F.col("vec_id").cast("string")).alias("id"))
    alike = ids.repartition(3, "sample_id").groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(alike, "id").select("sample_id", F.col("id").between(0, (1 << 53) - 1).alias("in_range"), (F.col("n") == 1).alias("stable"))


# ---- questions -----------------------------------------------------------------------------------------------------
def engine(spark, sf_dir, **more) -> intent.Engine:
    types, words = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM", "LARGE", "SMALL"], ["red", "hot", "gear", "small", "cold"]
    parser = lambda q: intent.parse(q, words, types, ["Brand#3"], ["nation_3", "nation_5"])
    return intent.Engine(ca.product_graph(spark, sf_dir), ca.vectors(spark, sf_dir), lambda q: ca.probe(), parser, **more)


@query(ca.G + """select product_id, item_name, price, quality_score, brand, category from products p where category = 'PROMO' and price <= 960.0 and price >= 910.0
and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'hot') and not exists (select 1 from allergens a where a.product_id = p.product_id and a.allergen = 'nation_5') order by quality_score desc nulls first, product_id limit 10""")
def question_filter(spark, sf_dir):
    """A question with a category, a tag, two prices and an allergen."""
    return engine(spark, sf_dir).plan("Find hot promo things from $910 to $960 without nation 5", 10)


@query(ca.G + "select product_id, item_name, price, quality_score, brand, category from products p where brand = 'Brand#3' and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'gear') order by quality_score desc nulls first, product_id limit 10")
def question_brand(spark, sf_dir):
    """A brand is a constraint like any other."""
    return engine(spark, sf_dir).plan("gear by brand#3 please", 10)


@query(ca.G + "select tag, count(*) as product_count from tags group by 1")
def question_analytics(spark, sf_dir):
    return engine(spark, sf_dir).plan("How many products have each tag?")


@query(f"""with near as (select vec_id as product_id, {ca.COSINE} as semantic from embeddings order by 2 desc, 1 limit 10)
select product_id, semantic, round_even(0.7::double * semantic + 0.3::double * (case when p_size <> 0 then 2 * p_size else 50 end) / 100.0::double, 3) as score from near join part on p_partkey = product_id""")
def question_semantic(spark, sf_dir):
    return engine(spark, sf_dir).plan("something healthy", 10).select("product_id", "semantic", "score")


@query(ca.G + "select category, count(*) as n from products group by 1 having count(*) > 5")
def question_by_sql(spark, sf_dir):
    """A question that names nothing is answered by the hook's query, which must only read."""
    return engine(spark, sf_dir, to_sql=lambda q, e: "select category, count(*) as n from products join categories using (product_id) group by category having count(*) > 5").plan("tell me about it")


@query("select count(distinct p_partkey) as total_products, count(distinct p_brand) as total_brands from part")
def overview_totals(spark, sf_dir):
    return engine(spark, sf_dir).overview()["totals"]


QUESTIONS = {
    "vegan snacks under $20 without milk": ("filter", "filter", "vegan", "Snacks & Candy", None, 20.0, "milk"),
    "organic kosher tea over $5 and below $12.50": ("filter", "filter", "organic|kosher", "Coffee & Tea", 5.0, 12.5, None),
    "How many brands are there?": ("analytics", "analytics", None, None, None, None, None),
    "something similar to salsa": ("semantic", "hybrid", None, None, None, None, None),
    "healthy NON-GMO drink free of egg": ("hybrid", "hybrid", "non-GMO", "Beverages", None, None, "egg"),
    "spice mix": ("filter", "filter", None, "Spices & Seasonings", None, None, None),
    "average price of beverages": ("analytics", "analytics", None, "Beverages", None, None, None),
    "Pasta & Noodles up to $7": ("filter", "filter", None, "Pasta & Noodles", None, 7.0, None),
}


def _literal(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double"


_ASKED = ", ".join(f"('{q}', {', '.join(map(_literal, x))})" for q, x in QUESTIONS.items())


@query(f"""with t(question, kind, route, tags, category, min_price, max_price, excluded) as (values {_ASKED}), n as (select *, row_number() over () - 1 as k from t), b as (
  select p_partkey, p_size, k, question, kind, route, tags, category, min_price, coalesce(max_price, case when kind = 'filter' then (1 + p_size)::double end) as max_price, excluded from part join n on k = p_partkey % {len(QUESTIONS)})
select p_partkey, case when kind = 'filter' and k in (select k from n where max_price is null) then question || ' under $' || (1 + p_size) else question end as question, kind, route, tags, category, min_price, max_price, excluded from b""")
def question_intents(spark, sf_dir):
    """A log of questions, one a part, parsed in bulk; those that only filter get a price of the part's own."""
    texts = [f"{q} under $%d" if x[0] == "filter" and x[5] is None else q for q, x in QUESTIONS.items()]
    text = F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts)).cast("int"))
    log = table(spark, sf_dir, "part").select("p_partkey", F.replace(text, F.lit("%d"), (F.col("p_size") + 1).cast("string")).alias("question"))
    e = F.col("intent")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    parsed = intent.parse_all(log, "question")
    return parsed.select("p_partkey", "question", e["kind"].alias("kind"), e["route"].alias("route"), joined(e["tags"]).alias("tags"), e["category"].alias("category"), e["min_price"].alias("min_price"), e["max_price"].alias("max_price"), joined(e["exclude_allergens"]).alias("excluded"))


@query(ca.G + "select category, product_count, avg_price from (select category, count(*) as product_count, round(avg(price), 2) as avg_price from products group by 1) order by avg_price desc, category limit 3")
def runner_analytics(spark, sf_dir):
    """The graph-only runner's template for the highest prices."""
    return intent.graph_only(ca.product_graph(spark, sf_dir), "analytics", "Which have the highest price on average?").select("category", "product_count", "avg_price")


@query(ca.G + "select '1. ' || item_name || ' (' || brand || '), ' || price as answer from products where product_id = 1")
def answer_text(spark, sf_dir):
    rows = [r.asDict() for r in gr.lookup(ca.product_graph(spark, sf_dir), spark.createDataFrame([(1,)], "product_id long")).collect()]
    return spark.createDataFrame([(intent.answer(rows),)], "answer string")


_HYBRID = ca.G + f"""select p.product_id, item_name, price, quality_score, brand, category, round_even(0.6::double * coalesce({ca.COSINE}, 0.5) + 0.4::double * coalesce(quality_score, 50) / 100.0::double, 3) as score
from (select * from products p where {{where}} order by quality_score desc nulls first, product_id limit 100) p left join embeddings on vec_id = p.product_id order by score desc, p.product_id limit 10"""


@query(_HYBRID.format(where="category = 'PROMO' and price <= 960.0 and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'hot')"))
def question_hybrid(spark, sf_dir):
    """A question with constraints and a likeness: constraints choose, vectors and quality rank."""
    return _scored(engine(spark, sf_dir).plan("healthy hot promo things under $960", 10))


@query(_HYBRID.format(where="brand = 'Brand#3' and price >= 905.0"))
def search_hybrid(spark, sf_dir):
    """A structured search with a query and constraints."""
    return _scored(engine(spark, sf_dir).search("anything", 10, brand="Brand#3", min_price=905.0))


def _scored(df):
    return df.select("product_id", "item_name", "price", "quality_score", "brand", "category", "score")


@query(ca.G + "select product_id, item_name, price, quality_score, brand, category from products p where brand = 'Brand#3' and price <= 950.0 order by quality_score desc nulls first, product_id limit 10")
def search_filter(spark, sf_dir):
    """A structured search without a query is a filter."""
    return engine(spark, sf_dir).search(None, 10, brand="Brand#3", max_price=950.0)


@query(ca.G + """select 'Find gear by brand#3' as question, 'filter' as intent, (select count(*) from (select 1 from products p where brand = 'Brand#3' and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'gear') limit 7)) as results, null as error
union all select 'How many of each tag?', 'analytics', least(7, (select count(distinct tag) from tags)), null
union all select 'tell me about it', null, 0, 'only a query may be run'""")
def question_answers(spark, sf_dir):
    """The façade's answers to three questions: intent, number of results, and an error where a hook's statement is refused after retries."""
    e = engine(spark, sf_dir, to_sql=lambda q, entities: "drop table products")
    asked = [e.query(q, 7) for q in ("Find gear by brand#3", "How many of each tag?", "tell me about it")]
    return spark.createDataFrame([(a["query"], a["intent"], len(a["results"]), a["error"]) for a in asked], "question string, intent string, results long, error string")


@query(ca.G + """select p.product_id, item_name, price, brand, category, (select list_sort(list(tag)) from tags t where t.product_id = 1) as tags, coalesce((select list_sort(list(allergen)) from allergens a where a.product_id = 1), []) as allergens from products p where product_id = 1""")
def product_page(spark, sf_dir):
    """A product's page as the façade gives it."""
    page = engine(spark, sf_dir).product(1)
    names = ("product_id", "item_name", "price", "brand", "category", "tags", "allergens")
    return spark.createDataFrame([tuple(page[n] for n in names)], "product_id long, item_name string, price double, brand string, category string, tags array<string>, allergens array<string>")


@query("select (select count(*) from part) > 0 as products, (select count(*) from embeddings) > 0 as vectors")
def health(spark, sf_dir):
    return spark.createDataFrame([tuple(engine(spark, sf_dir).health().values())], "products boolean, vectors boolean")


@query(ca.G + """select product_id, item_name, price, quality_score, brand, category from products p where price <= 950
and exists (select 1 from tags t where t.product_id = p.product_id and t.tag = 'red') order by quality_score desc nulls first, product_id limit 10""")
def runner_constraints(spark, sf_dir):
    """The graph-only runner's constraints: tags and the first price of a question."""
    g = ca.product_graph(spark, sf_dir)
    vegan = replace(g, tag_edges=g.tag_edges.withColumn("tag", F.when(F.col("tag") == "red", "vegan").otherwise(F.col("tag"))))
    return intent.graph_only(vegan, "multi_constraint", "Vegan products under $950")


# ---- data sets and evaluation --------------------------------------------------------------------------------------
@query("""with c as (select lang as category, count(*) as n from documents where lang is not null group by 1
), r as (select category, row_number() over (order by category) - 1 as k, floor(sum(n) over () * 0.2)::bigint as total, greatest(20, floor(sum(n) over () * 0.2)::bigint // count(*) over ()) as each from c)
select category, least(each, total - k * each) as quota from r where total > k * each""")
def synthetic_quotas(spark, sf_dir):
    """A fifth of the real documents, at least 20 a language while they last."""
    return datasets.quotas_of(table(spark, sf_dir, "documents"), "lang", 0.2, 20)


@query("""with r as (select doc_id, lang, row_number() over (order by md5('42:' || doc_id), doc_id) as k, count(*) over () as n from documents)
select lang as category, case when k <= floor(n * 0.8) then 'train' else 'val' end as split, 'item ' || source as item_name, count(*) as n from r join documents using (doc_id, lang) group by 1, 2, 3""")
def append_pairs(spark, sf_dir):
    """Pairs split and appended to two files, with a manifest that is read back."""
    path = folder(spark)
    answer = F.to_json(F.struct(F.concat(F.lit("item "), F.col("source")).alias("item_name")))
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.array(datasets.message("user", F.lit("u")), datasets.message("assistant", answer)).alias("messages"))
    datasets.append_pairs(pairs, "doc_id", path)
    listed = spark.read.options(header=True, escape='"').csv(f"{path}/manifest")
    train = spark.read.json(f"{path}/train").count()
    assert train == listed.where("split = 'train'").count()
    return listed.groupBy("category", "split", "item_name").agg(F.count("*").alias("n"))


@query(f"""select p_partkey as sample_id, 6 as n, md5('Do.' || chr(10) || chr(10) || 'Product listing:' || chr(10) || {ca.LISTING} || chr(10) || 'Price: ' || p_retailprice) as asked, 'That output failed validation:' || chr(10) || p_brand || chr(10) || chr(10) || 'Return only the corrected JSON object.' as told from part""")
def prompts(spark, sf_dir):
    """System message, example, question, and the request to correct a failed answer."""
    m = datasets.full_prompt("You extract.", [("x", "{}")], "Do.", F.col("catalog_content"), F.col("price"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), "p_brand").join(ca.listings(spark, sf_dir).select("sample_id", "catalog_content", "price"), "sample_id")
    told = datasets.retry_messages(F.col("m"), F.lit("bad"), F.col("p_brand"))
    return rows.select("sample_id", m.alias("m"), "p_brand").select("sample_id", told.alias("r"), "m").select("sample_id", F.size("r").alias("n"), F.md5(datasets.last_of_role(F.col("m"), "user")).alias("asked"), datasets.last_of_role(F.col("r"), "user").alias("told"))


@query("""select event_id, case when event_id % 5 = 0 then 5 when event_id % 3 = 0 then 5 when event_id % 2 = 0 then 4 else 3 end as score from events""")
def judge_scores(spark, sf_dir):
    """5 if both sides are empty or equal, else the judge's score, 3 where that can't be read."""
    i, none = F.col("event_id"), F.array().cast("array<string>")
    pred = F.when(i % 5 == 0, F.when(i % 2 == 0, none)).otherwise(F.array("event_type"))
    truth = F.when(i % 5 != 0, F.array(F.lit("x")))
    external = F.when(i % 2 == 0, F.lit("4")).when(i % 7 != 0, F.lit("no number"))
    return table(spark, sf_dir, "events").select("event_id", evaluate.judge_score(pred, truth, F.when(i % 3 == 0, 1.0).otherwise(0.2), external).alias("score"))


@query("select count(distinct source) as n from documents")
def distinct_sources(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "documents"), F.col("source"))


@query(" union ".join(f"select * from (select doc_id from documents where {c} order by md5('42:' || doc_id), doc_id limit 5)" for c in ("n_chars >= 2000", "n_chars between 300 and 1999", "n_chars < 300", "true")))
def union_of_draws(spark, sf_dir):
    """Five documents of each of four kinds, each once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    parts = [docs.where(c) for c in ("n_chars >= 2000", "n_chars between 300 and 1999", "n_chars < 300", "true")]
    return profile.draw_union(parts, docs, "doc_id", 5).select("doc_id")


@query("select event_type as system, count(*) > 0 and min(value) >= 0 and max(value) < 1000000 as passed from events where event_type = 'click' group by 1 union all select 'none', false")
def benchmark_checks(spark, sf_dir):
    """A result set passes if there are results and the check holds for each; an empty one fails."""
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    check = lambda: (F.col("value") >= 0) & (F.col("value") < 1000000)
    some = evaluate.check_results(rows, check).select(F.lit("click").alias("system"), "passed")
    return some.unionByName(evaluate.check_results(rows.where("false"), check).select(F.lit("none").alias("system"), "passed"))


@query("select count(*) as names, cast(sum(strlen(p_name) + 1) as bigint) as bytes from part")
def io_binary_files(spark, sf_dir):
    """Files found with their lengths; their contents are not read."""
    path = folder(spark)
    names = table(spark, sf_dir, "part").select("p_name")
    names.repartition(3).write.text(path)
    return files.read_images(spark, path, probe=False).agg(F.sum("length").alias("bytes")).crossJoin(names.agg(F.count("*").alias("names"))).select("names", "bytes")


@query("select cast(p_partkey as varchar) as sample_id, 'https://e.com/' || p_partkey as url, case when p_partkey % 3 = 0 then 'failed: no such page' else 'ok' end as status from part")
def io_downloads(spark, sf_dir):
    """Each row's download, by a hook, with its outcome."""

    def get(url: str) -> bytes:
        if int(url.rsplit("/", 1)[1]) % 3 == 0:
            raise OSError("no such page")
        return b"x"

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.concat(F.lit("https://e.com/"), F.col("p_partkey").cast("string")).alias("url"))
    return files.fetch(rows, "sample_id", "url", get, lambda i, content: None)


@query("""with s as (select case when p_partkey % 4 = 0 then 'exists' when p_partkey % 3 = 0 then 'not found' when p_partkey % 5 = 0 then 'timeout' when p_partkey % 7 = 0 then 'status 503' when p_partkey % 11 = 0 then 'failed' else 'ok' end as status from part)
select status, count(*) as n, status in ('ok', 'exists') as usable from s group by 1""")
def io_download_summary(spark, sf_dir):
    """Pooled downloads after a report of earlier ones, by kind of outcome."""

    def get(url: str) -> bytes:
        from urllib.error import HTTPError

        i = int(url.rsplit("/", 1)[1])
        if i % 3 == 0:
            raise HTTPError(url, 404, "none", None, None)
        if i % 5 == 0:
            raise TimeoutError
        if i % 7 == 0:
            raise HTTPError(url, 503, "busy", None, None)
        if i % 11 == 0:
            raise OSError("reset")
        return b"x"

    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(i.alias("sample_id"), F.concat(F.lit("https://e.com/"), i.cast("string")).alias("url"))
    report = rows.select("sample_id", F.when(F.col("sample_id") % 4 == 0, "ok").otherwise("timeout").alias("status"))
    return files.download_summary(files.fetch(rows, "sample_id", "url", get, lambda i, content: None, report=report))


@query("""select event_type, count(*) filter (where k is not null and value >= 0) as accepted, count(*) filter (where k is null or value < 0) as dead
from (select event_type, value, case when event_id % 10 <> 0 then try_cast(json_extract_string(props, '$.k') as bigint) end as k from events) group by 1""")
def stream_split(spark, sf_dir):
    """A stream of records written to accepted and dead-letter sinks, batch by batch, and read back."""
    from granary.streaming import events

    path = folder(spark)
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("oops")).otherwise(F.col("props"))
    table(spark, sf_dir, "events").withColumn("props", broken).write.parquet(f"{path}/in")
    events.split_sinks(events.read_events(spark, f"{path}/in"), f"{path}/ok", f"{path}/dead", f"{path}/state").awaitTermination()
    counts = [spark.read.parquet(f"{path}/{sink}").groupBy("event_type").agg(F.count("*").alias(name)) for sink, name in (("ok", "accepted"), ("dead", "dead"))]
    return counts[0].join(counts[1], "event_type", "full").select("event_type", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("dead", F.lit(0)).alias("dead"))


def raw_files(spark, sf_dir) -> int:
    """Files of the raw records: a million events each at most, so that no task writes or reads more of a larger table."""
    return max(4, cores(spark), -(-table(spark, sf_dir, "events").count() // 1_000_000))


def raw_topic(spark, sf_dir) -> DataFrame:
    """events as raw records: some broken, some without a product, a fifth twice, in no order."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    record = F.to_json(F.struct(F.when(i % 7 != 0, F.col("user_id").cast("string")).alias("product_id"), F.col("event_type").alias("item_name"), F.col("value").alias("price")))
    raw = e.select(F.when(i % 10 == 0, F.lit("{oops")).otherwise(record).alias("value"), i.alias("version"))
    return raw.unionByName(raw.where("version % 5 = 1")).repartition(raw_files(spark, sf_dir), F.md5(F.concat("value", F.col("version").cast("string"))))


@query("select cast(user_id as varchar) as product_id, max(event_id) as version, arg_max(event_type, event_id) as item_name, arg_max(value, event_id) as price from events where event_id % 10 <> 0 and event_id % 7 <> 0 and not coalesce(value < 0, false) group by 1")
def stream_latest(spark, sf_dir):
    """The last version of each product, held in state over several batches of late and repeated records."""
    from granary.streaming import topics

    path = folder(spark)
    raw_topic(spark, sf_dir).write.parquet(f"{path}/in")
    topics.keep_latest(topics.read_raw(spark, f"{path}/in", files=-(-raw_files(spark, sf_dir) // 2)), f"{path}/latest", f"{path}/state").awaitTermination()
    return topics.current(spark, f"{path}/latest").select("product_id", "version", "item_name", "price")


@query("select event_id as version, case when event_id % 10 = 0 then 'value: not a JSON record' when event_id % 7 = 0 then 'product_id: field required' when value < 0 then 'price: must be at least 0' end as error from events union all select event_id, case when event_id % 10 = 0 then 'value: not a JSON record' when event_id % 7 = 0 then 'product_id: field required' when value < 0 then 'price: must be at least 0' end from events where event_id % 5 = 1")
def stream_topics(spark, sf_dir):
    """Raw records split into extracted and failed ones, batch by batch; every record lands once."""
    from granary.sources import snapshots
    from granary.streaming import topics

    path = folder(spark)
    raw_topic(spark, sf_dir).write.parquet(f"{path}/in")
    topics.split(topics.read_raw(spark, f"{path}/in", files=-(-raw_files(spark, sf_dir) // 2)), f"{path}/out", f"{path}/state").awaitTermination()
    ok, failed = (snapshots.versions(spark, f"{path}/out", name) for name in ("extracted", "failed"))
    return ok.select("version", F.lit(None).cast("string").alias("error")).unionByName(failed.select("version", "error"))


# A hundred steps of expectation maximisation over eleven classes, as the label model takes them.
_M, _K = len(_CATEGORY), len(vocab.LABEL_CATEGORIES)
_LOGS = f"[list_sum([case when {{v}}[j] < 0 then 0 when {{v}}[j] = k then ln(acc[j]) else ln((1 - acc[j]) / {_K - 1}) end for j in range(1, {_M} + 1)]) for k in range({_K})]"
_CLASSES = f"""with recursive r as ({_VOTES}), patterns as (select category_votes as v, count(*)::double as n from r group by 1), em as (
  select 0 as step, [0.7::double for x in range({_M})] as acc
  union all select step + 1, (select [case when list_sum([p.n * (p.v[j] >= 0)::int for p in ps]) > 0 then
      least(0.99, greatest({1 / _K + 1e-3!r}, (list_sum([case when p.v[j] >= 0 then p.n * p.e[p.v[j] + 1] / list_sum(p.e) else 0 end for p in ps]) + 1.4) / (list_sum([p.n * (p.v[j] >= 0)::int for p in ps]) + 2)))
      else acc[j] end for j in range(1, {_M} + 1)]
    from (select list({{'v': v, 'n': n, 'e': [exp(x - list_max(l)) for x in l]}}) as ps from (select v, n, {_LOGS.format(v='v')} as l from patterns)))
  from em where step < 100
), final as (select acc from em where step = 100
), l as (select sample_id, category_votes as v, {_LOGS.format(v='category_votes')} as l from r, final
), e as (select sample_id, v, [exp(x - list_max(l)) for x in l] as e from l
), q as (select sample_id, v, [x / list_sum(e) for x in e] as p from e)
select sample_id, {text_list(vocab.LABEL_CATEGORIES)}[list_position(p, list_max(p))] as category, round(list_max(p), 3) as prob, case when round_even(list_max(p), 4) >= 0.85 then 'auto_accept' when round_even(list_max(p), 4) >= 0.5 then 'review' else 'auto_reject' end as status,
len([x for x in v if x >= 0]) as n_votes from q"""


@query(_CLASSES)
def weak_categories(spark, sf_dir):
    """The whole pipeline from listings to categories with probabilities and statuses; the twin fits the same model in SQL."""
    out = weak.run_pipeline(phrased(spark, sf_dir))
    return out.select("sample_id", "category", F.round("category_prob", 3).alias("prob"), F.col("category_status").alias("status"), "n_votes")


# ---- long lists of keywords ----------------------------------------------------------------------------------------
_STEMS = "select distinct item_id % 18 as k, unnest(regexp_extract_all(lower(text), '[a-z]{4}')) as w from benchmark"


def stems(spark, sf_dir) -> dict[str, list[str]]:
    """18 lists of keywords by rule: every four letters in a row of every benchmark item; 18 * 26 ** 4 at most, whatever the table."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4}"), F.lit(0)))
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 18).alias("k"), words.alias("w")).distinct().collect()
    return {f"list {k}": sorted(r.w for r in rows if r.k == k) for k in range(18)}


@query(f"""with s as ({_STEMS}), w as (select w, min(k) as k from s group by 1), d as (select doc_id, lower(text) as low from documents)
select doc_id, coalesce('list ' || (select min(k) from w where contains(low, w.w)), 'Unknown') as category from d""")
def keyword_category_lists(spark, sf_dir):
    """The category of every document by 18 long lists of keywords in order of priority."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_category(F.col("text"), stems(spark, sf_dir)).alias("category"))


@query(f"""with s as ({_STEMS}), d as (select doc_id, lower(text) as low from documents), hit as (select distinct k, doc_id from d join s on contains(low, w))
select 'list ' || k as category, (select count(*) from hit where hit.k = x.k)::bigint as n from (select unnest(range(18)) as k) x""")
def keyword_coverage_lists(spark, sf_dir):
    """Documents that hold a keyword of each of 18 long lists."""
    return profile.keyword_coverage(table(spark, sf_dir, "documents"), F.col("text"), stems(spark, sf_dir))


# ---- label model by moments ----------------------------------------------------------------------------------------
@query(ca._VOTED + """, c as (select doc_id, list_concat([-1], list_filter([case when votes[j] >= 0 then (j - 1) * 2 + votes[j] end for j in range(1, len(votes) + 1)], lambda x: x is not null)) as cells from v)
, a as (select doc_id, unnest(cells) as a from c), b as (select doc_id, a as b from a)
select a.a::integer as a, b.b::integer as b, count(*) as n from a join b using (doc_id) where a.a <= b.b group by all""")
def label_agreement(spark, sf_dir):
    """How often each two votes stand together: all that the label model by moments reads of the rows."""
    return weak.agreement(ca.voted(spark, sf_dir), 2)


@query()
def label_model_moments(spark, sf_dir):
    """Class probabilities of every document by the label model by moments."""
    df = ca.voted(spark, sf_dir)
    model = weak.fit_moments(df, 2, len(ca.RULES))
    return weak.predict(df, model, "votes").select("doc_id", F.round(F.get("probs", F.lit(1)), 4).alias("p1"))
