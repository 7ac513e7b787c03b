import json
import random
import re
import threading
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import fuzzy
from granary.operators import active, datasets, dedup, profile, validate, weak
from granary.operators import graph as gr
from granary.operators import vector as vc
from granary.plans import catalog, intent
from granary.sources import files, snapshots, tables
from granary.streaming import events


def test_similar_names_match_brute_force(spark, sf):
    df = catalog.fuzzy_names(spark, sf).where("pos < 150")
    got = {(r.duplicate, r.original) for r in dedup.similar(df, "item_name", "pos").collect()}
    rows = sorted((r.pos, " ".join(sorted(r.item_name.lower().split()))) for r in df.collect())
    want = set()
    for i, (p, a) in enumerate(rows):
        first = next((q for q, b in rows[:i] if fuzzy.ratio(a, b) >= dedup.SIMILAR), None)
        if first is not None:
            want.add((p, first))
    assert got == want and want


@pytest.mark.parametrize("least", [92.0, 80.0])
def test_similar_names_of_all_lengths(spark, least):
    """Short and long names, names of like bags, and names whose lengths differ by as much as the score allows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 7)))
    names = []
    for n in (1, 1, 2, 2, 3, 4, 6, 9, 18, 60):
        base = " ".join(word() for _ in range(n))
        names += [base, base.upper(), f"{base} {word()}"]
        for _ in range(4):
            chars = list(base)
            for _ in range(rng.randint(1, max(1, len(chars) // 9))):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "ab", "7"])
            names.append("".join(chars))
    names += ["", " ", None, "x", "x"]
    df = spark.createDataFrame(list(enumerate(names)), "pos long, item_name string")
    got = {(r.duplicate, r.original, round(r.similarity, 9)) for r in dedup.similar(df, "item_name", "pos", least).collect()}
    keys = [" ".join(sorted((x or "").lower().split())) for x in names]
    want = set()
    for i, a in enumerate(keys):
        first = next(((j, fuzzy.ratio(a, b)) for j, b in enumerate(keys[:i]) if a and b and fuzzy.ratio(a, b) >= least), None)
        if first:
            want.add((i, first[0], round(first[1], 9)))
    assert got == want and len(want) > 20


def test_candidates_are_a_small_share_of_pairs(spark):
    """What all names have in common brings few together. Names that differ in random characters still meet in a fixed share of pairs, so candidates of such names grow with their square."""
    n = 1000
    df = spark.range(n).select(F.concat(F.lit("large organic rolled oats "), F.sha2(F.col("id").cast("string"), 224).substr(1, 8)).alias("s"))
    assert dedup.candidates(df.withColumns({"n": F.length("s"), "id": F.xxhash64("s")})).count() <= 0.02 * n * (n - 1) / 2


def test_frequent_pieces_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"item {i % 40:02d} {'ab' * (i % 5)} of a longer shared name") for i in range(200)], "pos long, item_name string")
    whole = sorted(map(tuple, dedup.similar(df, "item_name", "pos").collect()))
    monkeypatch.setattr(dedup, "FEW", 0)
    monkeypatch.setattr(dedup, "PART", 7)
    assert sorted(map(tuple, dedup.similar(df, "item_name", "pos").collect())) == whole


def test_similar_names_in_blocks_and_by_keys(spark, monkeypatch):
    """Blocks of any size, one group or many, and the keys of longer names all find the same, at lengths around a word's 64 bits too."""
    rng = random.Random(8)
    texts = [f"{rng.choice(('red', 'old', 'cold'))} {rng.choice(('rod', 'rings', 'ring é'))} {rng.choice(('', 'x' * 40, 'xy' * 26, 'y' * 58))}{rng.randint(0, 3000)}" for _ in range(400)] + ["\U0001f600 1", "\U0001f600 1", "0", ""]
    df = spark.createDataFrame([(3 * i - 5, x) for i, x in enumerate(texts)], "pos int, item_name string")
    rows = [(3 * i - 5, " ".join(sorted(x.split()))) for i, x in enumerate(texts)]
    want = []
    for i, (p, a) in enumerate(rows):
        first = next(((p, q, fuzzy.ratio(a, b)) for q, b in rows[:i] if a and fuzzy.ratio(a, b) >= 92), None)
        want += [first] if first else []
    assert {len(a) > 64 for _, a in rows} == {True, False}
    for sizes in ({}, {"LEAST_BLOCK": 5, "BLOCK": 9, "GROUP": 20}, {"LEAST_BLOCK": 1, "BLOCK": 1}, {"PAIRS": 0}):
        for k, v in sizes.items():
            monkeypatch.setattr(dedup, k, v)
        out = dedup.similar(df, "item_name", "pos")
        assert sorted(map(tuple, out.collect())) == want and out.schema["original"].dataType == df.schema["pos"].dataType, sizes


def test_tables_of_other_threads_stay(spark):
    started, written = threading.Event(), threading.Event()
    kept = []

    def other():
        started.wait(60)
        kept.append(tables.materialize(spark.range(7)))
        written.set()

    t = threading.Thread(target=other)
    t.start()
    with tables.scratch(spark):
        mine = tables.materialize(spark.range(3))
        started.set()
        assert written.wait(120) and mine.count() == 3
    t.join()
    assert kept[0].count() == 7
    with pytest.raises(Exception, match=r"PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(mine._granary_path).count()


def test_exact_key_and_log(spark):
    df = spark.createDataFrame([(1, "Tea", "A", 1.0, "oz"), (2, " tea ", "a", 1.0, "OZ"), (3, "Tea", "A", 0.0, "oz"), (4, "Tea", "A", None, "oz")], "pos long, item_name string, brand string, quantity_value double, quantity_unit string")
    kept, log = dedup.deduplicate(df)
    assert sorted(r.pos for r in kept.collect()) == [1, 3]
    assert {(r.duplicate, r.original, r.match_type) for r in log.collect()} == {(2, 1, "exact"), (4, 3, "exact"), (3, 1, "fuzzy")}
    assert dedup.log_lines(log).first().similarity == "100.0"


LISTINGS = [
    (1, "Item Name: Organic Green Tea\nBullet Point 1: gluten free", 60.0, "x"),
    (2, "Item Name: Inorganic thing", 5.0, "http://a/steak.jpg"),
    (3, "Item Name: pure vegan cheese\ncontains soy and milk", 70.0, None),
    (4, "ok chips", None, None),
]


@pytest.fixture(scope="module")
def catalog_df(spark):
    return spark.createDataFrame(LISTINGS, "sample_id long, catalog_content string, price double, image_link string")


def test_labeling_functions(spark, catalog_df):
    text, price, link = F.col("catalog_content"), F.col("price"), F.col("image_link")
    diet, cat = weak.dietary_labelers(text, price), weak.category_labelers(text, link)
    assert (len(diet), len(cat)) == (18, 13)
    rows = {r.sample_id: {x.name: v for x, v in zip(diet + cat, r.votes, strict=True)} for r in weak.votes(catalog_df, diet + cat).collect()}
    assert rows[1]["lf_organic_keyword"] == 1 and rows[2]["lf_organic_keyword"] == -1
    assert rows[1]["lf_gluten_free_keyword"] == 1 and rows[1]["lf_category_coffee_tea"] == 2
    assert rows[2]["lf_image_url_coffee"] == 2  # "steak" holds "tea"
    assert rows[3]["lf_conflict_vegan_dairy"] == 0 and rows[3]["lf_allergen_implies_non_vegan"] == 0 and rows[3]["lf_price_premium_organic"] == 1
    assert rows[4]["lf_kosher_keyword"] == 1 and rows[4]["lf_category_snacks"] == 1  # the word "ok" votes kosher
    assert rows[4]["lf_price_premium_organic"] == -1


def matches_of(parsed) -> list[str]:
    """Texts that a parsed pattern matches: all alternatives, every separator as a no-break space and as a hyphen."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                own = [chr(arg)]
            case "IN":
                own = ["\u00a0", *(chr(a) for o, a in arg if str(o) == "LITERAL")]
            case "NOT_LITERAL":
                own = [" "]
            case "MAX_REPEAT":
                own = [m * n for m in matches_of(arg[2]) for n in {arg[0], max(arg[0], 1)}]
            case "SUBPATTERN":
                own = matches_of(arg[-1])
            case "BRANCH":
                own = [m for branch in arg[1] for m in matches_of(branch)]
            case "AT":
                own = [""]
        out = [a + b for a in out for b in own]
    return out


def test_words_leave_no_match_out(spark):
    """Only texts that hold a word of a pattern are searched by it: the votes are those of all patterns over all texts."""
    own = [p for _, _, p in weak.TAG_PATTERNS + weak.CATEGORY_PATTERNS] + [weak.VEGAN_CLAIM, weak.DAIRY_WORD, weak.PREMIUM_WORD, weak.CONTAINS_ANIMAL]
    found = [m for p in own for m in matches_of(re._parser.parse(p))]
    forms = [found, [m.upper() for m in found], [m.replace("i", "ı").replace("s", "ſ").replace("k", "\u212a") for m in found], [m.replace("i", "İ") for m in found], [f"x{m}" for m in found], [f"Vegan {m}\n" for m in found]]
    texts = [*(t for f in forms for t in f), *(x + y for x in ("ou", "steak ", "") for y in ("", "ſugar ", "nce", "\u0301")), None]
    rows = [(i, t, [None, 5.0, 60.0][i % 3], [None, "http://a/TEA.jpg"][i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "sample_id long, catalog_content string, price double, image_link string")
    text = F.col("catalog_content")
    plain = weak.votes(weak.votes(df, weak.category_labelers(text, F.col("image_link")), "c"), weak.dietary_labelers(text, F.col("price")), "d")
    want, got = ({r[0]: (r[1], r[2]) for r in x.collect()} for x in (plain.select("sample_id", "c", "d"), weak.listing_votes(df, "c", "d").select("sample_id", "c", "d")))
    assert got == want and len(got) == len(texts) > 1000
    assert all(any(v[k][j] >= 0 for v in got.values()) for k, n in enumerate((13, 18)) for j in range(n))


def test_letters_that_patterns_take_for_others(spark):
    """No letter but those that ``plain`` replaces is, ignoring case, a plain one to a pattern and none to a search for words."""
    points = spark.range(0x110000).where("id not between 55296 and 57343").repartition(8)
    chars = points.mapInPandas(lambda parts: (pd.DataFrame({"t": [chr(i) for i in p["id"]]}) for p in parts), "t string")
    low = chars.select(F.lower("t").alias("low"), weak.plain(F.col("t")).alias("plain"))
    odd = [weak.hits(F.col("low"), c) != F.contains("plain", F.lit(c)) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert low.where(reduce(or_, odd)).collect() == []
    assert low.where(weak.hits(F.col("low"), "[is]") & ~F.col("low").rlike("[is]")).count() > 0


def test_pipeline_and_all_abstain(spark, catalog_df):
    more = catalog_df.unionByName(spark.createDataFrame([(9, "nothing at all", 1.0, "y")], catalog_df.schema))
    assert {r.sample_id for r in weak.run_pipeline(more, shared=True, moments=True).collect()} == {r.sample_id for r in more.collect()}
    rows = {r.sample_id: r for r in weak.run_pipeline(more).collect()}
    assert rows[9].category == "Beverages" and rows[9].category_status == "auto_reject" and rows[9].n_votes == 0
    assert rows[9].category_prob == pytest.approx(1 / 11, abs=1e-4)
    assert rows[9].tag_statuses["cruelty-free"] == "review"
    assert rows[1].category == "Coffee & Tea"


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 20_000)
    acc = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, 1 - truth) for a in acc], axis=1)
    keys, n = np.unique(votes, axis=0, return_counts=True)
    m = weak.fit_patterns({tuple(map(int, k)): int(c) for k, c in zip(keys, n, strict=True)}, 2, epochs=500)
    assert np.abs(m.accuracy - acc).max() < 0.05


def planted_votes(acc, cover, n=100_000, seed=3, balance=(0.5, 0.5)):
    """True classes and votes of independent labelers that abstain at random."""
    rng = np.random.default_rng(seed)
    truth = (rng.random(n) >= balance[0]).astype(int)
    votes = [np.where(rng.random(n) < c, np.where(rng.random(n) < a, truth, 1 - truth), -1) for a, c in zip(acc, cover, strict=True)]
    return truth, np.stack(votes, axis=1)


def matrix_of(v, classes):
    """Rows and joint counts, vote by vote."""
    cells = (v[:, :, None] == np.arange(classes)).reshape(len(v), -1).astype(float)
    return len(v), cells.T @ cells


@pytest.mark.parametrize("balance", [(0.5, 0.5), (0.3, 0.7)])
def test_moments_recover_planted_accuracies(balance):
    acc, cover = [0.92, 0.85, 0.78, 0.7, 0.66, 0.88], [1.0, 0.8, 0.6, 0.9, 0.7, 0.3]
    truth, v = planted_votes(acc, cover, balance=balance)
    m = weak.fit_agreement(*matrix_of(v, 2), 2, balance)
    assert np.abs(m.accuracy - acc).max() < 0.02
    better = (m.posterior(v).argmax(axis=1) == truth).mean()
    assert better > max((v[:, j] == truth)[v[:, j] >= 0].mean() * cover[j] for j in range(6))


def test_moments_leave_dependent_voters_out():
    acc, cover = [0.9, 0.8, 0.75, 0.7, 0.65], [1.0] * 5
    _, v = planted_votes(acc, cover)
    rng = np.random.default_rng(9)
    echo = np.where(rng.random(len(v)) < 0.95, v[:, 4], 1 - v[:, 4])  # the fifth labeler's votes, nearly copied
    v, acc = np.column_stack([v, echo]), [*acc, 0.65 * 0.95 + 0.35 * 0.05]
    assert np.abs(weak.fit_agreement(*matrix_of(v, 2), 2, dependent=[(4, 5)]).accuracy - acc).max() < 0.02
    assert np.abs(weak.fit_agreement(*matrix_of(v, 2), 2).accuracy - acc).max() > 0.05  # what the pair hides if it isn't named


def test_moments_of_columns(spark):
    """The matrix of a column is that of the rows one by one; null lists, rows that only abstain, silent labelers and empty tables have defined results."""
    _, v = planted_votes([0.9, 0.8, 0.7], [0.9, 0.5, 0.2], n=2000)
    v = np.column_stack([v, np.full(len(v), -1)])
    rows = [([int(x) for x in r],) for r in v] + [([-1] * 4,)] * 5
    df = spark.createDataFrame([*rows, (None,)], "votes array<int>").repartition(5)
    total, together = weak.agreement_matrix(weak.agreement(df, 2), 4, 2)
    assert total == 2005 and (together == matrix_of(v, 2)[1]).all()
    m = weak.fit_moments(df, 2, 4)
    assert np.isnan(m.accuracy[3]) and np.allclose(m.posterior(np.full((1, 4), -1)), 0.5) and np.allclose(m.posterior(np.array([[-1, -1, -1, 1]])), 0.5)
    again = weak.fit_moments(df.repartition(2), 2, 4)
    assert (again.rates == m.rates).all()
    none = weak.fit_moments(df.limit(0), 2, 4)
    assert np.allclose(none.posterior(np.array([[1, 0, -1, 1]])), 0.5)
    labelers = [weak.Labeler(str(j), F.lit(True), 1, "vegan") for j in range(4)]
    tagged = weak.label_tags(df.where("votes is not null"), labelers, ["vegan", "kosher"], moments=True)
    assert all(r.tag_probs["kosher"] == 0.5 and 0 <= r.tag_probs["vegan"] <= 1 for r in tagged.collect())


def test_active_learning(spark):
    rows = [
        (1, "a", 0.5, "review", '{"x": 0.5}', '{"x": "auto_accept", "y": "auto_reject"}'),
        (2, "a", 0.9, "review", "bad", "bad"),
        (3, None, 0.9, "review", '{"x": 1.0}', "{}"),
        (4, "b", 0.99, "auto_accept", "{}", "{}"),
    ]
    df = spark.createDataFrame(rows, "sample_id long, category string, category_prob double, category_status string, tag_probs string, tag_statuses string").withColumn("dietary_tags", F.lit(""))
    names = spark.createDataFrame([(1, "Item Name: One"), (3, "no name here")], "sample_id long, catalog_content string")
    q = active.review_queue(df, names, 10).collect()
    assert [r.sample_id for r in q] == [1, 2, 3] and q[0].item_name == "One" and q[2].item_name == "no name here"
    assert q[0].uncertainty_score == 1.0 and "entropy=1.00" in q[0].reason and "LF conflict" in q[0].reason
    assert q[2].rarity_score == 0.0
    assert active.review_queue(df.limit(0), names, 5).count() == 0


def test_graph_build_and_nulls(spark):
    rows = [
        (1, "p", "Old", "B1", "C1", 5.0, ["t1"], ["Milk"], 0.5), (2, "p", "New", "B2", "C1", 6.0, ["t2 "], None, 0.5),
        (3, "q", "Q", " ", None, None, None, [], None),
    ]
    df = spark.createDataFrame(rows, "pos long, product_id string, item_name string, brand string, category string, price double, dietary_tags array<string>, allergen_list array<string>, extraction_confidence double")
    df = df.withColumns({"quantity_value": F.lit(None).cast("double"), "quantity_unit": F.lit(None).cast("string"), "catalog_content": F.lit("c")})
    g = gr.build(df)
    assert {(r.product_id, r.item_name) for r in g.products.collect()} == {("p", "New"), ("q", "Q")}
    assert {tuple(r) for r in g.brand_edges.collect()} == {("p", "B1"), ("p", "B2")}
    assert {tuple(r) for r in g.tag_edges.collect()} == {("p", "t1"), ("p", "t2")}
    assert {tuple(r) for r in g.allergen_edges.collect()} == {("p", "milk")}
    assert {tuple(r) for r in g.category_edges.collect()} == {("p", "C1"), ("q", "Unknown")}
    assert [r.product_id for r in gr.cheapest_first(g.products, 5).collect()] == ["p", "q"]
    assert [r.product_id for r in gr.cheapest_first(g.products, None).collect()] == ["p", "q"]
    assert {r.kind: r.n for r in gr.summary(g).collect()}["tag_edges"] == 2
    assert gr.get_product_detail(g, "none").count() == 0
    assert gr.duplicates_of_key(g.products, "product_id").count() == 0


def test_hybrid_dispatch(spark, sf):
    g, v = catalog.product_graph(spark, sf), catalog.vectors(spark, sf)
    a = vc.hybrid(g, v, catalog.probe(), 5, max_price=0, tags=[]).collect()
    b = vc.semantic_first(g, v, catalog.probe(), 5).collect()
    assert a == b
    assert all(-1 <= r.score <= 1 for r in a)


def test_retries(spark):
    df = spark.createDataFrame([("1", "nope"), ("2", json.dumps({"item_name": "Tea", "price": 1.0, "extraction_confidence": 0.6}))], "product_id string, answer string")
    fixed = json.dumps({"item_name": "Fixed", "price": 2.0, "extraction_confidence": 0.9, "dietary_tags": ["Plant-Based", "vegan"]})
    told = []

    def again(failed):
        told.extend(r.retry_message for r in failed.collect())
        return failed.withColumn("answer", F.lit(fixed))

    ok, bad = validate.with_retries(df, "answer", "product_id", again, attempts=2)
    assert {(r.product_id, r.attempt, r.entity.item_name) for r in ok.collect()} == {("1", 2, "Fixed"), ("2", 1, "Tea")}
    assert bad.count() == 0 and "not valid JSON" in told[0]
    assert [r.entity.dietary_tags for r in ok.collect() if r.product_id == "1"] == [["vegan"]]
    letters = validate.dead_letters(validate.validate(df, "answer", "product_id").withColumn("attempt", F.lit(1)).where("step is not null"))
    assert letters.first().step == "json_parse"


@pytest.mark.parametrize(("record", "step"), [({"price": 1.0}, "pydantic"), ({"item_name": " x ", "price": 1.0, "extraction_confidence": 1.0}, "pydantic"), ({"item_name": "xy", "price": 1.0, "extraction_confidence": 0.59}, "confidence"), ({"item_name": "xy", "price": 0.0, "extraction_confidence": 0.6}, None)])
def test_validation_steps(spark, record, step):
    df = spark.createDataFrame([("1", "```json\n" + json.dumps(record) + "\n```")], "product_id string, answer string")
    assert validate.validate(df, "answer", "product_id", fuzzy=False).first().step == step


def test_validation_of_odd_rows(spark):
    """Nulls, empty answers, clashing columns, long texts, visual attributes; the packaging rule counts."""
    full = {"item_name": "Tea", "price": 1.0, "extraction_confidence": 0.9}
    rows = [
        (1, None), (2, ""), (3, "[]"), (4, json.dumps(full)), (4, json.dumps(full)), (None, json.dumps(full)), (5, json.dumps(full | {"item_name": "x" * 501})),
        (6, json.dumps(full | {"visual": {"packaging_type": "jar"}, "bullet_points": ["", " "]})), (7, json.dumps(full | {"visual": {"packaging_type": "crate"}})),
    ]
    df = spark.createDataFrame(rows, "pid long, answer string").withColumns({c: F.lit("mine") for c in ("step", "error", "entity", "item_name", "_p", "record")})
    out = validate.validate(df, "answer", "pid", fuzzy=False)
    assert set(out.columns) == set(df.columns)
    got = sorted(((r.pid, r.step, r.entity and r.entity.quality_score, r.entity and r.entity.content_tier) for r in out.collect()), key=str)
    want = [(1, "json_parse", None, None), (2, "json_parse", None, None), (3, "json_parse", None, None), (4, None, 20, "bare"), (4, None, 20, "bare"), (5, "pydantic", None, None), (6, None, 25, "bare"), (7, "pydantic", None, None), (None, "pydantic", None, None)]
    assert got == sorted(want, key=str)
    assert validate.validate(df.limit(0), "answer", "pid", fuzzy=False).count() == 0


def test_bad_tags_break_a_record(spark):
    e = F.struct(
        F.lit("1").alias("product_id"), F.lit("Tea").alias("item_name"), F.lit(1.0).alias("price"), F.array(F.lit("vegan"), F.lit("bogus")).alias("dietary_tags"), F.array(F.lit(" MILK ")).alias("allergen_list"),
        *(F.lit(None).cast("string").alias(c) for c in ("brand", "category", "quantity_unit", "description", "image_url")), *(F.lit(None).cast("double").alias(c) for c in ("quantity_value", "pack_size", "extraction_confidence")),
        F.lit(None).cast(validate.VISUAL).alias("visual"),
    )
    assert spark.range(1).select(validate.field_errors(e).alias("e")).first().e == ["dietary_tags: not in the vocabulary"]


def test_retries_ask_once_a_round(spark):
    asked = spark.sparkContext.accumulator(0)

    def again(failed):
        def fix(batches):
            for b in batches:
                asked.add(len(b))
                b["answer"] = [a if n < 2 else json.dumps({"item_name": "Tea", "price": 1.0, "extraction_confidence": 0.9}) for a, n in zip(b["answer"], b["attempt"], strict=True)]
                yield b[["product_id", "answer"]]

        return failed.mapInPandas(fix, "product_id string, answer string")

    df = spark.createDataFrame([("1", "nope"), ("2", "{}")], "product_id string, answer string")
    ok, bad = validate.with_retries(df, "answer", "product_id", again)
    assert {(r.product_id, r.attempt) for r in ok.collect()} == {("1", 3), ("2", 3)} and ok.count() == 2 and bad.count() == 0
    assert asked.value == 4  # two rows in two rounds, whatever was counted and collected after


def test_quotas_and_synthetic(spark):
    assert datasets.quotas({"a": 90, "b": 10}, 50) == {"a": 45, "b": 10} or sum(datasets.quotas({"a": 90, "b": 10}, 50).values()) <= 55
    assert datasets.quotas({}, 5) == {}
    assert datasets.synthetic_quotas(["a", "b", "c"], 500) == {"a": 50, "b": 50}
    df = datasets.synthetic_listings(spark, {"Beverages": 5}, ["fine"], {"Beverages": ["juice"]}, ["Acme"], ["oz"], ["vegan"])
    from granary.functions.text import parse_listing

    got = df.select("item_name", "quantity_value", parse_listing(F.col("catalog_content")).alias("p")).collect()
    assert len(got) == 5 and all(r.p.item_name == r.item_name and r.p.value == r.quantity_value for r in got)


def test_stratified_sample_size(spark):
    df = spark.range(300).select(F.col("id").alias("sample_id"))
    labels = df.select("sample_id", F.when(F.col("sample_id") < 200, "a").otherwise("b").alias("category"), F.when(F.col("sample_id") < 250, "auto_accept").otherwise("review").alias("category_status"))
    one, two = (sorted(r[0] for r in datasets.stratified_sample(df, labels, 60).collect()) for _ in range(2))
    assert one == two and len(one) == 60 == len(set(one))


def test_messages(spark):
    p = F.struct(F.lit("Tea").alias("item_name"), F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("quantity_value"), F.lit(None).cast("string").alias("quantity_unit"), F.lit("Beverages").alias("category"), F.lit(None).cast("array<string>").alias("dietary_tags"), F.lit(None).cast("array<string>").alias("allergen_list"), F.lit(None).cast("double").alias("extraction_confidence"))
    m = datasets.training_pair("sys", "Extract.", F.lit(" Tea\n"), F.lit(2.5), p)
    r = spark.range(1).select(m.alias("m")).select("m", datasets.roles_complete(F.col("m")).alias("ok"), datasets.retry_messages(F.col("m"), F.lit("bad"), F.lit("why")).alias("r")).first()
    assert r.ok and r.m[1].content == "Extract.\n\nProduct listing:\nTea\nPrice: 2.5" and len(r.r) == 5
    assert json.loads(r.m[2].content)["quantity_unit"] == "ct"


def test_profile(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "v double")
    assert [tuple(r) for r in profile.histogram(df, F.col("v"), 4).collect()] == [(0, 1.0, 3)]
    assert profile.histogram(df.limit(0), F.col("v")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sample_id,catalog_content,image_link,price\n1,"Item Name: ""X""\nUnit: oz",u,1.5\n')
    assert files.read_catalog(spark, str(tmp_path / "a.csv")).first().catalog_content == 'Item Name: "X"\nUnit: oz'
    line = {"sample_id": "7", "catalog_content": "c", "price": 1.0, "bucket": "high_conf", "prediction": {"item_name": "T", "dietary_tags": ["vegan"]}}
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(line), "{bad", "", json.dumps(line | {"bucket": "low"})]))
    df = files.read_products(spark, str(tmp_path / "b.jsonl"))
    assert df.count() == 1 and files.records(df).first().product_id == "7"
    g = gr.build(files.records(df))
    files.write_graph(g, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g")).products.count() == 1
    files.write_checkpoint(spark.createDataFrame([(1, True), (2, False)], "id long, success boolean"), str(tmp_path / "c"))
    left = datasets.resume(spark.range(1, 4), spark.read.parquet(str(tmp_path / "c")), "id")
    assert sorted(r.id for r in left.collect()) == [2, 3]


def test_json_lines_keep_file_order(spark, tmp_path):
    """Files of very uneven sizes, which Spark packs by size: positions go by file name, then by line."""
    n = 0
    for k, size in enumerate([5, 3000, 1, 40]):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(json.dumps({"sample_id": str(n + i), "bucket": "x" * 300}) + "\n{bad\n\n" for i in range(size)))
        n += size
    rows = files.read_json_lines(spark, str(tmp_path)).select("pos", "sample_id").collect()
    assert [int(r.sample_id) for r in sorted(rows)] == list(range(n))


def test_upserts(spark, tmp_path):
    def graph(rows):
        df = spark.createDataFrame(rows, "pos long, product_id string, item_name string, brand string, category string, price double")
        none = F.lit(None)
        more = {c: none.cast("array<string>") for c in ("dietary_tags", "allergen_list")} | {"quantity_value": none.cast("double"), "quantity_unit": none.cast("string"), "catalog_content": F.lit(""), "extraction_confidence": F.lit(0.5)}
        return gr.build(df.withColumns(more))

    path = f"file://{tmp_path}/g"
    files.write_graph(graph([(1, "a", "Old", "B1", "C", 1.0), (2, "b", "Stays", "B1", "C", 2.0)]), path)
    files.write_graph(graph([(1, "a", "New", "B2", "C", 3.0), (2, "c", "More", "B1", "C", 4.0)]), path)
    g = files.read_graph(spark, path)
    assert {(r.product_id, r.item_name) for r in g.products.collect()} == {("a", "New"), ("b", "Stays"), ("c", "More")}
    assert {tuple(r) for r in g.brand_edges.collect()} == {("a", "B1"), ("a", "B2"), ("b", "B1"), ("c", "B1")}
    points = lambda rows: spark.createDataFrame(rows, "point_id long, category string, price double")
    files.write_vectors(points([(1, "x", 1.0), (2, "x", 2.0)]), f"{path}/v")
    files.write_vectors(points([(2, "y", 3.0), (3, "z", 4.0)]), f"{path}/v")
    assert {tuple(r) for r in files.read_vectors(spark, f"{path}/v").collect()} == {(1, "x", 1.0), (2, "y", 3.0), (3, "z", 4.0)}


def stored_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_an_upsert_writes_what_is_new(spark, tmp_path):
    """1 % of the points cost about 1 % of the bytes; compaction and clearing keep the rows."""
    path, here = f"file://{tmp_path}/v", tmp_path / "v"
    points = spark.range(100_000).select(F.col("id").alias("point_id"), F.lit("c").alias("category"), F.rand(1).alias("price"))
    files.write_vectors(points, path)
    before = stored_bytes(here)
    files.write_vectors(points.where("point_id % 100 = 7").withColumn("category", F.lit("new")), path)
    assert stored_bytes(here) - before < 0.05 * before
    want = [("c", 99_000), ("new", 1_000)]
    count = lambda: sorted(map(tuple, files.read_vectors(spark, path).groupBy("category").count().collect()))
    assert count() == want
    snapshots.compact(spark, path, {"points": "point_id"})
    assert count() == want and len(snapshots.current(spark, path)[1]) == 1
    assert len(snapshots.vacuum(spark, path)) == 2 and count() == want and snapshots.vacuum(spark, path) == []


@pytest.mark.parametrize("fails_at", [0, 1, 4, "commit"])
def test_a_writer_that_dies_leaves_the_graph_before_it(spark, tmp_path, monkeypatch, fails_at):
    path, ids = f"file://{tmp_path}/g", spark.range(100).withColumnRenamed("id", "product_id")
    edges = (ids.select("product_id", F.concat(F.lit(k), F.col("product_id") % 7).alias(k)) for k in ("brand", "category", "tag", "allergen"))
    g = gr.Graph(ids.select("product_id", F.lit("a").alias("item_name"), F.lit(1.0).alias("price")), *edges)
    with pytest.raises(FileNotFoundError):
        files.read_graph(spark, path)
    part = gr.Graph(*(df.where("product_id < 50") for df in (g.products, g.brand_edges, g.category_edges, g.tag_edges, g.allergen_edges)))
    files.write_graph(part, path)
    rows = lambda: [sorted(map(str, getattr(files.read_graph(spark, path), n).collect())) for n in files.GRAPH]
    before = rows()

    def die(*_):
        raise OSError("lost")

    if fails_at == "commit":
        monkeypatch.setattr(snapshots, "commit", die)
        broken = g
    else:
        bad = F.raise_error(F.lit("lost")).cast("long")
        tables = [getattr(g, n) for n in files.GRAPH]
        tables[fails_at] = tables[fails_at].withColumn("product_id", bad)
        broken = gr.Graph(*tables)
    with pytest.raises(Exception, match="lost"):
        files.write_graph(broken, path)
    assert rows() == before
    monkeypatch.undo()
    files.write_graph(g, path)
    assert len(rows()[0]) == g.products.count() and rows()[1] == sorted(map(str, g.brand_edges.distinct().collect()))


def test_writers_that_meet_both_count(spark, tmp_path):
    """A number is committed once; the loser appends to the winner's snapshot, and a compaction that lost changes nothing."""
    path = f"file://{tmp_path}/v"
    points = lambda k: spark.createDataFrame([(k, "x", 1.0), (None, f"n{k}", 0.0)], "point_id long, category string, price double")
    threads = [threading.Thread(target=files.write_vectors, args=(points(k), path)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, parts = snapshots.current(spark, path)
    assert number == 4 and len(set(parts)) == 4
    got = files.read_vectors(spark, path).collect()
    assert sorted(r.point_id for r in got if r.point_id is not None) == [0, 1, 2, 3] and len(got) == 5
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, number, parts[:1])
    assert snapshots.current(spark, path) == (number, parts)
    assert sorted(p.name for p in (tmp_path / "v" / "commits").iterdir() if not p.name.startswith(".")) == [f"{k:012d}" for k in range(1, 5)]


def test_append_pairs(spark, tmp_path):
    m = F.array(datasets.message("user", F.lit("u")), datasets.message("assistant", F.to_json(F.struct(F.concat(F.lit("Item "), F.col("id").cast("string")).alias("item_name")))))
    pairs = spark.range(50).select("id", m.alias("messages"), F.lit("Beverages").alias("category"))
    for _ in range(2):
        assert datasets.append_pairs(pairs, "id", f"file://{tmp_path}").count() == 50
    assert spark.read.json(f"{tmp_path}/train").count() == 80 and spark.read.json(f"{tmp_path}/val").count() == 20
    assert spark.read.option("header", True).csv(f"{tmp_path}/manifest").groupBy("split").count().count() == 2


def test_many_patterns_are_fitted_where_they_lie(spark, monkeypatch):
    df = spark.range(2000).select(F.array(*(F.when(F.xxhash64("id", F.lit(j)) % 5 == 0, -1).otherwise((F.xxhash64("id", F.lit(j + 9)) % 3 != 0).cast("int")) for j in range(6))).cast("array<int>").alias("votes"))
    few = weak.fit(df, 2)
    monkeypatch.setattr(weak, "MOST_PATTERNS", 20)
    assert np.allclose(weak.fit(df, 2).accuracy, few.accuracy)
    labelers = [weak.Labeler(str(j), F.lit(True), 1, "vegan") for j in range(6)]
    tagged = weak.label_tags(df, labelers, ["vegan", "kosher"]).first().tag_probs
    assert tagged["kosher"] == 0.5 and 0 < tagged["vegan"] < 1


def test_domains():
    from granary.sources import adapter

    assert adapter.domain("b2b").brand_aliases["robert bosch"] == "Bosch" and "Class 9" in adapter.domain("b2b").hazmat_classes
    h = adapter.domain("healthcare")
    assert h.ingredient_aliases["tylenol"] == "Paracetamol" and h.dosage_form_aliases["susp"] == "Suspension" and "Schedule H1" in h.schedule_classes
    assert adapter.domain("retail").brand_aliases["kize"] == "KiZE Bars" and adapter.domain("retail").compliance_fields == ["allergen_list", "dietary_tags"]


def test_runners(spark, sf):
    q = "Vegan snacks and drinks under $20, non-gmo"
    assert intent.constraints(q, "graph") == {"tags": ["vegan", "non-GMO"], "category": "Snacks & Candy", "max_price": 20.0}
    assert intent.constraints(q, "hybrid") == {"tags": ["vegan", "non-GMO"], "category": "Beverages", "max_price": 20.0}
    assert intent.repair({"category": "dairy & eggs", "dietary_tags": ["HALAL", "x"], "exclude_allergens": ["Milk"]}, "q") == {"category": "Dairy & Eggs", "tags": ["halal"], "exclude_allergens": ["milk"], "semantic_query": "q"}
    g = catalog.product_graph(spark, sf)
    assert intent.graph_only(g, "analytics", "Which category has the most products?").count() == 5
    assert intent.graph_only(g, "analytics", "highest average price").count() == 3
    assert intent.graph_only(g, "semantic", "anything").count() == 10


def test_sql_fallback(spark, sf):
    g = catalog.product_graph(spark, sf)
    ask = lambda sql: intent.Engine(g, to_sql=lambda q, e: sql).plan("tell me something")
    assert ask("select count(*) as n from products").first().n == 200
    with pytest.raises(PermissionError):
        ask("drop table products")
    with pytest.raises(ValueError, match="top_k"):
        intent.Engine(g).search(top_k=51)


def test_intents():
    assert intent.parse("Which brand has the most products?").kind == "analytics"
    e = intent.parse("vegan snacks under $20 without milk").entities
    assert e == {"tags": ["vegan"], "category": "Snacks & Candy", "max_price": 20.0, "exclude_allergens": ["milk"]}
    assert intent.canonical(["NON-gmo", "x"], ["non-GMO"]) == ["non-GMO"]


def test_engine(spark, sf):
    g, v = catalog.product_graph(spark, sf), catalog.vectors(spark, sf)
    e = intent.Engine(g, v, lambda q: catalog.probe())
    out = e.query("show similar products")
    assert out["error"] is None and out["results"] and out["answer"]
    assert e.query("how many products by brand")["results"][0]["product_count"] > 0
    assert e.product(1)["item_name"] and e.product(-5) is None
    assert e.health() == {"products": True, "vectors": True}
    assert e.overview()["totals"].first().total_brands <= 25
    with pytest.raises(ValueError, match="3 to 500"):
        e.plan("x")


def test_written_queries_read_the_views_only(spark, sf):
    g = catalog.product_graph(spark, sf)
    views = {name: getattr(g, own) for name, own in intent.VIEWS.items()}
    spark.range(3).createOrReplaceTempView("products")
    spark.range(3).createOrReplaceTempView("others")
    ok = [
        "select count(*) as n from products", "with t as (select brand from brands) select count(*) as n from t", "select 1 as n",
        "select (select count(*) from tags) as n from products limit 1", "select count(*) as n from products where product_id in (select product_id from allergens)",
    ]
    for sql in ok:
        assert len(intent.run_query(spark, sql, views).collect()) == 1
    bad = [
        "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'lineSeparator')", "select * from text.`/etc/hostname`", "select * from others",
        "select (select max(value) from text.`/etc/hostname`) from products", "select * from products where exists (select 1 from others)", "with t as (select * from others) select * from t",
        "select count(*) from products where item_name = (select try_reflect('java.lang.System', 'lineSeparator'))", "with t as (select 1) insert into x select * from t", "select * from range(10)", "select input_file_name() from products", "", None,
    ]
    for sql in bad:
        with pytest.raises(PermissionError):
            intent.run_query(spark, sql, views)
    assert spark.table("products").count() == 3 and spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    spark.catalog.dropTempView("products")
    assert not spark.catalog.tableExists("brands")


def test_exclusions_stand_as_words():
    assert "exclude_allergens" not in intent.parse("a casino milk shake under $9").entities
    assert intent.parse("a shake with no milk under $9").entities["exclude_allergens"] == ["milk"]


def test_read_only(spark):
    assert intent.read_only(spark, "select 1")
    assert not intent.read_only(spark, "drop table x") and not intent.read_only(spark, "insert into x select 1") and not intent.read_only(spark, "oops oops")


def test_stream_split(spark, sf, tmp_path):
    src = tmp_path / "in"
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("props", F.when(F.col("event_id") % 10 == 0, "oops").otherwise(F.col("props")))
    df.write.parquet(str(src))
    q = events.split_sinks(events.read_events(spark, str(src)), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 100 and spark.read.parquet(str(tmp_path / "ok")).count() == df.count() - 100


def test_embed_and_points(spark):
    df = spark.createDataFrame([("a", 1, "tea"), ("b", 2, None)], "sample_id string, pos long, item_name string")
    v = vc.embed(df, "item_name", lambda texts: [[len(t), 1.0] for t in texts], batch=1)
    assert {r.sample_id: r.vector for r in v.collect()} == {"a": [3.0, 1.0], "b": None}
    full = df.withColumns({"brand": F.lit("x"), "category": F.lit(None).cast("string"), "price": F.lit(None).cast("double"), "dietary_tags": F.array(F.lit("vegan")), "allergen_list": F.lit(None).cast("array<string>"), "quantity_value": F.lit(1.0), "quantity_unit": F.lit("oz"), "extraction_confidence": F.lit(0.87)})
    p = vc.points(full, v.select("sample_id", "vector"))
    got = vc.search(p, [1.0, 0.0], 5, category="Unknown", max_price=0.0, dietary_tags=["vegan"]).collect()
    assert {r.product_id for r in got} == {"a", "b"} and got[0].quality_score == 87 and all(0 <= r.point_id < 1 << 53 for r in got)


def test_fetch_reports_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no")
        return b"x"

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "sample_id long, url string")
    assert {r.sample_id: r.status for r in files.fetch(df, "sample_id", "url", get, lambda i, b: None).collect()} == {"1": "ok", "2": "failed: no"}


def test_pooled_downloads(spark, tmp_path):
    """Ten at once and three a host, statuses by kind, and a restart that downloads nothing twice; calls are counted by files."""
    import time
    import uuid
    from urllib.error import HTTPError

    calls, store = tmp_path / "calls", tmp_path / "store"
    calls.mkdir()
    store.mkdir()

    def get(url):
        began = time.time()
        name = calls / uuid.uuid4().hex
        number = int(url.rsplit("/", 1)[1])
        time.sleep(0.03)
        name.write_text(f"{url} {began} {time.time()}")
        if number % 10 == 1:
            raise HTTPError(url, 404, "none", None, None)
        if number % 10 == 2:
            raise HTTPError(url, 503, "busy", None, None)
        if number % 10 == 3:
            raise TimeoutError
        return b"x"

    keep = lambda i, content: (store / i).write_bytes(content)
    have = lambda i: (store / i).exists()
    rows = spark.range(120, numPartitions=1).select(F.col("id").alias("sample_id"), F.concat(F.lit("https://host"), F.col("id") % 5, F.lit("/"), F.col("id")).alias("url"))
    rows = rows.unionByName(spark.createDataFrame([(500, None)], "sample_id long, url string")).coalesce(1)
    first = {r.sample_id: r.status for r in files.fetch(rows, "sample_id", "url", get, keep, have, per_host=3).collect()}
    want = {1: "not found", 2: "status 503", 3: "timeout"}
    assert first == {str(i): want.get(i % 10, "ok") for i in range(120)} | {"500": "failed: no URL"}
    spans = [(u.split("/")[2], float(a), float(b)) for u, a, b in (f.read_text().split() for f in calls.iterdir())]
    assert len(spans) == 120
    at_once = [[h for h, a, b in spans if a <= t < b] for _, t, _ in spans]
    assert 5 <= max(map(len, at_once)) <= 10 and max(max(x.count(h) for h in set(x)) for x in at_once if x) <= 3
    again = files.fetch(rows.repartition(3), "sample_id", "url", get, keep, have).collect()
    assert len(list(calls.iterdir())) == 120 + 36  # the failures alone
    assert {r.sample_id: r.status for r in again} == {i: "exists" if s == "ok" else s for i, s in first.items()}
    third = files.fetch(rows, "sample_id", "url", get, keep, report=spark.createDataFrame(again)).collect()
    assert len(list(calls.iterdir())) == 120 + 72 and sorted(third) == sorted(again)
    summary = {r.status: (r.n, r.usable) for r in files.download_summary(spark.createDataFrame(third)).collect()}
    assert summary == {"exists": (84, True), "not found": (12, False), "status 503": (12, False), "timeout": (12, False), "failed": (1, False)}
    assert files.fetch(rows.where("false"), "sample_id", "url", get, keep).count() == 0


def test_full_prompt(spark):
    m = datasets.full_prompt("s", [("x", "{}")], "Do.", F.lit("Price: 3"), F.lit(2.0))
    r = spark.range(1).select(m.alias("m")).first().m
    assert [x.role for x in r] == ["system", "user", "assistant", "user"] and r[3].content.endswith("Price: 3")
