import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import fuzzy, vocab
from granary.functions import normalize as nz
from granary.functions import scoring as sc
from granary.functions import text as tx
from granary.operators import profile
from granary.sources import adapter


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abñ ", max_size=12), st.text("abñ ", max_size=12))
def test_lcs(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)


def test_units(spark):
    raw = ["Ounces", " kg ", "l", "pack", "None", "", None, "FLUID OUNCE", "fl  oz", "zzz"]
    assert one(spark, raw, "string", nz.unit) == ["oz", "kg", None, "ct", None, None, None, "fl oz", "fl oz", None]


def test_tags_and_allergens(spark):
    raw = [["Plant-Based", "vegan", "GLUTEN FREE"], ["nothing known"], [], None, ["Kosher", None]]
    assert one(spark, raw, "array<string>", nz.dietary_tags) == [["vegan", "gluten-free"], None, None, None, ["kosher"]]
    assert one(spark, [["Eggs", "egg", "Tree Nuts"], ["none"]], "array<string>", nz.allergens) == [["egg", "tree_nut"], None]
    quick = one(spark, raw, "array<string>", lambda c: nz.dietary_tags(c, fuzzy=False))
    assert quick == [["vegan", "gluten-free"], None, None, None, ["kosher"]]


def test_brands_and_categories(spark):
    a = vocab.Adapter(brand_aliases={"smuckers": "Smucker's"})
    got = one(spark, ["Smuckers", "o'neil foods", "ACME", "smucker's", " ", None], "string", lambda c: nz.brand(c, a))
    assert got == ["Smucker's", "O'Neil Foods", "ACME", "Smucker'S", None, None]
    assert one(spark, ["Beverages", "Candy & Snacks", "rocket parts", None], "string", nz.category) == ["Beverages", "Snacks & Candy", "Unknown", None]


def test_pack_size_and_name(spark):
    raw = ["Pack of 12", "6-Pack", "Pack of 1", "Pack of 5000, 24 Count", "Set of 4", "(8) pk", "none", None]
    assert one(spark, raw, "string", nz.pack_size) == [12, 6, None, 24, 4, 8, None, None]
    assert one(spark, ["  La Costeña  salsa.;", "x", "\n", None], "string", nz.clean_name) == ["La Costea salsa", None, None, None]


def test_parse_listing(spark):
    text = "Item Name: Red Tea \nBullet Point 1: good\nBullet Point 2: hot\nProduct Description: line one\nline two\nValue: 12.5\nUnit: Ounce\n"
    got = one(spark, [text, "", None], "string", tx.parse_listing)
    assert got[0].asDict() == {"item_name": "Red Tea", "bullets": ["good", "hot"], "description": "line one\nline two", "value": 12.5, "unit": "Ounce"}
    assert got[1].item_name is None


def test_scans_and_fences(spark):
    assert one(spark, ["Eggs and Milk"], "string", lambda c: tx.scan(c, vocab.SCAN_ALLERGENS)) == [["milk", "eggs", "egg"]]
    assert one(spark, ["```json\n{}\n```", "{}", None], "string", tx.strip_fence) == ["{}", "{}", None]
    assert one(spark, ["x ```json{\"a\":1}``` y", "{}"], "string", tx.between_fences) == ['{"a":1}', "{}"]


def test_nbsp_is_white_space(spark):
    assert one(spark, ["Item Name: Tea "], "string", tx.item_name) == ["Tea"]


@pytest.mark.parametrize(("p", "h"), [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0)])
def test_entropy(spark, p, h):
    assert one(spark, [p], "double", sc.entropy) == [h]


def test_uncertainty_of_bad_json(spark):
    assert one(spark, ["broken", "{}", '{"a": 0.5}'], "string", lambda c: sc.mean_entropy(c, F.lit(0.5))) == [1.0, 1.0, 1.0]
    assert one(spark, ["x", '{"a":"auto_accept","b":"auto_reject"}', '{"a":"review"}'], "string", sc.disagreement) == [0.0, 1.0, 0.0]


def test_thresholds(spark):
    assert one(spark, [0.85, 0.84, 0.5, 0.49], "double", sc.label_status) == ["auto_accept", "review", "review", "auto_reject"]


def test_scores(spark):
    df = spark.createDataFrame([(" A ", "a", 10.4, 10.0, ["x"], ["x", "y"]), (None, None, 0.1, 0.0, None, []), (None, "a", 1.0, None, ["x"], None)], "a string, b string, c double, d double, e array<string>, f array<string>")
    got = df.select(sc.score_exact(F.col("a"), F.col("b")), sc.score_numeric(F.col("c"), F.col("d")), sc.score_list(F.col("e"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.5), (1.0, 0.0, 1.0), (0.0, 0.0, 0.0)]


def test_minimal_entity_scores_20(spark):
    no, none = F.lit(None), F.lit(None).cast("array<string>")
    q = sc.listing_quality(F.lit("Tea"), no, no, F.lit(1.0), no, no, no, no, none, no, none, none)
    assert spark.range(1).select(q).first()[0] == 20


def test_adapter_file(tmp_path):
    f = tmp_path / "a.yaml"
    f.write_text("brand_aliases: {acme inc: Acme}\ncategories: [A, B]\n")
    a = adapter.load(str(f))
    assert a.brand_aliases == {"acme inc": "Acme"} and a.categories == ["A", "B"] and a.units == vocab.UNITS


KEYWORD_TEXTS = [None, "", "Tea and TOFFEE", "coffee, tea", "\u0130stanbul \u00c9clair", "x" * 50_000 + "soap", "aaa", "soap"]


@pytest.mark.parametrize("padding", [0, 40, 3000])
@pytest.mark.parametrize("empty", [False, True])
def test_keywords_are_found_however_many_there_are(spark, padding, empty):
    """Few keywords (one by one) and many (one automaton) give the categories of a plain search, priority and overlaps included."""
    lists = {"Non-Food": ["soap"], "Coffee & Tea": ["coffee", "tea"], "Sweets": ["toffee", "\u00e9clair", "tea"], "A": ["aa", "aaa"], "None": [], "Rest": [f"zq{i}" for i in range(padding)] + [""] * empty}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(KEYWORD_TEXTS)], "i int, text string").repartition(3)
    low = {r.i: r.low for r in df.select("i", F.lower("text").alias("low")).collect()}
    want = {i: [k for k, ws in enumerate(lists.values()) if t is not None and any(w in t for w in ws)] for i, t in low.items()}
    got = {r.i: (list(r.h), r.c) for r in df.select("i", tx.keyword_hits(F.col("text"), lists).alias("h"), tx.keyword_category(F.col("text"), lists).alias("c")).collect()}
    names = list(lists)
    assert got == {i: (h, names[h[0]] if h else "Unknown") for i, h in want.items()}
    rows = {r.category: r.n for r in profile.keyword_coverage(df, F.col("text"), lists).collect()}
    assert rows == {n: sum(k in h for h in want.values()) for k, n in enumerate(names)}


def test_keywords_of_nothing(spark):
    df = spark.createDataFrame([], "text string")
    lists = {"a": [f"k{i}" for i in range(50)], "b": []}
    assert df.select(tx.keyword_category(F.col("text"), lists)).count() == 0
    assert spark.range(1).select(tx.keyword_category(F.lit("k1"), {}).alias("c")).first().c == "Unknown"
    assert list(tx.by_priority({"Mine": ["x"], "Beverages": ["b"], "Non-Food": ["n"]})) == ["Non-Food", "Beverages", "Mine"]


@pytest.mark.parametrize("cutoff", [0.0, 60.0, 85.0, 100.0])
def test_choices_match_brute_force(cutoff):
    """Every score computed, with ties, repeated, empty and long entries: the same choice."""
    import random

    from granary.functions.fuzzy import Choices, ratio

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    keys = [word(rng.randrange(0, 9)) for _ in range(400)] + ["", "abc", "abc", "cba", word(500)]
    choices = Choices(keys)
    for v in ["", "abc", "zzz", "a" * 300, *(word(rng.randrange(0, 12)) for _ in range(150)), *rng.sample(keys, 30)]:
        scores = [ratio(v, k) for k in keys]
        top = max(scores)
        assert choices.best(v, cutoff) == (scores.index(top) if top >= cutoff else None), v
    assert Choices([]).best("abc", 50.0) is None


def test_few_choices_are_compared(monkeypatch):
    """Of ten thousand brands a handful is compared for a misspelt one."""
    from granary.functions import fuzzy

    keys = [f"{a}{b} {c}" for a in ("Blue", "Acme", "Green", "Happy") for b in range(50) for c in ("Foods", "Farms", "Kitchen", "Mills", "Organics")] * 10
    seen, real = [], fuzzy.ratio
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: seen.append(b) or real(a, b))
    choices = fuzzy.Choices(keys)
    assert keys[choices.best("Happy17 Kitchn", 85.0)] == "Happy17 Kitchen" and len(seen) <= 200
