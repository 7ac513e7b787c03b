"""From an English question to a plan: intent by rules, routes, and a façade over the queries."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import vocab
from granary.operators import graph as gr
from granary.operators import vector as vc

# Words that tell a category, later ones win.
CATEGORY_WORDS = [
    ("Snacks & Candy", ["snack"]),
    ("Beverages", ["beverage", "drink"]),
    ("Coffee & Tea", ["coffee", "tea", "matcha"]),
    ("Condiments & Sauces", ["sauce", "condiment"]),
    ("Spices & Seasonings", ["spice", "seasoning"]),
]
# Words that tell the intents.
ANALYTIC_WORDS = ["how many", "most", "average", "highest", "common", "statistics", "count"]
SEMANTIC_WORDS = ["similar", "like", "healthy", "good for"]
ROUTES = {"analytics": "analytics", "semantic": "hybrid", "hybrid": "hybrid"}


# The tags that the rule-based runners look for, and the words that tell the graph-only runner a category; later ones win.
RUNNER_TAGS = ["vegan", "gluten-free", "kosher", "organic", "dairy-free", "non-GMO", "high-protein", "keto-friendly"]
GRAPH_CATEGORY_WORDS = [
    ("Snacks & Candy", ["snacks"]),
    ("Beverages", ["beverages"]),
    ("Coffee & Tea", ["coffee"]),
    ("Condiments & Sauces", ["condiments"]),
    ("Spices & Seasonings", ["spices"]),
]
#: What each runner reads from a question: its tags and its words for categories.
RUNNERS = {"graph": (RUNNER_TAGS, GRAPH_CATEGORY_WORDS), "hybrid": ([*RUNNER_TAGS, "nut-free"], CATEGORY_WORDS)}

# The graph-only runner's analytic answers in order of trial. A question takes the first
# of whose words it holds all ("a|b": either); then statistics, condition, order and number of rows.
ANALYTIC_ANSWERS = [
    (["category", "most"], "categories", None, None, 5),
    (["brand"], "brands", None, None, 5),
    (["dietary|tag|common"], "tags", None, None, 5),
    (["average price", "beverage"], "categories", "contains(lower(category), 'beverage')", None, None),
    (["vegan", "how many"], "tags", "tag = 'vegan'", None, None),
    (["highest", "price"], "categories", None, "avg_price", 3),
    ([], "categories", None, None, 5),
]
STATISTICS = {"categories": gr.get_category_stats, "brands": gr.get_top_brands, "tags": gr.get_dietary_tag_stats}


@dataclass
class Intent:
    kind: str
    entities: dict = field(default_factory=dict)

    @property
    def route(self) -> str:
        return ROUTES.get(self.kind, "filter")


def parse(question: str, tags: Sequence[str] = vocab.LABEL_TAGS, categories: Sequence[str] = vocab.CATEGORIES, brands: Sequence[str] = (), allergens: Sequence[str] = vocab.ALLERGENS) -> Intent:
    """Deterministic intent: vocabulary by substring without case, prices after $, exclusions after "without", "no" or "free of"."""
    q = question.lower()
    e: dict = {}
    own = [t for t in tags if t.lower() in q]
    if own:
        e["tags"] = own
    for c, words in CATEGORY_WORDS:
        if any(w in q for w in words):
            e["category"] = c
    for c in categories:
        if c.lower() in q:
            e["category"] = c
    if m := re.search(r"(?:over|above|at least|from)\s*\$(\d+(?:\.\d+)?)", q):
        e["min_price"] = float(m[1])
    if m := re.search(r"(?:under|below|less than|up to|at most|to|and)?\s*\$(\d+(?:\.\d+)?)(?!.*\$)", q):
        if float(m[1]) != e.get("min_price") or q.count("$") > 1:
            e["max_price"] = float(m[1])
    for b in brands:
        if b.lower() in q:
            e["brand"] = b
    excluded = [a for a in allergens if re.search(rf"\b(?:without|no|free of|avoid)\s+(?:any\s+)?{re.escape(a.replace('_', ' '))}", q)]
    if excluded:
        e["exclude_allergens"] = excluded
    if any(w in q for w in ANALYTIC_WORDS):
        return Intent("analytics", e)
    if any(w in q for w in SEMANTIC_WORDS):
        return Intent("hybrid" if e else "semantic", e)
    return Intent("filter", e)


def parse_all(questions: DataFrame, column: str, **vocabulary) -> DataFrame:
    """questions with intent: kind, route and entities of each text, as :func:`parse` reads it. A null text has none."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = None if t is None else parse(t, **vocabulary)
            e = own.entities if own else {}
            rows.append((own and own.kind, own and own.route, e.get("tags", []), e.get("category"), e.get("brand"), e.get("min_price"), e.get("max_price"), e.get("exclude_allergens", [])))
        return pd.DataFrame(rows, columns=["kind", "route", "tags", "category", "brand", "min_price", "max_price", "exclude_allergens"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    kind = "kind string, route string, tags array<string>, category string, brand string, min_price double, max_price double, exclude_allergens array<string>"
    parsed = F.pandas_udf(run, kind)(F.col(column))
    return questions.withColumn("intent", F.when(F.col(column).isNotNull(), parsed))


def constraints(question: str, runner: str) -> dict:
    """What a runner of :data:`RUNNERS` reads from a question: its tags, the last category named, and the first whole price as a bound."""
    text, (tags, words) = question.lower(), RUNNERS[runner]
    named = [category for category, any_of in words if any(map(text.__contains__, any_of))]
    price = re.search(r"\$(\d+)", text)
    read = {"tags": [t for t in tags if t.lower() in text], "category": named[-1] if named else None, "max_price": float(price[1]) if price else None}
    return {k: v for k, v in read.items() if v}


def repair(entities: dict, question: str) -> dict:
    """Entities of a language model within the vocabulary: tags and category without case, unknown ones dropped."""
    category = canonical([entities["category"]], vocab.QUESTION_CATEGORIES) if entities.get("category") else []
    out = {
        "category": category[0] if category else None,
        "tags": canonical(entities.get("dietary_tags") or [], vocab.QUESTION_TAGS),
        "exclude_allergens": [a.lower() for a in entities.get("exclude_allergens") or []],
        **{k: entities.get(k) for k in ("max_price", "min_price", "brand")},
    }
    return {k: v for k, v in out.items() if v} | {"semantic_query": entities.get("semantic_query") or question}


def graph_only(g: gr.Graph, kind: str, question: str) -> DataFrame:
    """The graph-only runner: statistics by :data:`ANALYTIC_ANSWERS`, else ten products, which for several constraints must meet them."""
    if kind != "analytics":
        return gr.get_products(g, 10, **(constraints(question, "graph") if kind == "multi_constraint" else {}))
    text = question.lower()
    _, of, where, dearest, rows = next(a for a in ANALYTIC_ANSWERS if all(any(w in text for w in either.split("|")) for either in a[0]))
    out = STATISTICS[of](g)
    if where:
        out = out.where(where)
    if dearest:
        out = out.orderBy(F.desc(dearest), *out.columns[:1])
    return out.limit(rows) if rows else out


def canonical(values: Sequence[str], vocabulary: Sequence[str]) -> list[str]:
    """Values of the vocabulary, told apart without case, in the vocabulary's spelling."""
    known = {v.lower(): v for v in vocabulary}
    return [known[v.lower()] for v in values if v.lower() in known]


def _tree(plan) -> Iterator:
    """All nodes of a plan or an expression: children, and what they hold beside them, such as the bodies of WITH."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for own in (node.children(), node.innerChildren()):
            todo += [own.apply(i) for i in range(own.size())]


def read_only(spark: SparkSession, sql: str) -> bool:
    """Whether a statement parses as a query: anything that holds a command or an insertion, at any depth, is refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    return not any(re.search(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|Set(?!Op)|Truncate|Replace|Refresh|Cache|Load|Show|Describe|Analyze|Repair|Call", n.getClass().getSimpleName()) for n in _tree(plan))


#: The views that a written query may read, and the tables of the graph behind them.
VIEWS = {"products": "products", "brands": "brand_edges", "categories": "category_edges", "tags": "tag_edges", "allergens": "allergen_edges"}
_session_lock = threading.Lock()


def _allowed(plan) -> bool:
    """Whether an analysed query reads nothing but the views and calls nothing by reflection, subqueries included."""
    todo = [(plan, False)]
    while todo:
        node, inside = todo.pop()
        kind = node.getClass().getSimpleName()
        inside = inside or kind == "View" and node.desc().identifier().table() in VIEWS
        if inside:
            continue
        leaf = node.children().size() == 0
        if leaf and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            return False
        if kind in ("ScriptTransformation", "PythonMapInArrow", "TypedFilter"):
            return False
        todo += [(node.children().apply(i), False) for i in range(node.children().size())]
        expressions = node.expressions()
        for e in (expressions.apply(i) for i in range(expressions.size())):
            for x in _tree(e):
                name = x.getClass().getSimpleName()
                if re.search(r"Reflect|PythonUDF|ScalaUDF|HiveSimpleUDF|HiveGenericUDF|InputFile", name):
                    return False
                if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                    todo.append((x.plan(), False))
    return True


def run_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """A single reading statement over the views; anything else is refused before it runs.

    The views stand in the session only while the statement is analysed: then the
    caller's own of the same names are back, and paths are no tables.
    """
    if not sql or not read_only(spark, sql):
        raise PermissionError("only a query may be run")
    with _session_lock:
        before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in views}
        on_files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            for name, df in views.items():
                df.createOrReplaceTempView(name)
            try:
                out = spark.sql(sql)
            except AnalysisException as e:
                raise PermissionError(f"only the views may be read: {e}"[:300]) from None
            if not _allowed(out._jdf.queryExecution().analyzed()):
                raise PermissionError("only the views may be read, and nothing called by reflection")
            return out
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", on_files)
            for name in views:
                spark.catalog.dropTempView(name)
            for name, df in before.items():
                df.createOrReplaceTempView(name)


class Engine:
    """Answers over one graph and one vector table; ``encode`` turns a question into a query vector."""

    def __init__(self, graph: gr.Graph, vectors: DataFrame | None = None, encode: Callable[[str], Sequence[float]] | None = None, parser: Callable[[str], Intent] = parse, to_sql: Callable[[str, dict], str] | None = None):
        """``to_sql`` writes a query over the views products, brands, categories, tags and allergens for questions that say nothing."""
        self.graph, self.vectors, self.encode, self.parser, self.to_sql = graph, vectors, encode, parser, to_sql

    def by_sql(self, question: str, entities: dict) -> DataFrame:
        """The answer of a query that the hook writes; anything but a single reading statement is refused."""
        return run_query(self.graph.products.sparkSession, self.to_sql(question, entities), {name: getattr(self.graph, own) for name, own in VIEWS.items()})

    def analytics(self, question: str) -> DataFrame:
        q = question.lower()
        if "brand" in q:
            return gr.get_top_brands(self.graph, 10)
        if "tag" in q or "dietary" in q:
            return gr.get_dietary_tag_stats(self.graph)
        return gr.get_category_stats(self.graph)

    def plan(self, question: str, top_k: int = 10) -> DataFrame:
        """The DataFrame that answers a question; nothing runs yet."""
        if not 3 <= len(question) <= 500:
            raise ValueError("a question has 3 to 500 characters")
        if not 1 <= top_k <= 50:
            raise ValueError("top_k is 1 to 50")
        intent = self.parser(question)
        if intent.route == "analytics":
            return self.analytics(question)
        if intent.route == "hybrid" and self.vectors is not None and self.encode is not None:
            return vc.hybrid(self.graph, self.vectors, self.encode(question), top_k, **intent.entities)
        if not intent.entities and self.to_sql is not None:
            return self.by_sql(question, intent.entities)
        return gr.get_products(self.graph, top_k, **intent.entities)

    def query(self, question: str, top_k: int = 10, attempts: int = 2) -> dict:
        """Results with intent, latency and an answer; failures are retried and then told."""
        began, error = time.time(), None
        for _ in range(attempts + 1):
            try:
                rows = [r.asDict(recursive=True) for r in self.plan(question, top_k).take(top_k)]
                return {"query": question, "intent": self.parser(question).kind, "results": rows, "answer": answer(rows), "latency_s": round(time.time() - began, 3), "error": None}
            except ValueError:
                raise
            except Exception as e:
                error = str(e)
        return {"query": question, "intent": None, "results": [], "answer": "", "latency_s": round(time.time() - began, 3), "error": error}

    def search(self, query: str | None = None, top_k: int = 10, **constraints) -> DataFrame:
        """Structured search: hybrid with a query, filters alone without one."""
        if not 1 <= top_k <= 50:
            raise ValueError("top_k is 1 to 50")
        if query and self.vectors is not None and self.encode is not None:
            return vc.hybrid(self.graph, self.vectors, self.encode(query), top_k, **constraints)
        return gr.get_products(self.graph, top_k, **constraints)

    def product(self, product_id) -> dict | None:
        own = gr.get_product_detail(self.graph, product_id).take(1)
        if not own:
            return None
        return own[0].asDict(recursive=True) | {"similar": [r.asDict() for r in gr.get_detail_similar(self.graph, product_id).collect()]}

    def overview(self) -> dict[str, DataFrame]:
        totals = self.graph.products.agg(F.countDistinct("product_id").alias("total_products")).crossJoin(self.graph.brand_edges.agg(F.countDistinct("brand").alias("total_brands")))
        return {"categories": gr.get_category_stats(self.graph), "brands": gr.get_top_brands(self.graph, 20), "tags": gr.get_dietary_tag_stats(self.graph), "totals": totals}

    def health(self) -> dict[str, bool]:
        return {"products": bool(self.graph.products.take(1)), "vectors": self.vectors is not None and bool(self.vectors.take(1))}


def answer(rows: list[dict]) -> str:
    """The first five rows as text; rows without an item name are statistics."""
    if not rows:
        return "Nothing was found."
    if "item_name" not in rows[0]:
        return "\n".join("- " + ", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows[:5])
    return "\n".join(f"{i}. {r['item_name']} ({r.get('brand') or 'no brand'}), {r.get('price')}" for i, r in enumerate(rows[:5], 1))
