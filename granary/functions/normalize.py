"""Normalisation to controlled vocabularies: lookups first, similarity for what they leave.

Alias tables are a few hundred entries, so they are literal maps in the plan.
``fuzzy=True`` adds an Arrow UDF; it sees nulls for all that a lookup resolved.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fuzzy as fz
from granary.functions import vocab
from granary.functions.text import bound, pattern


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair)) if d else F.create_map().cast("map<string,string>")


def lookup(d: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(d), key) if d else F.lit(None).cast("string")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, pattern(r"^\s+|\s+$"), "")


def _first_lower(d: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in d.items():
        out.setdefault(k.lower(), v)
    return out


def _rest(resolved: Column, raw: Column, choices: list[str], cutoff: float, token_sort: bool, fuzzy: bool) -> Column:
    if not fuzzy:
        return resolved
    return F.coalesce(resolved, fz.best_choice(F.when(resolved.isNull(), raw), choices, cutoff, token_sort))


def unit(raw: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """Alias, alias without case, canonical, similar (80); null if blank, "none" or none of these."""
    text = strip(raw)
    known = F.coalesce(lookup(adapter.unit_aliases, text), lookup(_first_lower(adapter.unit_aliases), F.lower(text)), F.when(text.isin(adapter.units), text))
    usable = text.isNotNull() & (text != "") & (F.lower(text) != "none")
    return F.when(usable, _rest(known, text, adapter.units, 80, False, fuzzy))


def _list(raw: Column, one: Callable[[Column], Column], fuzzy_udf: Callable[[Column], Column] | None) -> Column:
    out = fuzzy_udf(raw) if fuzzy_udf else F.transform(raw, one)
    out = F.array_distinct(F.array_compact(out))
    return F.when(F.size(out) > 0, out)


def _list_udf(one: Callable[[str], str | None]) -> Callable[[Column], Column]:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda own: None if own is None else [None if v is None else one(v) for v in own])

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")


def _similar(v: str, choices: list[str], cutoff: float) -> str | None:
    scores = [fz.ratio(v, c) for c in choices]
    best = max(range(len(choices)), key=lambda i: (scores[i], -i), default=None)
    return choices[best] if best is not None and scores[best] >= cutoff else None


def dietary_tags(raw: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """Each tag by alias without case, alias, canonical, similar (80); distinct in order; null if none is left."""
    a, tags = adapter.tag_aliases, adapter.tags

    def one(v: Column) -> Column:
        t = strip(v)
        return F.coalesce(lookup(a, F.lower(t)), lookup(a, t), F.when(t.isin(tags), t))

    def slow(v: str) -> str | None:
        t = v.strip()
        return a.get(t.lower()) or a.get(t) or (t if t in tags else _similar(t, tags, 80))

    return _list(raw, one, _list_udf(slow) if fuzzy else None)


def allergens(raw: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """Each allergen by alias, canonical, similar (80), all without case; distinct in order; null if none is left."""
    a, known = adapter.allergen_aliases, adapter.allergens

    def one(v: Column) -> Column:
        t = F.lower(strip(v))
        return F.coalesce(lookup(a, t), F.when(t.isin(known), t))

    def slow(v: str) -> str | None:
        t = v.strip().lower()
        return a.get(t) or (t if t in known else _similar(t, known, 80))

    return _list(raw, one, _list_udf(slow) if fuzzy else None)


_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def titled(c: Column) -> Column:
    """Every letter that follows no letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def brand(raw: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """Alias without case, similar (token sort, 90) to a known brand, else as it is, titled if it has no capital."""
    text = strip(raw)
    known = lookup(adapter.brand_aliases, F.lower(text))
    known = _rest(known, text, sorted(set(adapter.brand_aliases.values())), 90, True, fuzzy and bool(adapter.brand_aliases))
    plain = (text == F.lower(text)) & (text != F.upper(text))
    return F.when(text != "", F.coalesce(known, F.when(plain, titled(text)), text))


def category(raw: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """Exact, similar (token sort, 80), else Unknown; null stays null."""
    text = strip(raw)
    known = F.when(text.isin(adapter.categories), text)
    return F.when(text.isNotNull() & (text != ""), F.coalesce(_rest(known, text, adapter.categories, 80, True, fuzzy), F.lit("Unknown")))


# Patterns of pack sizes, in order.
PACK_PATTERNS = [
    r"[Pp]ack\s+of\s+(\d+)",
    r"(\d+)\s*-?\s*[Pp]ack",
    r"(\d+)\s*[Cc]ount",
    r"[Ss]et\s+of\s+(\d+)",
    r"[Bb]ox\s+of\s+(\d+)",
    r"[Cc]ase\s+of\s+(\d+)",
    r"\((\d+)\)\s*(?:pk|pack|ct)",
]


def pack_size(text: Column, most: int = 1000) -> Column:
    """The first pattern whose first number is 2 to ``most``; the patterns run only over texts with a digit."""

    def number(t: Column, p: str) -> Column:
        return bound(F.regexp_extract(t, pattern(p), 1), lambda hit: F.when(hit != "", hit.try_cast("long")))  # a cast that fails costs more than all patterns

    first = bound(text, lambda t: F.get(F.filter(F.array(*(number(t, p) for p in PACK_PATTERNS)), lambda n: (n > 1) & (n <= most)), F.lit(0)))
    return F.when(text.rlike(r"\p{Nd}"), first).cast("int")


def clean_name(raw: Column) -> Column:
    """Trimmed printable ASCII with single spaces and no closing punctuation; null under two characters."""
    c = F.regexp_replace(strip(raw), r"[^\x20-\x7E]", "")
    c = F.rtrim(F.regexp_replace(c, r"\s{2,}", " "), F.lit(".,;:"))
    return F.when(F.length(c) >= 2, c)


def product_fields(p: Column | Mapping[str, Column], adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> dict[str, Column]:
    """Each of a draft entity's fields normalised; the pack size falls back on the raw name, content passes as it is."""
    given = F.when(p["pack_size"] != 0, p["pack_size"]).cast("int")
    return {
        "product_id": strip(p["product_id"].cast("string")),
        "item_name": clean_name(p["item_name"]),
        "brand": brand(p["brand"], adapter, fuzzy),
        "category": category(p["category"], adapter, fuzzy),
        "quantity_value": p["quantity_value"].cast("double"),
        "quantity_unit": unit(p["quantity_unit"], adapter, fuzzy),
        "pack_size": F.coalesce(given, pack_size(p["item_name"])),
        "price": p["price"].cast("double"),
        "dietary_tags": dietary_tags(p["dietary_tags"], adapter, fuzzy),
        "allergen_list": allergens(p["allergen_list"], adapter, fuzzy),
        "description": p["description"],
        "bullet_points": p["bullet_points"],
        "ingredients": p["ingredients"],
        "visual": p["visual"],
        "image_url": p["image_url"],
        "extraction_confidence": F.coalesce(p["extraction_confidence"].cast("double"), F.lit(0.0)),
    }


def product(p: Column, adapter: vocab.Adapter = vocab.RETAIL, fuzzy: bool = True) -> Column:
    """The sixteen fields of a draft entity as one struct."""
    return F.struct(*(c.alias(n) for n, c in product_fields(p, adapter, fuzzy).items()))
