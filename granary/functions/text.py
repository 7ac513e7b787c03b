"""Parsing listing text: column expressions, but for long lists of keywords.

Patterns carry ``(?U)`` and ``(?d)``: classes are Unicode ones and only a line
feed ends a line, which is what listing patterns are written for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import vocab


def pattern(p: str) -> str:
    return f"(?U)(?d){p}"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: What ``\s`` stands for in the patterns.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def found(text: Column, p: str, group: int = 1) -> Column:
    """The first match's group, trimmed of white space; null without a match or if nothing is left."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern(p), group), F.lit(SPACE)), F.lit(""))


ITEM_NAME = r"Item Name:\s*(.+?)(?:\n|$)"
BULLET = r"Bullet Point \d+:\s*(.+?)(?:\n|$)"
#: A character, then all up to a line that begins with a value. It goes by lines, and keeps nothing to go back to.
DESCRIPTION = r"(?s)Product Description:\s*(.[^\n]*+(?:\n(?!Value:)[^\n]*+)*+)"
VALUE = r"Value:\s*([\d.]+)"
UNIT = r"Unit:\s*(.+?)(?:\n|$)"
PACK_OF = r"(?i)Pack of (\d+)"


def found_all(text: Column, p: str, group: int = 1) -> Column:
    """Every match's group."""
    return F.regexp_extract_all(text, F.lit(pattern(p)), group)


def bullets(text: Column) -> Column:
    return found_all(text, BULLET)


def parse_listing(text: Column) -> Column:
    """item_name, bullets, description, value, unit of a listing."""
    return F.struct(
        found(text, ITEM_NAME).alias("item_name"),
        bullets(text).alias("bullets"),
        found(text, DESCRIPTION).alias("description"),
        F.regexp_extract(text, pattern(VALUE), 1).try_cast("double").alias("value"),
        found(text, UNIT).alias("unit"),
    )


def item_name(text: Column, fallback: int = 80) -> Column:
    return F.coalesce(found(text, ITEM_NAME), F.substring(text, 1, fallback))


def item_name_lower(text: Column) -> Column:
    return F.lower(F.coalesce(found(text, "(?i)" + ITEM_NAME), F.lit("")))


def brand_candidate(name: Column) -> Column:
    """The first word of a name; null if there is none."""
    return F.nullif(F.regexp_extract(name, pattern(r"(\S+)"), 1), F.lit(""))


def scan(text: Column, literals: list[str]) -> Column:
    """The literals that the lower-cased text contains, in the order given."""
    return bound(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in literals))))


def scan_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """Canonical values whose aliases the text contains, sorted; null if none.

    An alias that holds another one of the same value is not sought: wherever it stands the other does.
    """
    lists = {c: [a for a in own if not any(b != a and b in a for b in own)] for c in sorted(set(aliases.values())) for own in [[a for a, of in aliases.items() if of == c]]}
    return bound(keyword_hits(text, lists), lambda hits: F.when(F.size(hits) > 0, F.transform(hits, lambda i: F.get(F.array(*map(F.lit, lists)), i))))


def pack_of(text: Column) -> Column:
    return F.regexp_extract(text, pattern(PACK_OF), 1).try_cast("int")


#: Up to so many keywords are sought one by one in generated code; more are sought all at once in one pass over a text.
FEW_KEYWORDS = 32


def keyword_hits(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Positions, ascending, of the lists of keywords of which the lower-cased text contains one.

    Keywords are compared as they are. Null texts contain nothing, and every other
    text, an empty one too, contains the empty keyword. One automaton over all
    keywords, built once a task, reads each text once, so the cost of a text
    does not depend on how many keywords there are.
    """
    lists = [list(own) for own in keywords.values()]
    if sum(map(len, lists)) <= FEW_KEYWORDS:

        def each(low: Column) -> Column:
            hits = (reduce(or_, (F.contains(low, F.lit(w)) for w in own), F.lit(False)) for own in lists)
            return F.array_compact(F.array(*(F.when(hit, F.lit(i)) for i, hit in enumerate(hits))).cast("array<int>"))

        return bound(F.lower(text), each)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ahocorasick import Automaton

        machine, owners = Automaton(), {}
        for i, own in enumerate(lists):
            for w in own:
                owners.setdefault(w, set()).add(i)
        always = owners.pop("", set())
        for w, of in owners.items():
            machine.add_word(w, of)
        machine.make_automaton()

        def hits(t: str | None) -> list[int]:
            if t is None:
                return []
            seen = set(always)
            for _, of in machine.iter(t) if owners else ():
                seen |= of
                if len(seen) == len(lists):
                    break
            return sorted(seen)

        for part in parts:
            yield pd.Series([hits(t) for t in part], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(F.lower(text))


def keyword_category(text: Column, keywords: Mapping[str, Sequence[str]], default: str = "Unknown") -> Column:
    """The first category, in order of priority, one of whose keywords the lower-cased text contains."""
    if not keywords:
        return F.lit(default)
    return F.coalesce(F.get(F.array(*map(F.lit, keywords)), F.array_min(keyword_hits(text, keywords))), F.lit(default))


def by_priority(keywords: Mapping[str, Sequence[str]], order: Sequence[str] = vocab.CATEGORY_PRIORITY) -> dict[str, list[str]]:
    """The lists of keywords in the order in which categories are tried; those that the order does not name come last."""
    return {c: list(keywords[c]) for c in [*(c for c in order if c in keywords), *(c for c in keywords if c not in order)]}


def text_tier(length: Column) -> Column:
    return F.when(length <= 150, "bare").when(length <= 600, "medium").otherwise("rich")


def content_tier(n_bullets: Column, description: Column) -> Column:
    return F.when((n_bullets >= 5) & description.isNotNull(), "rich").when(n_bullets >= 1, "medium").otherwise("bare")


def strip_fence(text: Column) -> Column:
    """A fenced answer without its first and last lines; any other as it is."""
    trimmed = F.regexp_replace(text, pattern(r"^\s+|\s+$"), "")
    lines = F.split(trimmed, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(F.startswith(trimmed, F.lit("```")), inner).otherwise(trimmed)


def between_fences(text: Column) -> Column:
    """What stands between the first two fences, without a leading ``json``; the trimmed text if there are none."""
    parts = F.split(text, "```")
    inner = F.regexp_replace(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(text), "^json", "")
    return F.regexp_replace(inner, pattern(r"^\s+|\s+$"), "")


def image_url(product_id: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), product_id, F.lit(".jpg"))


def parse_product(sample_id: Column, text: Column, price: Column, image_link: Column, adapter: vocab.Adapter = vocab.RETAIL) -> Column:
    """The draft entity of a listing; tags come sorted."""
    raw = found(text, UNIT)
    units = F.create_map(*(F.lit(x) for pair in {**adapter.unit_aliases, "Pack": "ct", "pack": "ct"}.items() for x in pair))
    unit = F.when(raw != "None", F.coalesce(F.try_element_at(units, raw), raw))
    own = bullets(text)
    return F.struct(
        sample_id.cast("string").alias("product_id"),
        found(text, ITEM_NAME).alias("item_name"),
        price.cast("double").alias("price"),
        F.regexp_extract(text, pattern(VALUE), 1).try_cast("double").alias("quantity_value"),
        unit.alias("quantity_unit"),
        pack_of(text).alias("pack_size"),
        F.substring(found(text, DESCRIPTION), 1, 5000).alias("description"),
        F.when(F.size(own) > 0, own).alias("bullet_points"),
        scan_aliases(text, adapter.tag_aliases).alias("dietary_tags"),
        image_link.alias("image_url"),
    )


def null_lists(c: Column) -> Column:
    """A list, empty where there is none."""
    return F.coalesce(c, F.array().cast("array<string>"))
