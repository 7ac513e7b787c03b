r"""Chat formatting over typed content parts, in DataFrame expressions only.

A message is a role and an ordered list of parts: text, image, audio or
document. A visitor flattens each list: texts are escaped, other parts become
placeholders ``<kind n>``, where n counts the attachments of the conversation
in order, and every part yields its expanded token count.

A turn reads ``<turn ROLE>\nBODY</turn>\n``. In texts ``\`` becomes ``\b`` and
``<`` becomes ``\l`` (in roles also ``>`` becomes ``\g`` and a line feed
``\n``), so a control string can't occur in a text, and undoing the
replacements in reverse order gives the text back.

The loss mask is a list of runs: characters to skip, then characters that count.
It covers the body of each assistant turn.

Defined cases: null roles and texts are empty ones, null part lists too; parts
of unknown kinds are treated as documents; null conversation ids form one
conversation; turns with equal numbers are ordered by what they say, repeated
rows stay, null numbers come first; empty tables give no rows; further columns
are ignored. A conversation is one output row, so its turns meet in one task;
texts are escaped before, and nothing else of the table is in that group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "text"
#: Tokens that a unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS = {"image": 256, "audio": 25, "document": 600}
#: Characters per token in texts, for the estimate that a budget needs before tokenizing.
CHARS_PER_TOKEN = 4

OPEN, SHUT, END = "<turn ", ">\n", "</turn>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_TEXT = (("\\", "\\b"), ("<", "\\l"))
_ROLE = (*_TEXT, (">", "\\g"), ("\n", "\\n"))


def escape(text: Column) -> Column:
    return _replace(text, *_TEXT)


def unescape(text: Column) -> Column:
    return _replace(text, *((new, old) for old, new in reversed(_TEXT)))


def escape_role(role: Column) -> Column:
    return _replace(role, *_ROLE)


def unescape_role(role: Column) -> Column:
    return _replace(role, *((new, old) for old, new in reversed(_ROLE)))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    part = F.struct(F.lit(TEXT).alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))
    return F.array(part).cast(PARTS)


def kind_of(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("document"))
    return F.when(kind.isin(TEXT, *TOKENS), kind).otherwise("document")


def visit(parts: Column) -> Column:
    """Parts as structs: kind, ref, tokens, body (escaped text, or null for an attachment)."""

    def one(p: Column) -> Column:
        kind = kind_of(p)
        text = F.coalesce(p["text"], F.lit(""))
        is_text = kind == TEXT
        rate = F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in TOKENS.items()), F.lit(0))
        tokens = F.when(is_text, F.ceil(F.length(text) / CHARS_PER_TOKEN)).otherwise(rate * F.coalesce(p["units"], F.lit(1))).cast("long")
        return F.struct(kind.alias("kind"), F.when(~is_text, p["ref"]).alias("ref"), tokens.alias("tokens"), F.when(is_text, escape(text)).alias("body"))

    return F.transform(F.coalesce(parts, F.array().cast(PARTS)), one)


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_runs, attachments, n_turns, n_tokens from rows conv_id, turn, role, parts.

    attachments: kind, ref, tokens in the order of their placeholders.
    loss_runs: skip, take in code points.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    visited = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), visit(F.col("parts")).alias("seen"))
    files = F.filter("seen", lambda p: p["kind"] != TEXT)
    rows = visited.select("conv_id", F.struct("turn", "role", "seen", F.size(files).alias("files")).alias("t"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.sum("t.files").alias("files"))
    # Placeholders are numbered through the conversation; most have none and need no running count.
    start = F.when(F.col("files") == 0, F.transform("turns", lambda t: F.lit(0))).otherwise(
        F.transform("turns", lambda t, i: F.aggregate(F.slice("turns", 1, i), F.lit(0), lambda n, u: n + u["files"]))
    )

    def body(t: Column, first: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(t["seen"], 1, i), lambda q: q["kind"] != TEXT))
            return F.coalesce(p["body"], F.concat(F.lit("<"), p["kind"], F.lit(" "), (first + before).cast("string"), F.lit(">")))

        return F.array_join(F.transform(t["seen"], part), "")

    bodied = per.withColumn("first", start).select(
        "conv_id",
        "turns",
        F.zip_with("turns", "first", lambda t, n: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SHUT)).alias("head"), body(t, n).alias("body"), (t["role"] == loss_role).alias("loss"))).alias("said"),
    )
    sized = bodied.withColumn("formatted", F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "")).withColumn(
        "lengths", F.transform("said", lambda s: F.struct(F.length(s["head"]).alias("head"), F.length(s["body"]).alias("body"), s["loss"].alias("loss")))
    )
    # A turn outside the loss is a run that takes nothing.
    runs = F.transform(
        "lengths",
        lambda s, i: F.struct(
            (s["head"] + F.when(i == 0, 0).otherwise(len(END)) + F.when(s["loss"], 0).otherwise(s["body"])).alias("skip"),
            F.when(s["loss"], s["body"]).otherwise(0).alias("take"),
        ),
    )
    seen = F.flatten(F.transform("turns", lambda t: t["seen"]))
    return sized.select(
        "conv_id",
        "formatted",
        runs.alias("loss_runs"),
        F.transform(F.filter(seen, lambda p: p["kind"] != TEXT), lambda p: F.struct(p["kind"], p["ref"], p["tokens"])).alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(seen, F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs role, text."""
    pieces = F.split(formatted, END, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        shut = F.instr(p, ">")
        role = F.substring(p, F.lit(len(OPEN) + 1), shut - len(OPEN) - 1)
        text = F.substring(p, shut + len(SHUT), F.length(p))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, one)


def read_loss(formatted: Column, loss_runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    nothing = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(acc: Column, run: Column) -> Column:
        begin = acc["at"] + run["skip"]
        text = F.when(run["take"] > 0, F.concat(acc["texts"], F.array(F.substring(formatted, begin, run["take"])))).otherwise(acc["texts"])
        return F.struct((begin + run["take"]).alias("at"), text.alias("texts"))

    return F.transform(F.aggregate(loss_runs, nothing, step)["texts"], unescape)
