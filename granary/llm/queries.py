"""The opN_ queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files lie; a deployment may say so in the environment.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    folder = os.environ.get("GRANARY_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import warc

    pages = table(spark, sf_dir, "pages")
    _, index = warc.archive_and_index(pages)
    found = warc.lookup(index, warc.keys_of(pages))
    return warc.read_records(found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), m as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as last_id from p
)
select page_id, payload_bytes, payload_digest,
       case when page_id < last_id then 'revisit' else 'response' end as record_type,
       case when page_id < last_id then last_id end as refers_to
from m
"""

#: Shards of op2.
SHARDS = 40


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import sharding

    placed = sharding.assign(*sharding.shuffle(table(spark, sf_dir, "documents")), SHARDS)
    text = F.col("record.text")
    return placed.select(
        F.col("record.doc_id").alias("doc_id"),
        sharding.size_of(text).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _scored(docs: DataFrame, score, cut: float) -> DataFrame:
    from granary.llm.common import held_out

    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score_column(model, docs["text"], spark), quality.ACCEPT)


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import fingerprints

    return fingerprints.edit_sensitivity(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import linededup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = linededup.with_bitmaps(docs, linededup.keep_bitmaps(docs))
    sha = F.sha2(F.encode(linededup.kept_text(), "UTF-8"), 256)
    return rows.select("doc_id", F.col(f"{linededup.PREFIX}n_lines").alias("n_lines"), F.col(f"{linededup.PREFIX}n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


OP6_SQL = r"""
with parts as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), numbered as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from parts
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from numbered
), firsts as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key
)
select doc_id, count(*) as n_lines,
       count(*) filter (where first_doc < doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where first_doc is null or first_doc = doc_id), '')) as kept_sha256
from keyed left join firsts using (key) group by doc_id
"""


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import chat

    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_runs")), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized as (
  select *, length(replace(replace(text, '\', '\b'), '<', '\l')) as body,
         length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n')) as head from said
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(6 + head + 2 + body + 8) as bigint) as formatted_chars
from sized group by conv_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score_column(model, docs["text"], spark), 0.5)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import packing

    placements, _ = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return placements


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import whitening

    rows = whitening.prepared(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    each = whitening.transform(rows, model).select(F.col("key").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.QUERY)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import merkle

    rows = merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("path"))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.path_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(source: str, value: str) -> list[str]:
    """CTEs that end in crc(s, crc32_of): the unsigned CRC-32 of each distinct value, byte by byte from its table."""
    table_ = ["t0 as (select range as i, range as v from range(256))"]
    table_ += [f"t{k + 1} as (select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end as v from t{k})" for k in range(8)]
    step = "select s, pos + 1, xor(c // 256, v) from steps join t8 on i = xor(c, ascii(substr(s, pos + 1, 1))) % 256 where pos < length(s)"
    steps = f"steps as (select distinct {value} as s, 0 as pos, 4294967295 as c from {source} where {value} is not null union all {step})"
    return [*table_, steps, "crc as (select s, xor(c, 4294967295) as crc32_of from steps where pos = length(s))"]


def merkle_sql(levels: int = 17) -> str:
    """Every level of the trees as a table of its own, for at most 2**levels rows a language."""
    upper = levels // 2
    fields = "doc_id source lang n_chars text".split()
    part = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
    leaf = lambda more: "sha256(" + " || ".join(part.format("(n_chars + 1)" if more and c == "n_chars" else c) for c in fields) + ")"
    out = crc32_sql("documents", "cast(doc_id as varchar)")
    out.append(f"d as (select doc_id, lang, {leaf(False)} as leaf, case when crc32_of % 7 = 0 then {leaf(True)} end as tampered from documents left join crc on s = cast(doc_id as varchar))")
    out.append("l0 as (select *, leaf as h, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as size from d)")

    def grown(before: str, after: str, own: str) -> str:
        """The next level; a tree's last node is taken along as it is."""
        node = "case when any_value(size) = 1 then any_value(h) else sha256(string_agg(h, '' order by idx)) end as h"
        return f"{after} as (select {own}, idx // 2 as idx, {node}, (any_value(size) + 1) // 2 as size from {before} group by {own}, idx // 2)"

    def step(level: str, on: str, before: str, after: str, idx: str) -> str:
        """Proof and folded hash with the siblings of one level."""
        both = f"when s.h is null then sha256(n.folded) when n.{idx} % 2 = 1 then sha256(s.h || n.folded) else sha256(n.folded || s.h) end"
        rest = "n.idx // 2 as idx, n.size, n.gidx, n.gsize" if idx == "idx" else "n.idx, n.size, n.gidx // 2 as gidx, n.gsize"
        size = "size" if idx == "idx" else "gsize"
        rest = rest.replace(f"n.{size}", f"(n.{size} + 1) // 2 as {size}")
        return (
            f"{after} as (select n.doc_id, n.lang, n.leaf, case when n.{size} = 1 then n.folded {both} as folded, {rest}, n.subroot, n.root, n.proof || coalesce(s.h, '') as proof "
            f"from {before} n left join {level} s on {on} and s.idx = xor(n.{idx}, 1))"
        )

    out += [grown(f"l{i}", f"l{i + 1}", "lang") for i in range(levels)]
    out.append(f"g0 as (select 0 as one, lang, h, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as size from l{levels})")
    out += [grown(f"g{i}", f"g{i + 1}", "one") for i in range(upper)]
    out.append(
        "n0 as (select a.doc_id, a.lang, a.leaf, coalesce(a.tampered, a.leaf) as folded, a.idx, a.size, g.idx as gidx, g.size as gsize, g.h as subroot, r.h as root, '' as proof "
        f"from l0 a join g0 g on g.lang is not distinct from a.lang cross join g{upper} r)"
    )
    out += [step(f"l{i}", "s.lang is not distinct from n.lang", f"n{i}", f"n{i + 1}", "idx") for i in range(levels)]
    out += [step(f"g{i}", "s.one = 0", f"n{levels + i}", f"n{levels + i + 1}", "gidx") for i in range(upper)]
    last = f"select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from n{levels + upper}"
    return "with recursive " + ",\n".join(out) + f"\n{last}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_edit_fingerprints": op4_edit_fingerprints,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {"op1_warc": OP1_SQL, "op6_line_dedup": OP6_SQL, "op7_chat_formatting": OP7_SQL, "op13_merkle_manifest": merkle_sql()}
