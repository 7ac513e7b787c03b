"""The opN_ queries themselves against brute force on whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_models import by_force
from test_text_ops import groups_by_force, slow_fingerprint

from granary.llm import chat, fingerprints, quality, queries, toxicity, warc


@pytest.fixture(scope="module")
def rows(spark, sf):
    return {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}


def test_op2(spark, sf, rows):
    got = queries.op2_sharding(spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows.items())
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < queries.SHARDS
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    counts = [len(slots[k]) for k in range(queries.SHARDS)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


@pytest.mark.parametrize(("name", "module", "cut"), [("op3_quality_classifier", quality, 0.3), ("op8_toxicity", toxicity, 0.5)])
def test_op3_op8(spark, sf, rows, name, module, cut):
    model = module.fit(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    score = (lambda t: model.score(quality.features(t))) if module is quality else model.score
    got = queries.QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert r.score == pytest.approx(score(rows[r.doc_id])) and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op4(spark, sf, rows):
    ids = sorted(rows, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = queries.op4_edit_fingerprints(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        text, following = rows[r.doc_id], rows[after[r.doc_id]]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        own, new, nxt = fingerprints.fingerprints([text, edited, following])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (own.hex(), new.hex(), fingerprints.likeness(own, new), fingerprints.likeness(own, nxt))


def test_op5(spark, sf, rows):
    ids = sorted(rows)
    prints = [slow_fingerprint(rows[i]) for i in ids]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], groups_by_force(ids, prints), strict=True))
    assert sorted(map(tuple, queries.op5_simhash_near_dedup(spark, sf).collect())) == want


def test_op9(spark, sf, rows):
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    got = queries.op9_benchmark_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == by_force(rows.items(), items) and len(got) == len({(r.doc_id, r.item_id) for r in got}) > 0


def test_op10(spark, sf, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text in rows.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    got = queries.op10_best_fit_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(filled) <= -(-sum(w[3] for w in want) // 2048) * 1.05 + 2


# ---- very long rows ------------------------------------------------------------------------------------------------
def test_long_payloads_round_trip(spark):
    big = "<p>" + "a line of a long page \n" * 400_000
    pages = spark.createDataFrame([(1, "http://a.example/x", big), (2, "http://a.example/x", big), (3, "http://b.example/", None)], "page_id long, url string, html string")
    _, index = warc.archive_and_index(pages)
    got = {r.page_id: r for r in warc.read_records(warc.lookup(index, warc.keys_of(pages)), payloads=True).collect()}
    assert got[1].refers_to == 2 and got[1].payload_bytes == len(big) and got[2].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[3].payload_bytes == 0


def test_conversation_of_many_turns(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn <"), F.col("id").cast("string")).alias("text"))
    out = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    r = out.select("n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss")).first()
    assert r.n_turns == 3000 and [t.text for t in r.turns] == [f"turn <{i}" for i in range(3000)]
    assert [x for x in r.loss if x] == [f"turn <{i}" for i in range(1, 3000, 2)]


def test_near_pairs_of_odd_rows(odd_docs, no_docs):
    prints = fingerprints.fingerprint_table(odd_docs)
    rows = fingerprints.near_pairs(prints).collect()
    distinct = sorted({bytes(r.fingerprint) for r in prints.collect()})
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if fingerprints.likeness(a, b) >= 0.8}
    assert {(bytes(r.a), bytes(r.b)) for r in rows} == want
    assert fingerprints.near_pairs(fingerprints.fingerprint_table(no_docs)).count() == 0


def test_empty_text_has_its_own_fingerprint():
    assert fingerprints.fingerprints(["", "x"])[0] == bytes(fingerprints.SLOTS) and xxhash.xxh64_intdigest(b"", 42)
