"""Every stage of the pipeline against brute force on its own input, on odd rows and on a table."""

import os
import zlib
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import by_force as leaks_by_force
from test_neardup import labels_by_force
from test_text_ops import lines_by_force

import corpus_pipeline
from granary.llm import quality, queries


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def odd_dir(spark, sf, odd_docs, tmp_path_factory):
    """A folder of tables whose documents are odd rows beside ordinary, copied and leaking ones."""
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(5).collect()]
    more = [(6, "x y z " * 400), (None, items[0]), (7, f"some words before {items[1]} and after"), (7, f"some words before {items[1]} and after"), (8, items[2].upper())]
    plain = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(20)).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    known = [c for c in odd_docs.columns if c not in ("doc_id", "text", "n_chars")]
    full = plain.withColumns({c: F.lit(None).cast(odd_docs.schema[c].dataType) for c in known}).withColumn("n_chars", F.length("text").cast("long"))
    odd_docs.unionByName(full).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").unionByName(spark.read.parquet(f"{sf}/{name}.parquet").limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in spark.read.parquet(f"{sf}/{name}.parquet").schema))).write.parquet(f"{out}/{name}.parquet")
    return out


def check_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, outs = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(corpus_pipeline.STAGES):
            out = corpus_pipeline.materialize(out)
            assert out.columns == columns
        outs.append((docs, out))
        docs = out
    (a, b), (_, c), (_, d), (_, e), (_, f) = outs

    model = quality.fit(a, queries.table(spark, sf_dir, "labels"))
    same(texts(b), [(i, t) for i, t in texts(a) if model.score(quality.features(t)) >= quality.ACCEPT])

    rows = texts(b)
    same(texts(c), [(i, t) for (i, _), t in zip(rows, lines_by_force(rows), strict=True)])
    assert all(r.n_chars == len(r.text) for r in c.collect())

    rows, kept = texts(c), texts(d)
    assert not set(kept) - set(rows)
    members = defaultdict(set)
    for k, (i, t) in zip(labels_by_force(rows), rows, strict=True):
        members[k].add((i is None, i or 0, t))
    group_of = {t: k for k, own in members.items() for _, _, t in own}
    assert sorted(group_of[t] for _, t in kept) == sorted(members)  # one row of each group, one of its first
    assert all((i is None, i or 0) == min(members[group_of[t]])[:2] for i, t in kept)

    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    rows = [(k, t) for k, (_, t) in enumerate(texts(d))]
    leaking = {k for k, _ in leaks_by_force(rows, items)}
    same([t for _, t in texts(e)], [t for k, t in rows if k not in leaking])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text in texts(e):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    placed = f.collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed], want)
    filled = defaultdict(list)
    for r in placed:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    same([(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()], [w[:2] + w[4:] for w in want])
    return len(a.collect()), len(b.collect()), len(d.collect()), len(e.collect())


def test_stages_on_odd_rows(spark, odd_dir):
    n = check_stages(spark, odd_dir)
    assert n[0] > n[2] > n[3] > 20


def test_stages_on_the_table(spark, sf):
    n = check_stages(spark, sf)
    assert n[0] >= n[1] > n[2] > n[3] > 20


def test_empty_tables(spark, sf, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_nothing_behind(spark, sf):
    """Of the tables that runs write only those that their lazy results read are left, also where runs overlap."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    alone = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()))
    before = set(os.listdir(shared))
    with ThreadPoolExecutor(2) as pool:
        outs = list(pool.map(lambda _: corpus_pipeline.run(spark, sf), range(2)))
    assert len(set(os.listdir(shared)) - before) <= 2 * 4
    for out in outs:
        assert sorted(map(tuple, out.select("doc_id", "piece", "ids_crc32").collect())) == alone
