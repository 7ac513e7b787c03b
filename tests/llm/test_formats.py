"""WARC archives and their index, chat formatting, the pipeline, and the SQL twins of the opN_ queries."""

import gzip
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import chat, decontam, linededup, packing, quality, queries, simhash, warc

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want


# ---- WARC ----------------------------------------------------------------------------------------------------------
BIG = "<p>" + "copied payload é " * 100
PAGES = [
    (1, "http://Example.com:80/a?b=1#f", BIG), (2, "https://user@m.example.com/a", BIG), (9, "http://example.com/z", BIG), (3, "http://example.com/a", "small"), (4, "http://other.org", "small"),
    (5, None, None), (6, "", ""), (7, "http://x.y/\n bad url", "z" * 5000), (None, "http://nul.l/", BIG), (8, "http://[broken", "q"), (9, "http://example.com/z", BIG), (3, "http://example.com/a", "small"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({"digest": F.lit("clash"), "size": F.lit(1), "refers": F.lit(None).cast("long"), "n_rows": F.lit(0)})


@pytest.fixture(scope="module")
def archive(pages):
    return warc.archive_and_index(pages)


def test_round_trip(spark, pages, archive):
    _, index = archive
    got = sorted((tuple(r)[:5] for r in warc.read_records(warc.lookup(index, warc.keys_of(pages))).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        revisit = len(b) >= 1000 and html == BIG and i is not None and i < 9
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_and_urls(spark, pages, archive):
    rows = warc.read_records(warc.lookup(archive[1], warc.keys_of(pages))).collect()
    by = {(r.page_id, r.record_type): r for r in rows}
    assert bytes(by[9, "response"].payload).decode() == BIG and by[1, "revisit"].payload is None
    assert by[7, "response"].url == "http://x.y/%0A bad url"


def test_all_captures_of_a_key(spark, archive):
    q = spark.createDataFrame([("com,example)/a", None), ("com,none)/", None), ("-", None)], "surt string, capture string")
    got = sorted((r.surt, r.capture) for r in warc.lookup(archive[1], q).collect())
    urn = warc.URN
    assert got == [("-", f"{urn}5"), ("-", f"{urn}6"), ("com,example)/a", f"{urn}3"), ("com,example)/a", f"{urn}3")]


def test_archives_are_plain_gzip(spark, archive):
    files = warc._listing(spark, f"{archive[0]}/warc")
    text = b"".join(gzip.decompress(open(f.removeprefix("file:").replace("//", "/"), "rb").read()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".com/"), (F.col("id") % 50).cast("string")).alias("url"), F.lit("x").alias("html"))
    rows = [("s" + str(i % 20).zfill(3), str(i), "f", i, 1) for i in range(300)]
    assert sum(1 for b in warc._blocks(iter([warc._batch(rows, warc.CAPTURE)]))) == 60
    _, index = warc.archive_and_index(df)
    found = warc.lookup(index, warc.keys_of(df))
    assert sorted(r.page_id for r in warc.read_records(found, payloads=False).collect()) == list(range(300))
    one = spark.createDataFrame([("com,h3)/3", None)], "surt string, capture string")
    want = sorted(i for i in range(300) if i % 7 == 3 and i % 50 == 3)
    assert sorted(r.page_id for r in warc.read_records(warc.lookup(index, one), payloads=False).collect()) == want


def test_members_over_chunks():
    parts = [gzip.compress(random.Random(i).randbytes(i * 37), 1) for i in range(40)]
    data = b"".join(p + warc.EMPTY for p in parts)
    got = list(warc.members(io.BytesIO(data), 64))
    assert [data[o : o + n] for o, n, _ in got] == [p for p in parts if gzip.decompress(p)]


def test_no_pages(spark, pages):
    _, index = warc.archive_and_index(pages.limit(0))
    assert warc.lookup(index, warc.keys_of(pages)).count() == 0


@pytest.mark.parametrize(("url", "key"), [("https://www.a.b:8443/p?q", "b,a,www:8443)/p?q"), ("http://a.b", "b,a)/"), (None, "-"), ("http://a.b/ x", "b,a)/%20x")])
def test_surt(url, key):
    assert warc.surt(url) == key


# ---- chat ----------------------------------------------------------------------------------------------------------
def test_escapes(spark):
    texts = ["", "\\", "\\\\l", "<turn user>\n</turn>\n", "\\b<\\l>", "a\\<b\\\\<", "ü\U0001f600<", "<image 0>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.u == r.t and "<" not in r.e for r in e)


def test_parts(spark):
    rows = [
        (1, 1, "assistant", [("text", "see ", None, None), ("image", None, "s3://a", 2), ("text", " and <x>", None, None), ("audio", None, "b", 10)]),
        (1, 0, "user", [("document", None, "d", None), ("weird", "t", "e", 1), ("text", None, None, None)]),
        (2, 0, None, None), (None, None, "us>er\n", [("text", "hi", None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumns({"formatted": F.lit(1), "turns": F.lit("clash")})
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_runs"))).collect()}
    one = got[1]
    assert one.formatted == "<turn user>\n<document 0><document 1></turn>\n<turn assistant>\nsee <image 2> and \\lx><audio 3></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("document", "d", 600), ("document", "e", 600), ("image", "s3://a", 512), ("audio", "b", 250)]
    assert one.n_tokens == 600 + 600 + 0 + 1 + 512 + 2 + 250 and one.loss == ["see <image 2> and <x><audio 3>"]
    assert [tuple(t) for t in got[2].back] == [("", "")] and [tuple(t) for t in got[None].back] == [("us>er\n", "hi")]


def test_no_python_in_chat(spark, sf):
    plan = queries.QUERIES["op7_chat_formatting"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_conversations(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.format_conversations(df).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------
def test_stages_by_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        got = out.collect()
        ids = {r.doc_id for r in got}
        if name == "quality_filter":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r.doc_id for r in rows if model.score(quality.features(r.text)) >= quality.ACCEPT}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in ids for d in good) >= 0.97 * len(good)
        elif name == "line_dedup":
            assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        elif name == "simhash_near_dedup":
            fps = [simhash.fingerprint(r.text) for r in rows]
            want = set()
            for k, r in enumerate(rows):  # breadth first from each row
                seen, queue = {k}, [k]
                while queue:
                    x = queue.pop()
                    near = [j for j in range(len(rows)) if j not in seen and (fps[j] ^ fps[x]).bit_count() <= simhash.THRESHOLD]
                    seen.update(near)
                    queue += near
                want.add(min(rows[j].doc_id for j in seen))
            assert ids == want
        elif name == "benchmark_decontamination":
            d = decontam.Detector([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
            assert ids == {r.doc_id for r in rows if not d.find(r.text)}
        else:
            assert ids == {r.doc_id for r in rows} and packing.CAPACITY >= max(r.offset + r.length for r in got)
        docs = out


def test_json_of_attachments(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "r", 1)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert json.loads(chat.format_conversations(df).select(F.to_json("attachments")).first()[0])[0]["ref"] == "r"
