"""Line dedup, SimHash groups, fingerprints, sharding and packing against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import fingerprints, linededup, packing, queries, sharding, simhash

TOKENIZER = queries.tokenizer_path()


# ---- line dedup ----------------------------------------------------------------------------------------------------
def key_of(line):
    return line.strip(" \t\n\v\f\r").encode().lower()


def lines_by_force(rows):
    first = {}
    order = lambda d: (d is not None, d)
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key_of(x)
            if len(k.decode()) >= 10 and (k not in first or order(d) < order(first[k])):
                first[k] = d
    return ["\n".join(x for x in (t or "").split("\n") if first.get(key_of(x), d) == d) for d, t in rows]


def kept(df):
    return linededup.apply(df, linededup.keep_bitmaps(df))


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_lines(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d, x) for (d, _), x in zip(rows, lines_by_force(rows), strict=True)), key=str)
    out = kept(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert sorted(((d, t) for d, t, _ in got), key=str) == want
    assert all(len(t) == n for _, t, n in got)


def test_lines_held_keys_do_not_matter(docs, monkeypatch):
    want = sorted((r.doc_id, r.text) for r in kept(docs).collect())
    monkeypatch.setattr(linededup, "HELD_KEYS", 50)
    assert sorted((r.doc_id, r.text) for r in kept(docs.repartition(5)).collect()) == want


def test_no_lines(no_docs):
    assert kept(no_docs).count() == 0


def test_bitmap():
    keep = np.array([True, False, True] * 5)
    assert (linededup.kept_lines(zlib.compress(np.packbits(keep).tobytes()), 15) == keep).all()


# ---- SimHash -------------------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups_by_force(ids, fps, threshold=4):
    fps = np.array(fps, np.uint64)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[find(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_groups(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [slow_fingerprint(t) if len(t or "") < 20_000 else simhash.fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], groups_by_force([d for d, _ in rows], fps), strict=True), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want


def test_no_groups(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_code_covers():
    patterns, begin = simhash.error_patterns(simhash.COVERING_RADIUS)
    assert (np.diff(begin) > 0).all() and len(patterns) == begin[-1]


@pytest.mark.parametrize("threshold", [2, 4])
def test_every_close_pair_meets(threshold):
    rng = np.random.default_rng(threshold)
    a = rng.integers(0, 1 << 63, 200, np.int64).view(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    met = set()
    for which in range(3):
        at_a, i = simhash.anchors(a, which, threshold)
        at_b, j = simhash.anchors(b, which, threshold)
        have = set(zip(at_a.tolist(), i.tolist(), strict=True))
        met |= {k for x, k in zip(at_b.tolist(), j.tolist(), strict=True) if (x, k) in have}
    assert met == set(range(200))


def test_large_group_search():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, dtype=np.int64).view(np.uint64)
    near = np.unique(np.array([centre ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for x, y in rng.integers(0, 64, (300, 2))], np.uint64))
    far = rng.integers(0, 1 << 63, 50, np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([near, far]))
    edges = np.array(simhash._search(fps, 4), np.uint64).reshape(-1, 2)
    child, root = simhash._forest(edges[:, 0].view(np.int64), edges[:, 1].view(np.int64))
    assert len(set(child.tolist())) == len(near) - 1 and len(set(root.tolist())) == 1 and len(edges) < len(fps)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}


# ---- fingerprints --------------------------------------------------------------------------------------------------
def walk_by_force(text):
    bits, chars = fingerprints.walk_bits(), fingerprints.classes(text)
    at, out = 0, []
    for j in range(2 * len(text)):
        c = int(chars[at]) if at < len(text) else fingerprints.END
        out.append(c)
        at += int(bits[j % fingerprints.PERIOD, c])
    return out


def test_walks():
    texts = ["", "a", "short text", "another, rather longer text " * 9, "ü漢\U0001f600"]
    steps, own = fingerprints.samples()
    for t, p in zip(texts, fingerprints.fingerprints(texts), strict=True):
        read = walk_by_force(t)
        for k in range(fingerprints.SLOTS):
            mine = [s for s in own[k].tolist() if s < len(read)]
            if not mine:
                assert p[k] == 0
                continue
            mixed = ((mine[-1] * 0x9E3779B97F4A7C15 + read[mine[-1]] + k) * 0xD6E8FEB86659FD93) % (1 << 64)
            assert p[k] == 1 + (mixed >> 40) % 255


def test_hot_ids_are_dealt_by_hash(spark):
    """Half of all rows with one id, a quarter with none: no partition holds either group, and the order holds."""
    rows = [(7 if i % 2 else None if i % 4 else i, f"text {i}") for i in range(4000)]
    out = fingerprints.descending(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("part", F.spark_partition_id()).collect()
    parts = defaultdict(list)
    for r in out:
        if r.kind == fingerprints.OWN:
            parts[r.part].append(r)
    assert max(map(len, parts.values())) < 1500
    order = [(r.doc_id is not None, r.doc_id or 0) for k in sorted(parts) for r in parts[k]]
    assert order == sorted(order, reverse=True) and len(order) == 4000
    heads = [parts[k][0].text for k in sorted(parts)]
    assert sorted(r.text for r in out if r.kind == fingerprints.BORROWED) == sorted(heads)


@pytest.mark.parametrize("name", ["docs", "odd_docs", "hot"])
def test_edit_sensitivity(name, request, spark):
    hot = [(5 if i % 2 else None if i % 4 else i, f"text of {i % 90} " * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(hot, "doc_id long, text string") if name == "hot" else request.getfixturevalue(name)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    texts = [t for _, t in rows]
    after = [*texts[1:], texts[0]]
    changed = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
    own, new = fingerprints.fingerprints(texts), fingerprints.fingerprints(changed)
    want = sorted(
        (
            (d, len(t), hashlib.sha256(c.encode()).hexdigest(), p.hex(), q.hex(), fingerprints.likeness(p, q), fingerprints.likeness(p, n))
            for (d, t), c, p, q, n in zip(rows, changed, own, new, [*own[1:], own[0]], strict=True)
        ),
        key=str,
    )
    got = fingerprints.edit_sensitivity(df).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    # equal fingerprints share a group, whose id is its smallest
    groups, ids = defaultdict(set), defaultdict(set)
    for r in got:
        groups[r.fingerprint].add(r.near_id)
        ids[r.near_id].add(r.doc_id)
    assert all(len(g) == 1 for g in groups.values())
    assert all(k == min((i for i in own if i is not None), default=None) for k, own in ids.items() if k is not None)


def test_likeness_follows_edits(docs):
    texts = [r.text for r in docs.where("n_chars between 500 and 4000").limit(40).collect()]
    rng = random.Random(1)

    def mutate(t, k):
        t = list(t)
        for _ in range(k):
            t[rng.randrange(len(t))] = "~"
        return "".join(t)

    own = fingerprints.fingerprints(texts)
    mean = [np.mean([fingerprints.likeness(a, b) for a, b in zip(own, fingerprints.fingerprints([mutate(t, k) for t in texts]), strict=True)]) for k in (0, 2, 40)]
    assert mean[0] == 1.0 > mean[1] > mean[2] and mean[1] > 0.85


def test_banding_finds_near_texts(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.where("n_chars between 800 and 4000").limit(30).collect()]
    near = [(1_000_000 + d, t[: len(t) // 2] + "#" + t[len(t) // 2 :]) for d, t in base]
    prints = fingerprints.fingerprint_table(spark.createDataFrame(base + near, "doc_id long, text string")).persist()
    by = {r.doc_id: bytes(r.fingerprint) for r in prints.collect()}
    pairs = {frozenset((bytes(r.a), bytes(r.b))) for r in fingerprints.near_pairs(prints, 0.8).collect()}
    close = [d for d, _ in base if by[d] != by[d + 1_000_000] and fingerprints.likeness(by[d], by[d + 1_000_000]) >= 0.8]
    assert sum(frozenset((by[d], by[d + 1_000_000])) in pairs for d in close) >= 0.9 * len(close)


def templated_prints(n):
    """Fingerprints that share three quarters, each with a near copy that shares those bands only."""
    rng = np.random.default_rng(7)
    own = np.tile(rng.integers(1, 250, fingerprints.SLOTS, np.uint8), (n, 1))
    own[:, 96:] = rng.integers(1, 250, (n, 32), np.uint8)
    copies = own.copy()
    copies[:, 96::4] += 1
    return sorted({x.tobytes() for x in np.concatenate([own, copies])})


def banded_links(prints, bands=fingerprints.BANDS):
    """All links of at least 0.8 between fingerprints that share a band, by brute force."""
    m = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), bands, -1)
    out = set()
    for i in range(len(m)):
        same = m[i + 1 :] == m[i]
        ok = (same.mean(axis=(1, 2)) >= 0.8) & same.all(axis=2).any(axis=1)
        out |= {(i, int(j)) for j in np.flatnonzero(ok) + i + 1}
    return out


def roots_of(n, edges):
    label = list(range(n))
    for a, b in edges:
        label = [label[a] if x == label[b] else x for x in label]
    return label


@pytest.mark.parametrize(("small", "chunk"), [(24, 1000), (24, 40), (10_000, 1000)])
def test_no_link_of_a_templated_group_is_lost(spark, small, chunk, monkeypatch):
    monkeypatch.setattr(fingerprints, "SMALL_GROUP", small)
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    prints = templated_prints(80)
    at = {p: i for i, p in enumerate(prints)}
    want = banded_links(prints)
    rows = fingerprints.near_pairs(spark.createDataFrame([(bytearray(p),) for p in prints], "fingerprint binary")).collect()
    got = {(at[bytes(r.a)], at[bytes(r.b)]) for r in rows}
    assert len(got) == len(rows) and got <= want and (small < 10_000 or got == want)
    assert all(r.likeness == fingerprints.likeness(bytes(r.a), bytes(r.b)) >= 0.8 for r in rows)
    label = roots_of(len(prints), got)
    assert len(want) > 40 and all(label[a] == label[b] for a, b in want)


@pytest.mark.parametrize("bands", [fingerprints.BANDS, fingerprints.QUERY_BANDS])
def test_recall_among_pages_of_one_template(spark, bands):
    """Near copies among four hundred pages that share seven tenths of their text: of all near pairs, those in one group."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    template = say(1400)
    pages = [(i, template + say(600)) for i in range(400)]
    copies = [(1000 + i, t[:k] + "#" * rng.randint(1, 4) + t[k + 3 :]) for i, t in pages[:60] for k in [rng.randrange(1500, 1990)]]
    prints = fingerprints.fingerprint_table(spark.createDataFrame(pages + copies, "doc_id long, text string")).persist()
    by = {r.doc_id: bytes(r.fingerprint) for r in prints.collect()}
    group = {r.doc_id: r.near_id for r in fingerprints.near_groups(prints, bands=bands).collect()}
    near = [(i, j) for i in by for j in by if i < j and fingerprints.likeness(by[i], by[j]) >= 0.8]
    assert len(near) >= 50 and sum(group[i] == group[j] for i, j in near) >= 0.97 * len(near)
    alone = [i for i in by if not any(i in p for p in near)]
    assert all(group[i] == i for i in alone if sum(by[i] == x for x in by.values()) == 1)


# ---- sharding ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "bucket"), [("docs", sharding.BUCKET_BYTES), ("odd_docs", 2000)])
def test_shards(name, bucket, request):
    df = request.getfixturevalue(name)
    placed = sharding.assign(*sharding.shuffle(df, bucket_bytes=bucket), 5)
    rows = placed.select("record.doc_id", "record.text", "shard", "slot").collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    counts = np.bincount([r.shard for r in rows], minlength=5)
    assert counts.max() - counts.min() <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_same_shuffle_for_any_layout(docs):
    def order(df):
        return [r.doc_id for r in sharding.assign(*sharding.shuffle(df), 3).select("record.doc_id", "shard", "slot").orderBy("shard", "slot").collect()]

    assert order(docs) == order(docs.repartition(7)) != sorted(order(docs))


def test_fisher_yates_is_uniform():
    seen = defaultdict(int)
    for s in range(6000):
        seen[tuple(sharding.fisher_yates(3, (s,)).tolist())] += 1
    assert len(seen) == 6 and max(seen.values()) < 1150 and min(seen.values()) > 850


def test_write_shards(docs, no_docs, spark, tmp_path):
    sharding.write_shards(docs, 4, f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").count().count() == 4
    assert sharding.assign(*sharding.shuffle(no_docs), 4).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "capacity"), [("docs", 2048), ("odd_docs", 64)])
def test_packing(name, capacity, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in df.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r.doc_id, i, at, len(part), zlib.crc32(part.tobytes())))
    placed, pieces = packing.pack(df, TOKENIZER, capacity)
    rows = placed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    least = -(-sum(x[3] for x in want) // capacity)
    assert least <= len(filled) <= least * 1.05 + 2
    if name == "docs":
        laid = packing.sequences(placed, pieces).collect()
        assert all(len(r.ids) == 4 * r.n_tokens for r in laid) and len(laid) == len(filled)


def test_no_packing(no_docs):
    assert packing.pack(no_docs, TOKENIZER)[0].count() == 0


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(2)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 129, 60), rng.integers(1, 500, 60), strict=True)}
    room = defaultdict(list)
    for n, lo, hi, first, offset in packing.plan(counts, 128):
        for r in range(lo, hi):
            room[first + r - lo].append((offset, n, (n, r)))
    assert sorted(x[2] for own in room.values() for x in own) == sorted((n, r) for n, c in counts.items() for r in range(c))
    for own in room.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(own), sorted(own)[1:], strict=False)) and sum(x[1] for x in own) <= 128


def test_exact_complements_come_first():
    assert len({x[3] for x in packing.plan({60: 1, 40: 1, 70: 1, 20: 1, 10: 1, 50: 1, 25: 2}, 100)}) == 3


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["It's a <|endoftext|> test, isn't IT?", "ÉTÉ déjà vu ß ŉ İ", "a\x0bb\x0cc\x1cd\r\n\te", "1234 x9y ...!!", "ΟΔΟΣ é 漢字\U0001f600", "a" * 5000, "&amp; a/b @c #d 'll"]
    assert packing.WordIds(TOKENIZER)(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_spread_join(spark):
    from granary.llm.common import spread_join

    left = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n_rows")).withColumn("v", F.col("k") * 2)
    assert spread_join(left, right, "k").where("v = 2 * k").count() == 6000
