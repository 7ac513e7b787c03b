"""Classifiers by held-out accuracy, decontamination by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontam, quality, queries, toxicity
from granary.llm.common import held_out, labelled


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.fixture(scope="module")
def sf_large():
    return "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.98), ("op8_toxicity", "toxic", 0.95)])
def test_held_out(spark, sf_large, name, label, least):
    scored = queries.QUERIES[name](spark, sf_large)
    rows = scored.join(spark.read.parquet(f"{sf_large}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500
    y = rows[label].to_numpy()
    assert auc(rows.score.to_numpy(), y) > least
    assert (rows.predicted == y).mean() > 0.95
    assert rows.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd_docs, no_docs, labels, docs, module):
    both = docs.select("doc_id", "text").limit(150)
    some = labels.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 1)], labels.schema))
    model = module.fit(both, some)
    rows = odd_docs.select("doc_id", "text", module.score_column(model, odd_docs["text"], spark).alias("score2")).collect()
    assert len(rows) == 14 and all(0 <= r.score2 <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.score2)
    assert all(len(v) == 1 for v in by.values())
    empty = module.fit(no_docs, labels.limit(0))
    assert [r[0] for r in odd_docs.limit(1).select(module.score_column(empty, F.col("text"), spark)).collect()] == [0.5]


def test_quality_filter_keeps_columns(spark, odd_docs):
    one = quality.fit_rows([quality.pack(quality.features(t)) for t in ("a b", "c d")], np.array([1, 1]))
    assert quality.accepted(odd_docs, one).columns == odd_docs.columns and quality.accepted(odd_docs, one).count() == 14


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    docs = [np.unique(np.r_[rng.integers(0, 500, 20), 1000 if k else 2000]) for k in range(2) for _ in range(40)]
    y = np.repeat([0, 1], 40)
    m = quality.fit_rows([quality.pack(d) for d in docs], y)
    s = np.array([m.score(d) for d in docs])
    assert s[y == 1].min() > s[y == 0].max()


def test_packed_features():
    rng = np.random.default_rng(3)
    for n in (0, 1, 100, 8191, 8192, 60_000):
        f = np.sort(rng.choice(quality.FEATURES, n, replace=False))
        b = quality.pack(f)
        assert (quality.unpack(b) == f).all() and len(b) <= quality.FEATURES // 8


def test_dual_descent_reaches_the_optimum():
    """Against projected gradient steps on the dense dual of the same problem."""
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 30, 12)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio, cost = rng.normal(0, 1, quality.FEATURES), rng.uniform(0.1, 1, 60)
    rows = [quality.scaled(quality.pack(d), ratio) for d in docs]
    x = np.zeros((60, 31))
    for i, (at, v) in enumerate(rows):
        x[i, np.where(at == quality.FEATURES, 30, at)] = v
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a = np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        a = np.clip(a - step * (q @ a - 1), 0, cost)
    w = quality.dual_descent(lambda i: rows[i], y, cost, 3000, 0, enough=1e-9)
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    mine, best = primal(w[[*range(30), quality.FEATURES]]), a.sum() - a @ q @ a / 2
    assert mine == pytest.approx(best, rel=1e-4)


def test_gradients_are_numerical_ones():
    rng = np.random.default_rng(2)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    used = rng.choice(toxicity.BUCKETS, 40, replace=False)
    embed = np.zeros((toxicity.BUCKETS + 1, toxicity.DIM))
    embed[used] = rng.normal(0, 1, (40, toxicity.DIM))
    net = toxicity.Net(embed, {w: rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}, rng.normal(0, 0.5, n), rng.normal(0, 0.5, n), 0.1)
    text = [np.concatenate([rng.choice(used, (25, 3)), np.full((2, 3), toxicity.PAD)])]
    loss = lambda: net.gradients(text, net.table(), 1, 0.7, toxicity.Gradients(net))
    zero, full = toxicity.Gradients(net), toxicity.Gradients(net)
    net.gradients(text, net.table(), 1, 0.7, full)
    checked = 0
    for value, got, base in [(net.embed, full.embed, zero.embed), *((net.taps[w], full.taps[k], zero.taps[k]) for k, w in enumerate(toxicity.WIDTHS)), (net.bias, full.bias, zero.bias), (net.out, full.out, zero.out)]:
        change = got - base
        for at in [np.unravel_index(i, value.shape) for i in rng.choice(np.flatnonzero(change), 6)]:
            was, eps = value[at], 1e-3
            value[at] = was + eps
            up = loss()
            value[at] = was - eps
            down = loss()
            value[at] = was
            assert change[at] == pytest.approx((up - down) / (2 * eps), rel=1e-2, abs=1e-4)  # maxima are kept in single precision
            checked += 1
    assert checked == 36


def test_pieces_give_the_maxima_of_the_whole(monkeypatch):
    rng = np.random.default_rng(8)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    net = toxicity.Net(rng.normal(0, 1, (toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32), {w: rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, np.zeros(n, np.float32), np.ones(n, np.float32), 0.0)
    table = net.table()
    for words in (0, 1, 5, 100, 20_000):
        x = toxicity.ids(toxicity.word_hashes(" ".join(f"w{i}" for i in rng.integers(0, 5000, words))))
        for size in (1, 7, 1000):
            assert np.allclose(net.pooled([x], table)[0], net.pooled(toxicity.pieces(x, size), table)[0])


def test_training_streams_parts(spark, docs, labels, monkeypatch):
    """Parts of a few texts, texts in pieces: the model still tells the labels apart. Repeated rows count once."""
    both = docs.select("doc_id", "text")
    monkeypatch.setattr(toxicity, "PART_BYTES", 200_000)
    monkeypatch.setattr(toxicity, "PIECE", 500)
    model = toxicity.fit(both.unionByName(both), labels)
    rows = both.join(labels.where(~held_out(F.col("doc_id"))), "doc_id").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([model.score(r.text) for r in rows])
    assert auc(s, y) > 0.95


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_sample_is_bounded(spark, name):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(200)] + [(None, "no id"), (400, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(3000)] + [(400, 1, 1), (None, 1, 1), (7, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled(docs, labels, name, 30).collect()
    assert len(rows) == 30 == len({r.key for r in rows})
    every = labelled(docs, labels, name, 1000, F.max).collect()
    import zlib

    held = [i for i in [*range(50), 400] if zlib.crc32(str(i).encode()) % 5]
    assert len(every) == len(held)
    assert {r.text for r in every} == {min(f"text {j}" for j in range(i, 200, 50)) if i < 400 else "" for i in held}


def test_folds(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_language_comes_from_the_text():
    names = [*toxicity.LANGUAGES, "other"]
    assert [names[toxicity.language(toxicity.word_hashes(t))] for t in ("the cat is in the house", "le chat est dans la maison", "der Hund ist nicht in dem Haus", "", "zzz")] == ["en", "fr", "de", "other", "other"]


def by_force(docs, items, overlap=0.8, part=0.5, least=decontam.LEAST_WORDS):
    """Every text against every item of enough words, by the sets of their shingles."""
    items = [(i, x) for i, x in items if len(decontam.words_of(x)) >= least]

    def grams(t):
        w = decontam.words_of(t)
        n = min(5, len(w))
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if n else []

    out = set()
    for d, t in docs:
        w = decontam.words_of(t)
        have = {tuple(w[k : k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}
        for i, x in items:
            q, a = (grams(y) for y in decontam.question_and_answer(x or ""))
            share = [sum(g in have for g in own) / len(own) if own else 1.0 for own in (q, a, q + a)]
            if q + a and share[2] >= overlap - 1e-9 and min(share) >= part - 1e-9:
                out.add((d, i))
    return out


def test_leaks_in_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    want = by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want


def test_planted_leaks(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    rng = np.random.default_rng(4)
    planted, plain = [], []
    for k, (i, x) in enumerate(items):
        host = docs[k][1].split()
        at = int(rng.integers(0, len(host) + 1))
        words = x.split()
        if k % 2:
            question, answer = map(decontam.words_of, decontam.question_and_answer(x))
            cut = len(words) // 12  # capitals, and the longer part lacks some words at its outer end
            words = [w.upper() for w in (words[cut:] if len(question) > len(answer) else words[: len(words) - cut])]
        planted.append((1000 + k, " ".join(host[:at] + words + host[at:])))
        plain.append((2000 + k, " ".join(host[:at] + words[: len(words) // 2] + host[at:])))  # half an item is none
    rows = spark.createDataFrame(planted + plain, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(1000 + k, i) for k, (i, _) in enumerate(items)} <= found
    assert found == by_force(planted + plain, items)


def test_split_leaks_and_questions_alone():
    """Leaks broken into pieces by hundreds of words are found, questions without their answers are not."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(4000)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, f"{say(40)}\n{say(10)}") for i in range(300)]
    docs = []
    for i, x in items[:60]:
        question, answer = x.split("\n")
        words = question.split()
        docs += [
            (10 * i, f"{say(50)} {question} {say(400)} {answer} {say(20)}"),
            (10 * i + 1, f"{' '.join(words[:20])} {say(400)} {' '.join(words[20:])} {answer}"),
            (10 * i + 2, f"{say(30)} {question} {say(30)}"),
            (10 * i + 3, f"{answer} {say(300)}"),
        ]
    d = decontam.Detector(items)
    found = {(k, f[0]) for k, t in docs for f in d.find(t)}
    assert found == by_force(docs, items) == {(10 * i + k, i) for i in range(60) for k in range(2)}
    assert all(f[3:] == (1.0, 1.0, 1.0) for f in d.find(docs[0][1]))
    assert [f[1] for f in d.find(docs[0][1])] == [50]


def test_items_of_one_sentence_and_common_openings():
    """Items that share most of their words are told apart by the rest; without an answer the question decides."""
    opening = "answer the following question with one of the choices that are listed below it and explain"
    items = [(i, f"{opening} what is the value of thing number {i} in the table of things here") for i in range(200)] + [(900, "yes")]
    docs = [(k, f"so they say {opening} what is the value of thing number {k} in the table of things here and more") for k in range(0, 200, 7)] + [(900, "yes or no"), (901, opening)]
    d = decontam.Detector(items)
    assert {(k, f[0]) for k, t in docs for f in d.find(t)} == by_force(docs, items)
    d = decontam.Detector(items, least_words=1)
    assert {(k, f[0]) for k, t in docs for f in d.find(t)} == by_force(docs, items, least=1) > {(900, 900)}


def test_short_items_remove_nothing_unasked(spark):
    """Planted items of 1 to 20 words: all of enough words are caught whatever surrounds them, ordinary sentences stay."""
    rng = np.random.default_rng(3)
    items = [(n, " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))) for n in range(1, 21)] + [(100, "Yes."), (101, "The train is late. Yes.")]
    docs = [(i, f"some words before {t} and some after it") for i, t in items] + [(200, "yes the train that is late arrives at nine"), (201, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(n, n) for n in range(decontam.LEAST_WORDS, 21)}
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [*range(1, decontam.LEAST_WORDS), 100, 101, 200, 201, 201]
    assert sorted(r.item_id for r in decontam.short_items(bench).collect()) == [*range(1, decontam.LEAST_WORDS), 100, 101]


def test_many_items_cost_little():
    """The work follows the postings that a text meets: a hundred times the items take about as long."""
    import time

    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(2000)]
    text = " ".join(rng.choice(vocab, 200_000))
    took = []
    for n in (200, 20_000):
        d = decontam.Detector([(i, " ".join(rng.choice(vocab, 40))) for i in range(n)])
        began = time.perf_counter()
        assert d.find(text) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.05


def test_leak_edges(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "no id"), (4, "This line occurs in several documents."), (4, "same id, second text here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(odd_docs, items, least_words=1).collect()}
    assert got == {(8, 3), (9, 3), (None, None), (1, 4), (2, 4), (None, 4), (7, 4)}
    clean = decontam.clean(odd_docs, items, least_words=1)
    assert clean.columns == odd_docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 7, None, 10}
    assert decontam.leaks(no_docs, items).count() == 0
    assert decontam.clean(odd_docs, items.limit(0)).count() == 14


def test_wand_equals_scoring_everything():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(12)]  # so few words that items share many shingles
    items = [(i, " ".join(rng.choice(vocab, 30)) + "\n" + " ".join(rng.choice(vocab, int(rng.integers(1, 9))))) for i in range(80)]
    d = decontam.Detector(items, overlap=0.5)
    found = 0
    for trial in range(60):
        every = np.arange(len(d.begin) - 1)
        terms = every[rng.random(len(every)) < (0.1, 0.6, 0.9)[trial % 3]]
        scores = np.zeros(len(d.items))
        for t in terms:
            span = slice(d.begin[t], d.begin[t + 1])
            np.add.at(scores, d.entry[span], d.impact[span])
        want = {(int(e), round(float(scores[e]), 6)) for e in np.flatnonzero(scores >= d.threshold)}
        got = {(e, round(s, 6)) for block, rows, most in d.blocks(terms) for e, s in d.retrieve(terms, block, rows, most)}
        assert got == want
        found += len(want)
    assert found > 100


def test_parts(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    monkeypatch.setattr(decontam, "PART_ITEMS", 15)
    assert len(list(decontam.parts(items))) == 3
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want
    monkeypatch.setattr(decontam, "PART_ITEMS", 20_000)
    monkeypatch.setattr(decontam, "PART_BYTES", 2_000)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
