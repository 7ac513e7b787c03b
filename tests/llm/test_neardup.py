"""Groups of near copies against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import neardup


def shingles(text, n=5):
    words = (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def labels_by_force(rows):
    """The number of each row's group."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def groups_by_force(rows):
    label = labels_by_force(rows)
    least = {}
    for (d, _), k in zip(rows, label, strict=True):
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return sorted(((d, least[k]) for (d, _), k in zip(rows, label, strict=True)), key=str)


def near_texts(seed, n, template=0):
    """Pairs at similarities around 0.8, all sharing the first words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(template)]
    out = []
    for _ in range(n):
        text = [*shared, *(word() for _ in range(200 - template))]
        other = list(text)
        for i in rng.sample(range(template, 200), rng.randint(1, 5)):
            other[i] = word()
        out += [" ".join(text), " ".join(other)]
    return out


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_groups(name, request):
    df = request.getfixturevalue(name)
    want = groups_by_force([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str) == want


@pytest.mark.parametrize(("template", "chunk"), [(0, 1000), (140, 1000), (140, 30)])
def test_pairs_near_the_threshold(spark, template, chunk, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = list(enumerate(near_texts(1, 60, template)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str) == groups_by_force(rows)


def test_unlinked_pairs():
    sets = [neardup.shingle_set(t) for t in near_texts(2, 40, 140)]
    ids = np.arange(len(sets))
    found = neardup.unlinked_pairs(ids, ids, sets)
    label = ids.copy()
    for p, q in found:
        assert len(set(sets[p]) & set(sets[q])) >= 0.8 * len(set(sets[p]) | set(sets[q]))
        label[label == label[q]] = label[p]
    assert all(label[i] == label[j] for i in ids for j in ids[:i] if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])))
    assert neardup.unlinked_pairs(ids, label, sets) == []


def test_the_stage_drops_near_copies(spark, sf):
    rows = list(enumerate(near_texts(3, 30)))
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in groups_by_force(rows)})


def test_the_query(spark, sf, odd_docs):
    """op12: three words, 0.85, texts without words apart."""
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        sets = [shingles(t, 3) for _, t in rows]
        label = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        least = {}
        for (d, _), k in zip(rows, label, strict=True):
            least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
        want = [(d, len(s), least[k], d == least[k]) for (d, _), s, k in zip(rows, sets, label, strict=True)]
        assert sorted(map(tuple, neardup.near_duplicates(df, neardup.QUERY).collect()), key=str) == sorted(want, key=str)


def test_posterior_bounds():
    """The bound is the posterior's: a pair below it has a chance of less than MISS, by a sum over the exact Beta distribution."""
    for least in ((4, 5), (85, 100)):
        for n in range(neardup.BATCH, neardup.VALUES + 1, neardup.BATCH):
            m, t = neardup.needed(least, n), least[0] / least[1]
            x = (np.arange(200_000) + 0.5) / 200_000
            for equal, enough in ((m, True), (m - 1, False)):
                log = equal * np.log(x) + (n - equal) * np.log1p(-x)
                density = np.exp(log - log.max())
                assert (density[x >= t].sum() / density.sum() >= neardup.MISS) == enough


def test_pairs_far_below_are_pruned_and_near_ones_are_not():
    texts_ = near_texts(6, 300)
    signatures = np.stack([np.frombuffer(neardup.sketch(neardup.shingle_set(t))[1], "u1") for t in texts_])
    sets = [shingles(t) for t in texts_]
    kept = set(neardup.plausible(signatures[::2], signatures[1::2], (4, 5)).tolist())
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(i in kept for i, x in enumerate(likeness) if x >= 0.8)
    assert len(neardup.plausible(signatures[:-1], signatures[1:], (4, 5))) <= len(texts_) / 2 + 2


def test_long_sets_of_an_open_band_meet_in_bounded_chunks(spark, monkeypatch):
    """A template of which most are not near: chunks of a few hundred bytes find what one chunk finds."""
    monkeypatch.setattr(neardup, "CHUNK", 16)
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "SMALL_GROUP", 3)
    rows = list(enumerate(near_texts(7, 25, 150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str) == groups_by_force(rows)


def test_no_groups(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark, sf, odd_docs):
    a, b = near_texts(4, 2)[::2]
    rows = [(1, a), (1, a), (1, b), (2, a), (None, b), (None, a), (None, "no copy"), (None, "no copy"), (3, "alone")]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (1, b), (None, "no copy"), (3, "alone")], key=str)
    left = corpus_pipeline.near_dedup(spark, odd_docs, sf)
    assert left.columns == odd_docs.columns
    texts = [r.text for r in left.collect()]
    assert len(texts) == len({shingles(t) for t in texts}) == len({shingles(r.text) for r in odd_docs.collect()})
