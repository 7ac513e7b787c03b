"""Stages go through the operator that they are named after."""

import corpus_pipeline
from granary.llm import neardup, simhash


def test_near_dedup_takes_candidates_from_simhash(spark, sf, monkeypatch):
    """The stage's candidates came from MinHash alone."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words))), (4, ""), (5, " ".join(words))], "doc_id long, text string")
    fps = [simhash.fingerprint(t) for t in (" ".join(words), " ".join([*words, "more"]))]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.THRESHOLD
    classes = spark.createDataFrame([(i, 1, simhash.fingerprint(r.text) - (1 << 64 if simhash.fingerprint(r.text) >> 63 else 0)) for i, r in enumerate(docs.collect()) if r.text], "uid long, n long, fp long")
    pairs = {(r.u, r.v) for r in neardup.simhash_pairs(classes).collect()}
    assert pairs == {(0, 1), (0, 4)}
    called = []
    real = neardup.simhash_pairs
    monkeypatch.setattr(neardup, "simhash_pairs", lambda c: called.append(1) or real(c))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3, 4] and called
