"""Manifests against trees built by force, and the traversal against them at every size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path_by_force(levels, at):
    out = []
    for own in levels[:-1]:
        out.append(("l" if at & 1 else "r") + own[at ^ 1] if at ^ 1 < len(own) else "")
        at >>= 1
    return out


def fold(leaf, path):
    for s in path:
        leaf = h(leaf) if not s else h(s[1:], leaf) if s[0] == "l" else h(leaf, s[1:])
    return leaf


def manifest_by_force(rows):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: h("".join(map(text, (d, s, g, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    upper = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = path_by_force(trees[g], i) + path_by_force(upper, k)
            start = leaf(r[0], r[1], r[2], None if r[3] is None else r[3] + 1, r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            folded = fold(start, path)
            out.append((r[0], own, trees[g][-1][0], upper[-1][0], h(*(s[1:] for s in path)), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def result(docs):
    out = merkle.manifest(merkle.document_leaves(docs))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("path"))
    return sorted(((r.doc_id, r.digest, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in out.select("doc_id", "digest", "subroot", "root", merkle.path_hash(F.col("path")).alias("proof"), folded.alias("folded")).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 33, 64, 100, 255, 257])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    height = merkle.height_of(n)
    assert list(merkle.traverse(leaves, height)) == [path_by_force(levels, i) for i in range(n)]
    assert merkle.block_root(leaves, height) == levels[-1][0]


def test_traversal_holds_few_nodes(monkeypatch):
    most = 0
    grow = merkle.Subtree.grow

    def counted(self):
        nonlocal most
        grow(self)
        most = max(most, len(self.nodes) + len(self.stack))

    monkeypatch.setattr(merkle.Subtree, "grow", counted)
    assert sum(1 for _ in merkle.traverse([h(str(i)) for i in range(4096)], 12)) == 4096
    assert most <= 2 ** (merkle.SUBTREE_HEIGHT + 1) + 13


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_manifest(name, request):
    df = request.getfixturevalue(name)
    assert result(df) == manifest_by_force(rows_of(df))


def test_many_blocks_and_groups(spark, monkeypatch):
    """Three tiers of blocks, groups of one row, null and multi-byte names, repeated rows."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", 2)
    names = [None, "", "a", "é", "z", "漢"]
    rows = [(i * 7 % 91, "s", "a", i, f"text {i}") for i in range(70)] + [(i, None, g, None, None) for i, g in enumerate(names)] + [(5, "s", "b", 1, "same")] * 9 + [(None, "s", f"g{i}", 1, "x") for i in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert result(df) == manifest_by_force(rows)


def test_no_documents(no_docs):
    assert result(no_docs) == []
