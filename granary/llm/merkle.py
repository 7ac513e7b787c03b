"""Merkle manifest of a data set: one root, and for every row the siblings that lead its leaf to it.

Leaves are grouped (by ``lang`` in :func:`manifest`) and ranked by id within their
group; two consecutive nodes become their hash until one is left, the group's
subroot, and the subroots become the root in the same way. A level's last node,
when alone, is hashed alone.

Ranks, subtrees and proofs are distributed. A range-partitioned sort of digests
ranks the leaves, aligned blocks of ``2**BLOCK_HEIGHT`` of them become the nodes
of the next tier, and tiers follow until each group has one node: three of them
are enough for 6.8e10 rows. Downwards, a block's proof is appended to the proofs
of its leaves. Within a block the proofs come from a fractal traversal: at each
level of subtrees of ``SUBTREE_HEIGHT`` it keeps the existing one, which holds the
siblings of the current leaf, and the desired one, which grows by one leaf a
step and replaces it when it is used up. It holds 2 * levels * 2**(height + 1)
nodes at most, whatever the block's size. No text moves, only digests of it.

Defined cases: a null field is hashed as ``-``, so it differs from an empty one;
null groups and null ids come first; rows of one id and group are ordered by
their leaf, and equal rows take the places of each other; a group of one leaf has
the leaf as its subroot, and one group's subroot is the root; texts of any length
are hashed whole; an empty table has no root and gives no rows; further columns,
whatever their names, are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize, partitions

#: Leaves of a block (a power of two) and height of the subtrees of its traversal.
BLOCK_HEIGHT, SUBTREE_HEIGHT = 12, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def join_hash(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields: each its length in bytes, a colon and its value, or a dash if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Subtree:
    """The nodes of levels low to top - 1 below node ``index`` of level top, over n leaves; grown leaf by leaf."""

    def __init__(self, leaves: list[str], low: int, top: int, index: int):
        self.leaves, self.low, self.top = leaves, low, top
        self.next, self.end = index << top, min(len(leaves), (index + 1) << top)
        self.nodes: dict[tuple[int, int], str] = {}
        self.stack: list[tuple[int, int, str]] = []

    def _push(self, level: int, index: int, digest: str) -> None:
        if self.low <= level < self.top:
            self.nodes[level, index] = digest
        self.stack.append((level, index, digest))

    def _lift(self) -> None:
        """The last node, with its left neighbour if that is waiting, becomes a node of the next level."""
        level, index, digest = self.stack.pop()
        if self.stack and self.stack[-1][0] == level:
            digest = join_hash(self.stack.pop()[2], digest)
        else:
            digest = join_hash(digest)
        self._push(level + 1, index >> 1, digest)

    def grow(self) -> None:
        """Take one more leaf; after the last one close what is open on the right."""
        if self.next >= self.end:
            return
        self._push(0, self.next, self.leaves[self.next])
        self.next += 1
        while self.stack[-1][0] < self.top and (len(self.stack) > 1 and self.stack[-2][0] == self.stack[-1][0] or self.next >= self.end):
            self._lift()

    def grown(self) -> Subtree:
        while self.next < self.end:
            self.grow()
        return self

    @property
    def root(self) -> str:
        return self.stack[-1][2]


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    return max(0, n - 1).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    return Subtree(leaves, height, height, 0).grown().root


def traverse(leaves: list[str], height: int) -> Iterator[list[str]]:
    """The siblings of each leaf in turn, one a level: ``l`` or ``r`` for its side and the digest, empty where there is none."""
    cuts = [(low, min(height, low + SUBTREE_HEIGHT)) for low in range(0, height, SUBTREE_HEIGHT)]
    existing = [Subtree(leaves, low, top, 0).grown() for low, top in cuts]
    desired = [Subtree(leaves, low, top, 1) for low, top in cuts]
    for at in range(len(leaves)):
        path = []
        for (low, top), own in zip(cuts, existing, strict=True):
            for level in range(low, top):
                index = at >> level
                sibling = own.nodes.get((level, index ^ 1))
                path.append("" if sibling is None else ("l" if index & 1 else "r") + sibling)
        yield path
        for i, (low, top) in enumerate(cuts):
            desired[i].grow()
            if (at + 1) % (1 << top) == 0:
                existing[i] = desired[i].grown()
                desired[i] = Subtree(leaves, low, top, ((at + 1) >> top) + 1)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    digest = lambda s: F.substring(s, 2, 64)
    both = lambda x, s: F.when(s == "", x).when(s.startswith("l"), F.concat(digest(s), x)).otherwise(F.concat(x, digest(s)))
    return F.aggregate(path, leaf, lambda x, s: F.sha2(both(x, s).cast("binary"), 256))


def path_hash(path: Column) -> Column:
    """Hash of the siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0, within the group, in the given order) and n (the group's rows).

    Rows equal in all of these are ranked in any order, and by a number of their
    own they may lie in different ranges, so no repeated row makes a hot one.
    """
    spark = rows.sparkSession
    numbered = materialize(rows.withColumn("_own", F.monotonically_increasing_id()))
    by = [group, *order, "_own"]
    # The upper bits of _at are the range's number, the lower ones count its rows.
    placed = materialize(numbered.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop("_own").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))  # a group has a run a range at most
    w = Window.partitionBy(group)
    before = F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(group).alias("_group"), F.col("_range").alias("_run"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("n"))
    runs = materialize(runs)
    joined = placed.join(runs, placed[group].eqNullSafe(runs["_group"]) & (placed["_range"] == runs["_run"]))
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_group", "_run", "_first", "_before")


def _height(n: int, most: int) -> int:
    """Height of a block in a tier of n nodes: all blocks of several are equally high."""
    return most if n > 1 << most else height_of(n)


def _roots(most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        root = block_root(table.column("digest").to_pylist(), _height(n, most))
        return table.slice(0, 1).select(["grp", "block"]).append_column("digest", pa.array([root])).append_column("n", pa.array([-(-n >> most)], pa.int64()))

    return run


def _paths(most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        above = table.column("above")[0].as_py()
        paths = [own + above["path"] for own in traverse(table.column("digest").to_pylist(), _height(table.column("n")[0].as_py(), most))]
        out = table.drop_columns(["digest", "n", "block", "above"]).append_column("path", pa.array(paths, pa.list_(pa.string())))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([above[c]] * len(table), pa.string()))
        return out

    return run


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tiers of nodes, lowest first; grp, digest: each group's last node). nodes: grp, rank, n, digest."""
    tiers = [nodes]
    while True:
        up = nodes.select("grp", "rank", "n", "digest", F.shiftright("rank", BLOCK_HEIGHT).alias("block"))
        above = up.groupBy("grp", "block").applyInArrow(_roots(BLOCK_HEIGHT), nodes.select("grp", F.lit(0).cast("long").alias("block"), "digest", "n").schema)
        nodes = materialize(above.select("grp", F.col("block").alias("rank"), "n", "digest"))
        if nodes.where("n > 1").isEmpty():
            return tiers, nodes.select("grp", "digest")
        tiers.append(nodes)


ABOVE = "struct<path: array<string>, subroot: string, root: string>"


def proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's columns but digest and n, and path, subroot, root. above: grp, above: what follows each group's last node."""
    top, key = above.select(F.col("grp").alias("_g"), "above"), None
    for nodes in reversed(tiers):
        rows = nodes.withColumn("block", F.shiftright("rank", BLOCK_HEIGHT))
        on = rows["grp"].eqNullSafe(top["_g"])
        rows = rows.join(top, on if key is None else on & (rows["block"] == top["_b"])).drop("_g", "_b")
        shape = rows.select(*(c for c in rows.columns if c not in ("digest", "n", "block", "above")), "above.*").schema
        # A group is one block: 2**BLOCK_HEIGHT rows at most.
        out = rows.groupBy("grp", "block").applyInArrow(_paths(BLOCK_HEIGHT), shape)
        if nodes is not tiers[0]:
            out = materialize(out)
            top, key = out.select(F.col("grp").alias("_g"), F.col("rank").alias("_b"), F.struct("path", "subroot", "root").alias("above")), "block"
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """The columns of leaves with subroot, root, path: the siblings from the leaf via the subroot to the root.

    leaves: grp, doc_id, digest and what else is to be kept.
    """
    kept = F.struct(*[F.col(c) for c in leaves.columns if c != "grp"]).alias("kept")
    rows = materialize(ranked(leaves.select("grp", "digest", F.col("doc_id").cast("long").alias("_id"), kept), "grp", ["_id", "digest"]).drop("_id"))
    tiers, subroots = tree(rows)
    groups = materialize(ranked(subroots.select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("name")), "grp", ["name"]))
    upper, last = tree(groups)
    # From here to the leaves nothing is joined but one row a group, then one row a block.
    ends = last.select("grp", F.struct(F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")).cast(ABOVE).alias("above"))
    ends = proofs(upper, ends).drop("grp", "subroot")
    ends = ends.join(subroots, ends["name"].eqNullSafe(subroots["grp"])).select("grp", F.struct("path", F.col("digest").alias("subroot"), "root").cast(ABOVE).alias("above"))
    out = proofs(tiers, materialize(ends))
    return out.select("grp", "kept.*", "subroot", "root", "path")


def document_leaves(docs: DataFrame) -> DataFrame:
    """grp, digest, doc_id, tampered: each document's leaf, and what it becomes when n_chars is one more."""
    own = {f: F.col(f) for f in FIELDS}
    more = leaf_hash(*(own | {"n_chars": F.col("n_chars") + 1}).values())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(F.col("lang").alias("grp"), leaf_hash(*own.values()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.when(hit, more).alias("tampered"))
