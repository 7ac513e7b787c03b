"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens. The plan for
packing them depends only on the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus: single, pair and triple sums of the
lengths that are still available are indexed, combinations that fill a gap
exactly are consumed under their counts, and what remains is packed best fit,
longest first. The plan says, for every length, which ranks go to which
sequences; pieces get their ranks from per-task counts, so no length, however
common, has to meet in one task.

Defined cases: null or empty text is a document of the end token alone; null
and repeated ids are kept, every row is packed once; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, discard, materialize

CAPACITY = 2048
END = 0
#: Words whose ids a worker keeps; the cache is emptied when full.
CACHE_WORDS = 600_000


#: Words of these letters, with such a tail or none, are two pieces at most for the tokenizer.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else, so a text's ids
    are those of its words one after another, and words are tokenized once.
    Plain words (letters of Latin-1, then punctuation) go to a byte-pair core
    over the tokenizer's own vocabulary, where a 0xFF byte, which UTF-8 never
    has, stands for the end of a word; all others go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch
        self.known: dict[str, bytes] = {"": b""}
        self.merge = self._core(path)

    @staticmethod
    def _core(path: str):
        """The byte-pair core, or None for a tokenizer of another kind."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", ())}
        vocab, end = model.get("vocab"), model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not end or '[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+' not in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            return None
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if ids != sorted(ids):  # the core takes ids for merge ranks
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                body = token.removesuffix(end)
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * (body != token)] = i
        return tiktoken.Encoding("word ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _learn(self, words: list[str]) -> None:
        rest, known, merge = [], self.known, self.merge
        for w in words:
            m = merge and PLAIN.fullmatch(w)
            if not m:
                rest.append(w)
            elif m[2]:
                known[w] = array("I", merge(m[1].lower().encode() + b"\xff") + merge(m[2].encode() + b"\xff")).tobytes()
            else:
                known[w] = array("I", merge(w.lower().encode() + b"\xff")).tobytes()
        for at in range(0, len(rest), 4096):
            for w, e in zip(rest[at : at + 4096], self.encode(rest[at : at + 4096], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        self._learn(list(set().union(*split).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, at long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, seen = WordIds(path), TaskContext.get().partitionId(), Counter()
        end, step = np.array([END], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(docs), 200):
                rows = []
                for doc, ids in zip(docs[lo : lo + 200], ids_of([t or "" for t in texts[lo : lo + 200]]), strict=True):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        n = len(part) // 4
                        rows.append((doc, i, at // 4, n, zlib.crc32(part), part, task, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, offset) that place all pieces.

    Ranks r of a segment lie at ``offset`` in sequence ``first sequence + r - first rank``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(capacity + 1, np.int64)
    here = left > 0
    here[0] = False
    # pairs[s]: in how many ordered ways two available lengths sum up to s
    pairs = np.rint(np.convolve(here.astype(np.float64), here.astype(np.float64))).astype(np.int64)
    out, sequence = [], 0

    def gone(n: int) -> None:
        nonlocal pairs
        here[n] = False
        others = np.flatnonzero(here)
        pairs[others + n] -= 2
        pairs[2 * n] -= 1

    def consume(lengths: list[int]) -> bool:
        nonlocal sequence
        need = Counter(lengths)
        times = min(int(left[n]) // k for n, k in need.items())
        if not times:
            return False
        offset = 0
        for n in lengths:
            out.append((n, int(used[n]), int(used[n]) + times, sequence, offset))
            used[n] += times
            offset += n
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                gone(n)
        sequence += times
        return True

    def pair(total: int) -> Iterator[list[int]]:
        a = np.arange(min(total - 1, capacity), (total - 1) // 2, -1)
        for x in a[here[a] & here[total - a]]:
            yield [int(x), int(total - x)]

    def complements(first: int) -> Iterator[list[int]]:
        gap = capacity - first
        if gap > 0 and here[gap]:
            yield [gap]
        if pairs[gap] > 0:
            yield from pair(gap)
        a = np.arange(gap - 2, 0, -1)
        for x in a[here[a] & (pairs[gap - a] > 0)] if gap > 2 else ():
            for y in pair(gap - int(x)):
                if y[0] <= x:
                    yield [int(x), *y]

    if here[capacity]:
        consume([capacity])
    for n in range(capacity - 1, 0, -1):
        while here[n]:
            if not any(consume([n, *more]) for more in complements(n)):
                break
    for n in range(capacity, 0, -1):
        while here[n]:
            lengths, gap, taken = [n], capacity - n, Counter([n])
            while gap > 0:
                fits = np.flatnonzero(here[: gap + 1])[::-1]
                best = next((int(x) for x in fits if left[x] > taken[int(x)]), 0)
                if not best:
                    break
                many = min(gap // best, int(left[best]) - taken[best])
                lengths += [best] * many
                taken[best] += many
                gap -= best * many
            consume(lengths)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(placements, pieces): where each piece lies, and the pieces with their token ids.

    placements: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    pieces: the table of token ids, kept in the shared folder; see :func:`sequences`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity), PIECES)
    pieces = materialize(made)
    small = pieces.drop("ids")
    by_task = small.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = materialize(by_task)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(sorted(placed), np.int64).reshape(-1, 5)
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((table, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, begins = shared.value
        # one key for (length, rank): ranks stay far below 2**48
        keys = (segments[:, 0] << 48) + segments[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            hit = segments[at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # base grows with the number of tasks, so it is never broadcast; a key is one length within one task.
    ranked = small.join(base.hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("at"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return out, pieces


def sequences(placements: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed sequences (ids as little-endian uint32 bytes)."""
    ids = pieces.select(F.col("doc_id").alias("_d"), F.col("piece").alias("_p"), F.col("ids_crc32").alias("_c"), "ids").dropDuplicates(["_d", "_p", "_c"])
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p")) & (F.col("ids_crc32") == F.col("_c"))
    laid = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placements.join(ids, same).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), laid.alias("laid"))
    empty = F.lit(b"").cast("binary")
    return joined.select("sequence_id", "n_tokens", F.aggregate("laid", empty, lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def release(pieces: DataFrame) -> None:
    discard(pieces.sparkSession, pieces)
