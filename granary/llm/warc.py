r"""WARC archives and a two-level capture index.

Writing. Payloads of at least ``MIN_REVISIT`` bytes that occur more than once
are stored once, in the record with the largest id; the others are revisit
records that refer to it. Records are gzip members. Spark's text sink writes
them, with an empty gzip member as its line separator, so archives get Spark's
commit protocol (a lost or doubled task leaves nothing behind) and any reader
of concatenated members reads them.

Indexing. Archives are scanned for (key, capture, file, offset, length), where
the key is the URL with its host reversed (``net,example,m)/en/25``). The lines
are range-partitioned, sorted and written as compressed blocks of
``BLOCK_LINES`` lines. The sparse directory holds the first line's key of each
block; it is kept by shard (an index file), and only the first key of each
shard, one row a file, goes to the executors.

Looking up. A key is searched for in the shards, then in the shard's directory,
then in one block, each by bisection; the block and the record are range reads.
Locations are sorted by file and offset before records are read.

Files are read through pyarrow's file systems, so the shared folder can be any
URI that those open.

Defined cases: a null or empty payload is an empty record, never a revisit; a
null url has the key ``-``; a null id is a record that refers to nothing; rows
with the same id, url and payload are records of their own (those with the
largest id are all responses); an empty table gives empty archives; further
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize, partitions, shared_dir, spread_join, utf8

MIN_REVISIT = 1000
BLOCK_LINES = 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:granary:page:"
#: An empty gzip member: what the text sink puts after each record.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def surt(url: str | None) -> str:
    """The URL's key: reversed host, then path and query; scheme, user, fragment and default ports go."""
    if not url:
        return "-"
    url = _line(url)  # as the archive holds it
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.replace(" ", "%20")
    labels = ",".join(reversed(host.split(".")))
    default = port is None or (u.scheme, port) in (("http", 80), ("https", 443))
    rest = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return (labels + ("" if default else f":{port}") + ")" + rest).replace(" ", "%20")


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, refers_url: str | None) -> bytes:
    """One WARC record; with refers it is a revisit, whose payload stays away but keeps its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>", f"WARC-Refers-To-Date: {DATE}"]
        if refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    block = http + (payload if refers is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """(WARC headers, payload, HTTP headers), names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    warc = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, payload, {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])}


def page_of(urn: str | None) -> int | None:
    number = urn.strip("<>").removeprefix(URN) if urn else "None"
    return None if number == "None" else int(number)


class Files:
    """Open files of a store by URI, the latest ones kept."""

    def __init__(self, most: int = 32):
        self.most, self.open = most, OrderedDict()

    def __call__(self, uri: str):
        f = self.open.pop(uri, None)
        if f is None:
            from pyarrow.fs import FileSystem

            fs, path = FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            f = fs.open_input_file(path)
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
        self.open[uri] = f
        return f

    def range(self, uri: str, offset: int, length: int) -> bytes:
        f = self(uri)
        f.seek(offset)
        return f.read(length)


def members(f, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty, in one pass."""
    f.seek(0)
    base, data, at = 0, b"", 0
    z, begin, out = None, 0, []
    while True:
        if at >= len(data):
            base += len(data)
            data, at = f.read(chunk), 0
            if not data:
                if z is not None:
                    raise EOFError("the archive ends within a record")
                return
        if z is None:
            z, begin, out = zlib.decompressobj(31), base + at, []
        out.append(z.decompress(memoryview(data)[at:]))
        at = len(data) - len(z.unused_data)
        if z.eof:
            if content := b"".join(out):
                yield begin, base + at - begin, content
            z = None


def _write(frame: DataFrame, path: str) -> None:
    """Write the only column, gzip members, to files of concatenated members."""
    text = frame.select(F.col(frame.columns[0]).cast("string").alias("value"))
    text.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _listing(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, as Spark's own listing gives them: one a task of the writer."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    return sorted(r["path"] for r in files.toLocalIterator())


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of page_id, url, html under path."""
    bounded_batches(pages.sparkSession, 500)
    body = utf8(F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    large = rows.where(F.col("size") >= MIN_REVISIT).select("page_id", "url", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url"), F.count("*").alias("n_rows"))
    shared = materialize(groups.where("n_rows > 1"))
    joined = spread_join(rows, shared, "digest")
    revisit = (F.col("page_id") < F.col("response")) & (F.col("size") >= MIN_REVISIT)
    refers = F.when(revisit, F.col("response"))
    typed = joined.withColumn("refers", refers).select("page_id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers", "response_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record(p, u, x or b"", d, n, r, v), 3, mtime=0) for p, u, x, d, n, r, v in rows], pa.binary())], ["member"])

    _write(typed.mapInArrow(run, "member binary"), path)


CAPTURE = "surt string, capture string, file string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of the archives under path lies."""
    files = _listing(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with_files = Files(1)
                for offset, length, content in members(with_files(uri)):
                    head = content[: content.index(b"\r\n\r\n")].decode("utf-8", "surrogatepass")
                    fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
                    rows.append((surt(fields.get("WARC-Target-URI")), fields["WARC-Record-ID"].strip("<>"), uri, offset, length))
                    if len(rows) == 5000:
                        yield _batch(rows, CAPTURE)
                        rows = []
                yield _batch(rows, CAPTURE)

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return names.mapInArrow(run, CAPTURE)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines: list[str] = []

    def out() -> pa.RecordBatch:
        member = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
        lines.clear()
        return pa.RecordBatch.from_arrays([pa.array([member], pa.binary())], ["member"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines.append(" ".join(map(str, row)))
            if len(lines) == BLOCK_LINES:
                yield out()
    if lines:
        yield out()


def _key(line: str) -> tuple[bytes, bytes]:
    a, b, _ = line.split(" ", 2)
    return a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")


class Index:
    """The written index: shard files and, by shard, the directories of their blocks."""

    def __init__(self, path: str, shards: list[tuple[tuple[bytes, bytes], int, str]]):
        self.path = path
        self.first = [k for k, _, _ in shards]
        self.shards = [(n, uri) for _, n, uri in shards]


def build_index(rows: DataFrame, path: str) -> Index:
    """Sort captures into blocks under path/blocks, with a directory by shard under path/directory."""
    spark = rows.sparkSession
    rows = materialize(rows)
    ordered = rows.repartitionByRange(partitions(spark), "surt", "capture").sortWithinPartitions("surt", "capture", "file", "offset")
    _write(ordered.mapInArrow(_blocks, "member binary"), f"{path}/blocks")
    files = _listing(spark, f"{path}/blocks")
    directory = "shard int, surt string, capture string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = []
                for offset, length, content in members(Files(1)(uri)):
                    surt_, capture, _ = content.split(b"\n", 1)[0].decode("utf-8", "surrogatepass").split(" ", 2)
                    found.append((n, surt_, capture, offset, length))
                yield _batch(found, directory)

    if not files:
        return Index(path, [])
    names = spark.createDataFrame(list(enumerate(files)), "shard int, file string").repartition(len(files))
    names.mapInArrow(run, directory).write.partitionBy("shard").parquet(f"{path}/directory")
    # One row a shard: as many as the index has files.
    heads = spark.read.schema("surt string, capture string, offset long, length long, shard int").parquet(f"{path}/directory").where("offset = 0").select("shard", "surt", "capture")
    top = sorted(((r["surt"].encode("utf-8", "surrogatepass"), r["capture"].encode()), r["shard"], files[r["shard"]]) for r in heads.toLocalIterator())
    return Index(path, top)


class Searcher:
    """Looks keys up in an index, on an executor; the latest directories and blocks are kept."""

    def __init__(self, index: Index):
        self.index, self.files = index, Files()
        self.directories: OrderedDict[int, tuple] = OrderedDict()
        self.blocks: OrderedDict[tuple, tuple] = OrderedDict()

    def directory(self, shard: int) -> tuple[list, list]:
        if shard not in self.directories:
            import pyarrow.parquet as pq
            from pyarrow.fs import FileSystem

            uri = f"{self.index.path}/directory/shard={shard}"
            fs, path = FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            rows = sorted(((r["surt"].encode("utf-8", "surrogatepass"), r["capture"].encode()), r["offset"], r["length"]) for r in pq.read_table(path, filesystem=fs, partitioning=None).to_pylist())
            self.directories[shard] = ([k for k, _, _ in rows], rows)
            if len(self.directories) > 64:
                self.directories.popitem(last=False)
        return self.directories[shard]

    def block(self, uri: str, offset: int, length: int) -> tuple[list, list]:
        at = (uri, offset)
        if at not in self.blocks:
            lines = gzip.decompress(self.files.range(uri, offset, length)).decode("utf-8", "surrogatepass").split("\n")
            self.blocks[at] = ([_key(x) for x in lines], lines)
            if len(self.blocks) > 16:
                self.blocks.popitem(last=False)
        return self.blocks[at]

    def __call__(self, surt_: str, capture: str | None = None) -> Iterator[tuple]:
        """(surt, capture, file, offset, length) of every capture of the key, or of the one asked for."""
        url = surt_.encode("utf-8", "surrogatepass")
        low = (url, b"" if capture is None else capture.encode())
        inside = (lambda k: k[0] == url) if capture is None else (lambda k: k == low)
        for s in range(max(0, bisect_left(self.index.first, low) - 1), len(self.index.first)):
            if self.index.first[s] > low and not inside(self.index.first[s]):
                return
            shard, uri = self.index.shards[s]
            keys, rows = self.directory(shard)
            for k, offset, length in rows[max(0, bisect_left(keys, low) - 1) :]:
                if k > low and not inside(k):
                    return
                found, lines = self.block(uri, offset, length)
                for i in range(bisect_left(found, low), len(found)):
                    if not inside(found[i]):
                        return
                    a, b, file, at, n = lines[i].rsplit(" ", 4)
                    yield a, b, file, int(at), int(n)


def lookup(index: Index, queries: DataFrame) -> DataFrame:
    """surt, capture, file, offset, length for distinct queries (surt, capture; a null capture asks for all of the key)."""
    spark = queries.sparkSession
    keys = queries.select("surt", "capture").distinct()
    ordered = keys.repartitionByRange(partitions(spark), "surt", "capture").sortWithinPartitions("surt", "capture")
    held = spark.sparkContext.broadcast(index)  # one row an index file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(held.value)
        for b in batches:
            rows = [x for q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in search(*q)]
            yield _batch(rows, CAPTURE)

    return ordered.mapInArrow(run, CAPTURE)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_records(locations: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at file, offset, length. A revisit's payload is null; its size and digest are those of what it refers to."""
    spark = locations.sparkSession
    at = materialize(locations.select("file", "offset", "length"))
    ordered = at.repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for b in batches:
            rows = []
            for uri, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                warc, payload, http = parse(gzip.decompress(files.range(uri, offset, length)))
                kind = warc["warc-type"]
                digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload at {uri}:{offset} doesn't have its digest")
                else:
                    size = int(http["content-length"])
                rows.append((page_of(warc["warc-record-id"]), size, digest, kind, page_of(warc.get("warc-refers-to")), warc.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                if len(rows) == 200:
                    yield _batch(rows, RECORD)
                    rows = []
            yield _batch(rows, RECORD)

    return ordered.mapInArrow(run, RECORD)


def keys_of(pages: DataFrame) -> DataFrame:
    """surt, capture: the index keys of pages."""

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(surt, na_action=None)

    run.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    capture = F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("None")))
    return pages.select(F.pandas_udf(run, "string")(F.col("url").cast("string")).alias("surt"), capture.alias("capture"))


def archive_and_index(pages: DataFrame, path: str | None = None) -> tuple[str, Index]:
    """Write archives and index of pages under path (a folder in the shared one if null)."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archives(pages, f"{path}/warc")
    return path, build_index(captures(spark, f"{path}/warc"), path)
