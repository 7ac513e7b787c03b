"""Sources and sinks: catalogs, JSON lines, images, logs, checkpoints."""

from __future__ import annotations

import io
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import snapshots

CATALOG = "sample_id long, catalog_content string, image_link string, price double"
EXTRACTION = (
    "sample_id string, catalog_content string, price double, bucket string, prediction struct<product_id:string,item_name:string,brand:string,category:string,"
    "price:double,quantity_value:double,extraction_confidence:double,quantity_unit:string,pack_size:int,dietary_tags:array<string>,allergen_list:array<string>>"
)


def read_catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV catalog whose texts hold line feeds; only the columns asked for are parsed."""
    df = spark.read.schema(CATALOG).options(header=True, multiLine=True, escape='"').csv(path)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """JSON lines without the bad ones; pos is a text that orders them by file name, then by place in the file.

    Spark packs files and cuts them into splits as it likes, so pos is made of what
    the scan says of each line: its file, where its split starts, and the line's
    number within the task, which follows the file within a split.
    """
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    pos = F.concat_ws(":", F.col("_metadata.file_path"), number(F.col("_metadata.file_block_start")), number(F.monotonically_increasing_id()))
    lines = spark.read.text(path).select("value", pos.alias("pos"))
    bad = schema + ", _bad string"
    parsed = lines.where(F.trim("value") != "").withColumn("p", F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("p is not null and p._bad is null").select("pos", "p.*").drop("_bad")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records with a prediction and high confidence."""
    return read_json_lines(spark, path).where(F.col("prediction").isNotNull() & (F.col("bucket") == "high_conf"))


def records(df: DataFrame) -> DataFrame:
    """Extraction records as the graph and the vector index take them."""
    p = F.col("prediction")
    names = ("item_name", "brand", "category", "price", "quantity_value", "quantity_unit", "pack_size", "dietary_tags", "allergen_list", "extraction_confidence")
    return df.select("pos", "sample_id", F.coalesce(p["product_id"], F.col("sample_id")).alias("product_id"), *(p[n].alias(n) for n in names), "catalog_content")


def read_images(spark: SparkSession, path: str, probe: bool = True) -> DataFrame:
    """path, length and, with probe, width and height (null if unreadable; needs an imaging library)."""
    df = spark.read.format("binaryFile").load(path)
    if not probe:
        return df.select("path", "length")

    def size(content: pd.Series) -> pd.DataFrame:
        def one(b: bytes) -> tuple[int | None, int | None]:
            try:
                from PIL import Image

                with Image.open(io.BytesIO(b)) as im:
                    return im.size
            except (ImportError, OSError):
                return (None, None)

        return pd.DataFrame([one(b) for b in content], columns=["width", "height"])

    size.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}
    return df.select("path", "length", F.pandas_udf(size, "width int, height int")("content").alias("s")).select("path", "length", "s.*")


#: Rows of a CSV file at most: one whose texts hold line feeds is read whole by one task.
CSV_ROWS = 50_000


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", CSV_ROWS).options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_checkpoint(done: DataFrame, path: str) -> None:
    """Append ids and success flags; :func:`granary.operators.datasets.resume` reads them."""
    done.write.mode("append").parquet(path)


def write_failures(df: DataFrame, path: str, text_chars: int = 200, error_chars: int = 300) -> None:
    """A failure log with shortened texts and errors."""
    write_csv(df.withColumns({"catalog_content": F.substring("catalog_content", 1, text_chars), "error": F.substring("error", 1, error_chars)}), path, "append")


GRAPH = {"products": "price", "brand_edges": "brand", "category_edges": "category", "tag_edges": "tag", "allergen_edges": "allergen"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_graph(spark: SparkSession, path: str):
    """The graph as its last snapshot has it: the last version of each product, the edges of all versions."""
    from granary.operators.graph import Graph

    return Graph(snapshots.last_of(spark, path, "products", "product_id"), *(snapshots.every(spark, path, name) for name in GRAPH if name != "products"))


def write_graph(graph, path: str) -> None:
    """Upsert a graph: stored products are replaced by those of the same id, edges accumulate.

    What is written is the new graph alone, and one commit makes its five tables
    visible together. Each is sorted by its lookup key, so that min/max statistics prune.
    """
    snapshots.append(graph.products.sparkSession, path, {name: getattr(graph, name).sortWithinPartitions(key) for name, key in GRAPH.items()})


def read_vectors(spark: SparkSession, path: str, key: str = "point_id") -> DataFrame:
    """The last version of each stored point."""
    return snapshots.last_of(spark, path, "points", key)


def write_vectors(points: DataFrame, path: str) -> None:
    """Upsert vectors: a stored point gives way to one of the same id. What is written is the new points alone."""
    snapshots.append(points.sparkSession, path, {"points": points.sortWithinPartitions("category", "price")})


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """A list of ids as JSON lines."""
    write_json_lines(df.select(column).distinct(), path, "overwrite")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def http_get(timeout: float = 5.0) -> Callable[[str], bytes]:
    """A ``get`` for :func:`fetch`: the body behind a URL, or an error after ``timeout`` seconds without an answer."""

    def get(url: str) -> bytes:
        from urllib.request import urlopen

        with urlopen(url, timeout=timeout) as answer:
            return answer.read()

    return get


def outcome(error: BaseException) -> str:
    """The kind of a failed download: ``timeout``, ``not found``, ``status N``, else ``failed`` with the error's text."""
    code = getattr(error, "code", None) or getattr(getattr(error, "response", None), "status_code", None)
    if isinstance(code, int):
        return "not found" if code == 404 else f"status {code}"
    if isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError) or "Timeout" in type(error).__name__:
        return "timeout"
    return f"failed: {error}"[:200]


def _pooled(urls: list[str | None], one: Callable[[int], str], pool: ThreadPoolExecutor, workers: int, per_host: int) -> list[str]:
    """one(i) of every place, at most ``workers`` at once and ``per_host`` of one host; a host at its limit holds up no other."""
    waiting: dict[str, deque[int]] = {}
    for i, u in enumerate(urls):
        waiting.setdefault(urlsplit(u or "").netloc, deque()).append(i)
    out, busy, running = [""] * len(urls), dict.fromkeys(waiting, 0), {}
    while waiting or running:
        for host in list(waiting):
            while waiting.get(host) and busy[host] < per_host and len(running) < workers:
                i = waiting[host].popleft()
                busy[host] += 1
                running[pool.submit(one, i)] = (host, i)
            if not waiting[host]:
                del waiting[host]
        for f in wait(running, return_when=FIRST_COMPLETED).done:
            host, i = running.pop(f)
            busy[host] -= 1
            out[i] = f.result()
    return out


def fetch(
    df: DataFrame, id_: str, url: str, get: Callable[[str], bytes], keep: Callable[[str, bytes], None], have: Callable[[str], bool] | None = None, workers: int = 10, per_host: int = 10, report: DataFrame | None = None
) -> DataFrame:
    """id, url, status of each row's download; ``get`` fetches, ``keep`` stores and ``have`` tells what is stored, all on the executors.

    A task downloads ``workers`` at once and ``per_host`` of one host; over the cluster
    these count once a running task, so repartition df to set the total. A time-out is
    the hook's (:func:`http_get` has one). ids of ``report``, an earlier result, whose
    status is ok or exists are ``exists`` without asking ``have``: a restart downloads
    nothing twice. A failure is a status (:func:`outcome`) and never ends the job; a
    null URL is ``failed: no URL``. Repeated ids are downloaded once in each of their rows,
    unless ``have`` knows them by then. Nothing else depends on order or layout.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for part in parts:
                ids, urls = [str(i) for i in part[id_]], [u if isinstance(u, str) else None for u in part[url]]
                stored = part["_have"].tolist()

                def one(k: int, ids=ids, urls=urls, stored=stored) -> str:
                    try:
                        if stored[k] or have is not None and have(ids[k]):
                            return "exists"
                        if not urls[k]:
                            return "failed: no URL"
                        keep(ids[k], get(urls[k]))
                        return "ok"
                    except Exception as e:
                        return outcome(e)

                yield pd.DataFrame({id_: ids, url: urls, "status": _pooled(urls, one, pool, workers, per_host)})

    rows = df.select(F.col(id_).cast("string").alias(id_), url)
    if report is None:
        rows = rows.withColumn("_have", F.lit(False))
    else:
        done = report.where(F.col("status").isin("ok", "exists")).select(F.col(id_).cast("string").alias("_id")).distinct()
        rows = rows.join(done, F.col(id_) == F.col("_id"), "left").select(id_, url, F.col("_id").isNotNull().alias("_have"))
    return rows.mapInPandas(run, f"{id_} string, {url} string, status string")


def download_summary(statuses: DataFrame) -> DataFrame:
    """Downloads by kind of status, and which kinds leave a usable file."""
    kind = F.when(F.col("status").startswith("failed"), "failed").otherwise(F.col("status"))
    return statuses.groupBy(kind.alias("status")).agg(F.count("*").alias("n")).withColumn("usable", F.col("status").isin("ok", "exists"))
