"""What the work of one task may grow with."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.functions import vocab
from granary.operators import weak
from granary.plans import catalog, coverage
from granary.sources import files
from granary.sources.tables import numbered


def busy(df):
    """Tasks that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_listings_are_dealt_over_all_cores(spark, sf):
    """A table that is small as a file was read, and all its texts parsed, by one task."""
    assert busy(catalog.listings(spark, sf)) == busy(coverage.parse_product(spark, sf)) == spark.sparkContext.defaultParallelism


def test_votes_are_dealt_over_all_cores_and_search_few_texts(spark, sf):
    """Phrases were voted on by one task, and every text was searched by all patterns."""
    assert busy(coverage.both_votes(spark, sf)) == spark.sparkContext.defaultParallelism
    held = catalog.listings(spark, sf).select(F.explode(weak.words_held(weak.plain(F.col("catalog_content")))).alias("i"))
    assert [list(weak.WORDS)[r.i] for r in held.distinct().collect()] == ["lf_kosher_keyword"]  # "ounce" holds "ou"


def test_pack_sizes_are_dealt_over_all_cores(spark, sf):
    assert busy(coverage.pack_patterns(spark, sf)) == spark.sparkContext.defaultParallelism


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """A file whose texts hold line feeds is read by one task, so no writer may make it as long as it likes."""
    monkeypatch.setattr(files, "CSV_ROWS", 10)
    rows = spark.range(95).coalesce(1).select(F.col("id").alias("sample_id"), F.lit("a\nb").alias("catalog_content"), F.lit("e").alias("error"))
    files.write_failures(rows, str(tmp_path / "log"))
    assert len(list(Path(tmp_path / "log").glob("part-*"))) == 10
    assert spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "log")).count() == 95


def test_listing_parts_of_odd_texts(spark):
    """The faster forms say what the plain patterns say."""
    ends = ["", " ", "\n", " \x85", "x", "x\n", "x\ny", "x\n\nValue:", "\nValue: 1", "Value:", "\n Value:2\nValue:3", "a" * 9000 + "\nb" * 9000, "\U0001f600 z\r\nValue:"]
    texts = [f"{a}Product Description:{s}{e}" for a in ("", "Item Name: 　t \n") for s in ("", " ", "\n", " \n\t") for e in ends] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    lazy = F.regexp_extract("t", tx.pattern(r"(?s)Product Description:\s*(.+?)(?:\nValue:|\z)"), 1)
    plain = F.nullif(F.regexp_replace(lazy, tx.pattern(r"^\s+|\s+$"), ""), F.lit(""))
    assert df.where(~plain.eqNullSafe(tx.found(F.col("t"), tx.DESCRIPTION))).collect() == []

    words = [*vocab.TAG_ALIASES, "KETO Diet, tree NUT free", "gluten-free certified", "nothing", "", None, "veganorganic non-dairy"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for t, own in df.select("t", tx.scan_aliases(F.col("t"), vocab.TAG_ALIASES)).collect():
        assert (own or []) == sorted({c for a, c in vocab.TAG_ALIASES.items() if a in (t or "").lower()}), t
    assert not re.search(r"\S", tx.SPACE)


def test_similar_names_send_no_table_through_the_driver(spark, sf):
    """Tables of names, keys and pairs were broadcast, and so built in the driver's memory, wherever they seemed small."""
    out = catalog.dedup_fuzzy(spark, sf)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 0 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_similar_names_shuffle_little(spark):
    """Some 140 keys a name, and names for each part of a frequent piece, went through shuffles: 9 KB a name at sf0.1, and more with more names."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        own = sc.statusStore().executorList(True)
        return sum(own.apply(i).totalShuffleWrite() for i in range(own.size()))

    before = shuffled()
    assert catalog.dedup_fuzzy(spark, "/root/testdata/sf0.01").count() > 0
    assert shuffled() - before < 1500 * 2000


def test_line_numbers_take_no_single_task(spark, sf):
    """The numbers of all lines came from one window, and so from one task."""
    plan = coverage.io_json_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "place" in plan and not re.search(r"Window.*pos#", plan)


def test_numbers_of_rows(spark):
    df = spark.range(1000).repartition(7).select(F.format_string("%05d", (F.col("id") * 37) % 1009).alias("pos"))
    got = [r.n for r in numbered(df, "pos", "n").orderBy("pos").collect()]
    assert got == list(range(1, 1001)) and numbered(df.limit(0), "pos", "n").collect() == []


def test_raw_records_lie_in_more_files_as_they_grow(spark, sf, tmp_path):
    """Four files, whatever the records, were written and read by four tasks."""
    assert coverage.raw_topic(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    spark.range(30_000_000).select(F.col("id").alias("event_id")).where("event_id < 0").write.parquet(str(tmp_path / "none/events.parquet"))
    spark.range(9_000_001).select(F.lit(None).cast("string").alias("x")).coalesce(1).write.parquet(str(tmp_path / "many/events.parquet"))
    assert coverage.raw_files(spark, str(tmp_path / "none")) == 8 and coverage.raw_files(spark, str(tmp_path / "many")) == 10
