"""The topics' flow: replays, late and repeated records, and time-outs."""

import json
import time

import pytest

from granary.sources import snapshots
from granary.streaming import topics


def record(product, price, **more):
    return json.dumps({"product_id": product, "item_name": "tea", "price": price} | more)


@pytest.fixture
def feed(spark, tmp_path):
    def add(*rows):
        spark.createDataFrame(list(rows), topics.RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return add


def prices(spark, path):
    return {r.product_id: (r.version, r.price) for r in topics.current(spark, path).collect()}


def test_late_and_repeated_records(spark, tmp_path, feed):
    out = str(tmp_path / "latest")

    def run():
        topics.keep_latest(topics.read_raw(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
        return prices(spark, out)

    feed((record("a", 1.0), 5), (record("b", 2.0), 6), (record("a", 3.0), 7), ("{oops", 8), (record(None, 1.0), 9), (record("c", -1.0), 9), (None, 9), ("", 9))
    assert run() == {"a": (7, 3.0), "b": (6, 2.0)}
    parts = snapshots.current(spark, out)
    feed((record("a", 9.0), 6), (record("a", 3.0), 7), (record("b", 2.0), 6))  # late and repeated: nothing is written
    assert run() == {"a": (7, 3.0), "b": (6, 2.0)} and snapshots.current(spark, out) == parts
    feed((record("b", 4.0), 8), (record("a", 9.5), None), (record("d", 1.0), None), (record("b", 5.0), 8))
    assert run() == {"a": (7, 3.0), "b": (8, 5.0), "d": (-1, 1.0)}  # of equal versions the larger payload
    assert snapshots.every(spark, out, "products").where("product_id = 'b'").count() == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path, feed):
    """The engine's note that the last batch is done is lost, as when the driver dies after the sink's commit: the batch runs again."""
    for flow, name, rows in ((topics.keep_latest, "products", 2), (topics.split, "extracted", 3)):
        out, cp, source = str(tmp_path / name), tmp_path / f"cp_{name}", tmp_path / f"in_{name}"
        spark.createDataFrame([(record("a", 1.0), 1), (record("a", 2.0), 2), (record("b", 1.0), 3), ("{", 4)], topics.RAW).coalesce(1).write.parquet(str(source))
        run = lambda: flow(topics.read_raw(spark, str(source)), out, str(cp)).awaitTermination()  # noqa: B023, E731
        run()
        before = snapshots.current(spark, out)
        assert len(before[1]) == 1 and snapshots.versions(spark, out, name).count() == rows
        for f in list((cp / "commits").iterdir()):
            f.unlink()
        run()
        assert snapshots.current(spark, out) == before and snapshots.versions(spark, out, name).count() == rows


def test_a_batch_that_dies_before_its_commit_is_written_anew(spark, tmp_path, feed, monkeypatch):
    out = str(tmp_path / "out")
    feed((record("a", 1.0), 1), ("{", 2))
    run = lambda: topics.split(topics.read_raw(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    with pytest.raises(FileNotFoundError):
        snapshots.versions(spark, out, "extracted")
    run()
    assert snapshots.versions(spark, out, "extracted").count() == 1 and snapshots.versions(spark, out, "failed").first().error == "value: not a JSON record"


def test_quiet_products_leave_the_state(spark, tmp_path, feed):
    """After the time-out an old version is given once more, and the newest still counts."""
    out = str(tmp_path / "latest")

    def run():
        topics.keep_latest(topics.read_raw(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), keep_ms=1000).awaitTermination()

    feed((record("a", 3.0), 7))
    run()
    time.sleep(1.5)
    feed((record("b", 1.0), 1))
    run()
    feed((record("a", 1.0), 5))
    run()
    assert prices(spark, out) == {"a": (7, 3.0), "b": (1, 1.0)}
    assert snapshots.every(spark, out, "products").where("product_id = 'a'").count() == 2
