"""Atomic versions, killed writes, readers that stay, and dead letters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgelake.sources import snapshots
from edgelake.streaming import live

KIND = "instrument string, date date, close double, seq bigint"
DAY = dt.date(2020, 1, 1)


def bars(spark, *rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=d), float(c), s) for i, d, c, s in rows], KIND)


def content(df):
    return {(r["instrument"], (r["date"] - DAY).days): r["close"] for r in df.collect()}


def put(path, rows, **more):
    return snapshots.upsert(path, rows, ["instrument", "date"], "instrument", **more)


def test_versions_share_what_they_do_not_touch(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert snapshots.read(spark, path) is None
    assert put(path, bars(spark, ("A", 1, 1, 1), ("A", 1, 2, 2), ("B/x", 1, 3, 1))) == 1
    pinned = snapshots.read(spark, path)
    assert put(path, bars(spark, ("A", 1, 9, 3), ("A", 2, 4, 3), ("C", 1, 5, 3))) == 2
    assert content(snapshots.read(spark, path)) == {("A", 1): 9, ("A", 2): 4, ("B/x", 1): 3, ("C", 1): 5}
    assert content(pinned) == content(snapshots.read(spark, path, 1)) == {("A", 1): 2, ("B/x", 1): 3}
    assert content(snapshots.read(spark, path, only=["C", "none"])) == {("C", 1): 5}
    one, two = (snapshots.manifest(spark, path, v)["parts"] for v in (1, 2))
    assert one["B/x"] == two["B/x"] and one["A"] != two["A"]
    assert put(path, bars(spark).where("false")) == 3 and len(content(snapshots.read(spark, path))) == 4
    snapshots.clean(spark, path, 1)
    assert snapshots.versions(spark, path) == [3] and len(content(snapshots.read(spark, path))) == 4
    with pytest.raises(ValueError):
        put(path, bars(spark, (None, 1, 1, 1)))


def test_a_killed_write_leaves_the_old_version_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    put(path, bars(spark, ("A", 1, 1, 1), ("B", 1, 2, 1)))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "publish", killed)
    with pytest.raises(KeyboardInterrupt):  # all data are written, the manifest isn't
        put(path, bars(spark, ("A", 1, 9, 2), ("C", 1, 9, 2)))
    monkeypatch.undo()
    failing = bars(spark, ("A", 1, 9, 2)).withColumn("close", F.when(F.col("close") > 0, F.raise_error(F.lit("disk full")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="disk full"):
        put(path, failing)
    assert content(snapshots.read(spark, path)) == {("A", 1): 1, ("B", 1): 2}
    assert put(path, bars(spark, ("A", 1, 9, 2))) == 2
    snapshots.clean(spark, path)
    assert content(snapshots.read(spark, path)) == {("A", 1): 9, ("B", 1): 2} and len(snapshots.listed(spark, f"{path}/data")) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "bars")
    put(path, bars(spark, ("A", 1, 1, 1)))
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish(spark, path, snapshots.manifest(spark, path))


def test_batches_are_merged_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert put(path, bars(spark, ("A", 1, 1, 1)), stream="s", batch=0) == 1
    assert put(path, bars(spark, ("A", 1, 7, 1)), stream="s", batch=0) == 1
    assert content(snapshots.read(spark, path)) == {("A", 1): 1}
    put(path, bars(spark, ("A", 1, 2, 5)), stream="s", batch=2, order="seq")
    put(path, bars(spark, ("A", 1, 3, 4), ("A", 2, 3, 4)), stream="s", batch=1, order="seq")  # late: newer rows stay
    assert content(snapshots.read(spark, path)) == {("A", 1): 2, ("A", 2): 3}


def test_a_replayed_stream_equals_an_unbroken_one(spark, tmp_path):
    """The second of four batches fails until it is replayed; the stream goes on, restarts, and nothing is lost or doubled."""
    parts = [bars(spark, ("A", 1, 1, 1), ("B", 1, 1, 2)), bars(spark, ("A", 1, -2, 3), ("A", 2, -2, 4), ("C", 1, -2, 5)), bars(spark, ("A", 2, 3, 6)), bars(spark, ("B", 1, 4, 7))]
    table, letters, broken = str(tmp_path / "bars"), str(tmp_path / "letters"), [True]
    plain = live.version_step(table, ["instrument", "date"], "instrument", "seq")

    def step(batch, number):
        if broken[0] and batch.where("close < 0").count():
            raise ValueError("poison")
        plain(batch, number)

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i != 2:  # twice a batch alone, once two batches after a restart
            query = live.start(live.read_stream(spark, str(tmp_path / "in"), KIND), live.quarantined(step, letters), str(tmp_path / "state"))
            query.awaitTermination(180)
            assert query.exception() is None
    assert live.dead_letters(spark, letters) == [1]
    kept = spark.read.parquet(f"{letters}/batch-1")
    assert kept.count() == 3 and {(r["_batch"], r["_error"], r["_message"]) for r in kept.collect()} == {(1, "ValueError", "poison")}
    with pytest.raises(ValueError):
        live.replay(spark, letters, step)
    assert live.dead_letters(spark, letters) == [1]
    broken[0] = False
    assert live.replay(spark, letters, step) == [1] and live.replay(spark, letters, step) == []
    unbroken = str(tmp_path / "unbroken")
    query = live.upsert_versions(live.read_stream(spark, str(tmp_path / "in"), KIND), unbroken, str(tmp_path / "state2"), ["instrument", "date"], "instrument", "seq", letters)
    query.awaitTermination(180)
    assert content(snapshots.read(spark, table)) == content(snapshots.read(spark, unbroken)) == {("A", 1): -2, ("A", 2): 3, ("B", 1): 4, ("C", 1): -2}
