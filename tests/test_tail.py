"""Numbers of a stream over restarts and repeated deliveries, and readers' cursors."""

import json

import pytest

from quantloom.streaming import tail


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_numbers_go_on_over_restarts(rocksdb, tmp_path):
    spark, source, out = rocksdb, tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    rounds = [[("a", "e1", 1), ("a", "e0", 0), ("b", "x", 5)], [("a", "e1", 1), ("a", "e2", 9), ("b", "y", 6), ("b", "y", 6)], [("c", "z", 1), ("a", "e3", 3), ("b", "x", 5)]]
    for k, rows in enumerate(rounds):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"key": key, "event_id": e, "ts": f"2024-01-01T00:00:0{s}Z", "payload": e.upper()}) for key, e, s in rows))
        events = spark.readStream.schema("key string, event_id string, ts timestamp, payload string").json(str(source))
        query = tail.numbered(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(60)
    got = sorted((r.key, r.sequence, r.event_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "e0"), ("a", 2, "e1"), ("a", 3, "e2"), ("a", 4, "e3"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z")]
    log = spark.read.parquet(out)
    read, cursor = [], 0
    while rows := tail.poll(log, spark.createDataFrame([("a", cursor)], "key string, cursor long"), 3).orderBy("sequence").collect():
        read += [r.event_id for r in rows]
        cursor = rows[-1].sequence
    assert read == ["e0", "e1", "e2", "e3"]


def test_a_cursor_before_the_log_is_reset(spark):
    log = spark.createDataFrame([("a", k) for k in range(5, 300)] + [("b", 1)], "key string, sequence long")
    cursors = spark.createDataFrame([("a", 2), ("b", 0), ("none", 7)], "key string, cursor long")
    rows = tail.poll(log, cursors).collect()
    assert sorted(r.sequence for r in rows if r.key == "a") == list(range(5, 105)) and all(r.reset for r in rows if r.key == "a")
    assert [(r.sequence, r.reset) for r in rows if r.key == "b"] == [(1, False)]
    assert not tail.poll(log, spark.createDataFrame([("a", 299)], "key string, cursor long")).count()
    assert [r.reset for r in tail.poll(log, spark.createDataFrame([("a", 4)], "key string, cursor long"), 1).collect()] == [False]
