"""Files, pinned inputs, artifacts, bundles, model registry: small cases with expected results."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.operators import experiments as X
from quantloom.operators import learning, serving
from quantloom.operators import portfolio as N
from quantloom.operators import views as V
from quantloom.sources import files
from quantloom.sources import market as M
from quantloom.streaming import jobs


def test_paths_and_names():
    entry = {"full_path": "f.csv", "train_path": "tr.csv", "test_path": "te.csv"}
    assert M.split_path(entry, "train", True, lambda p: True) == "tr.csv"
    assert M.split_path(entry, "train", True, lambda p: False) == M.split_path(entry, "full", True, lambda p: True) == M.split_path(entry, "test", False, lambda p: True) == "f.csv"
    assert M.market_proxy({}) == "E1VFVN30" and M.market_proxy({"market_proxy": "X"}) == "X"
    for bad in (" ", None, 3):
        with pytest.raises(ValueError):
            M.market_proxy({"market_proxy": bad})
    config = {"default_selection": ["A"], "assets": {n: {"full_path": "x", "date_col": "d", "price_col": "p"} for n in "AB"}}
    assert list(files.resolved(config)) == ["A"] and list(files.resolved(config, ["B"])) == ["B"]
    for wrong in (["C"],):
        with pytest.raises(ValueError):
            files.resolved(config, wrong)
    assert files.period("test") == ("2023-10-01", "2026-07-01") and files.period("test", "a", "b") == ("a", "b") and files.period("test", "a") == files.PHASES["test"]


def test_lists_and_series(spark, tmp_path):
    (tmp_path / "list.txt").write_text("AAA\n  BBB \n\nCCC")
    assert sorted(r.ticker for r in M.tickers(spark, {}, str(tmp_path / "list.txt")).collect()) == ["AAA", "BBB", "CCC"]
    assert [r.ticker for r in M.tickers(spark, {"vn30_universe": [" X "]}, "nowhere").collect()] == ["X"]
    for name, lines in (("train", ["2020-01-02,1", "2020-01-03,2", "bad,3"]), ("test", ["2020-01-03,5", "2020-01-06,", "07/01/2020,8"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["date,close", *lines]) + "\n")
    rows = files.read_series(spark, [str(tmp_path / "train.csv"), str(tmp_path / "test.csv")], "A", "date string, close double", start="2020-01-03")
    assert [(str(r.d), r.px) for r in rows.orderBy("d").collect()] == [("2020-01-03", 5.0), ("2020-01-07", 8.0)]
    files.write_splits(rows, str(tmp_path / "out"), "2020-01-03")
    n = {k: spark.read.option("header", True).csv(str(tmp_path / "out" / k)).count() for k in ("full", "train", "test")}
    assert n == {"full": 2, "train": 1, "test": 2}
    idx = spark.createDataFrame([("VN30", " B"), ("VN30", "A"), ("VN30", "A"), ("X", "Z")], "index string, ticker string")
    assert [r.ticker for r in M.members(idx, "VN30").collect()] == ["A", "B"]


def test_bars(spark, tmp_path):
    for folder in ("d", "d/indices"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for s in "CAB":
            (tmp_path / folder / f"{s}.csv").write_text(f"date,open,high,low,close,volume,symbol\n2020-01-02,1,2,1,2,10,{s}{'I' if 'ind' in folder else ''}\n")
    names = lambda df: sorted(r.symbol for r in df.collect())
    assert names(M.bars(spark, str(tmp_path / "d"), index=True)) == ["AI", "BI", "CI"]
    assert names(M.bars(spark, str(tmp_path / "d" / "*.csv").replace("/indices", ""), first=1, batch=1)) == ["B"]


def test_trusted_csv(spark, tmp_path):
    data = "﻿date,price,extra\r\n2024-01-02,5.5,x\r\nbad,1,y\r\n2024-01-04,,z\r\n2024-01-05,-1,q\r\n".encode()
    (tmp_path / "a.csv").write_bytes(data)
    pin = hashlib.sha256(data).hexdigest()
    rows = M.trusted_csv(spark, str(tmp_path), "a.csv", pin, ["date", "price"])
    assert [(r.row_number, r.date, r.price) for r in rows.orderBy("row_number").collect()] == [(1, "2024-01-02", "5.5"), (2, "bad", "1"), (3, "2024-01-04", None), (4, "2024-01-05", "-1")]
    assert [(r.row_number, r.code) for r in M.row_findings(rows).collect()] == [(2, "INVALID_DATE"), (3, "MISSING_VALUE"), (4, "INVALID_PRICE")]
    assert M.coverage(rows).first()[:] == M.coverage(rows.filter("date <> 'bad'")).first()[:]
    for name, sha, columns in (("../a.csv", pin, ["date"]), ("/a.csv", pin, ["date"]), ("a.csv", "0" * 64, ["date"]), ("a.csv", pin, ["none"])):
        with pytest.raises(ValueError):
            M.trusted_csv(spark, str(tmp_path), name, sha, columns)


def test_artifacts_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b|", 1.5), (2, "b|", 1.5)], "k int, s string, x double")
    root = str(tmp_path / "store")
    name = M.store_artifact(rows, root)
    assert M.store_artifact(rows.orderBy(F.desc("k")), root) == name and M.load_artifact(spark, root, name).count() == 3
    assert len({M.content_hash(x) for x in (rows, rows.distinct(), rows.withColumn("s", F.lit("a")), rows.limit(0))}) == 4
    rows.limit(1).write.mode("append").parquet(f"{root}/{name}")
    with pytest.raises(ValueError):
        M.load_artifact(spark, root, name)
    sha = M.publish_snapshot(rows, root, "s1")
    assert M.load_snapshot(spark, root, "s1", sha).count() == 3
    for args in (("s1", "0"), ("s1", sha, 1)):
        with pytest.raises(ValueError):
            M.load_snapshot(spark, root, *args)


def test_a_crash_or_a_second_writer_loses_no_bundle(spark, tmp_path, monkeypatch):
    root, log = str(tmp_path / "bundles"), tmp_path / "bundles" / "log"
    one = lambda i, day: {"id": i, "universe": "u", "decision_at": day}
    M.publish_bundle(spark, root, one("a", "2024-01-02"))
    whole = (log / "0000000001.json").read_text()
    for k, torn in enumerate(("", whole[:20], whole.replace("2024-01-02", "2025-01-02"), "[1]")):  # what a crash or damage leaves
        (log / f"{k + 2:010d}.json").write_text(torn)
        assert [x["id"] for x in M.read_catalog(spark, root)] == ["a"]
    assert [x["id"] for x in M.publish_bundle(spark, root, one("b", "2024-01-01"))] == ["a", "b"]
    assert (log / "0000000006.json").exists()

    seen, other = M._commits, []

    def raced(*args):
        """Another writer commits between our look and our write."""
        found = seen(*args)
        if not other:
            other.append(1)
            (log / f"{found[0] + 1:010d}.json").write_text(whole.replace('"a"', '"x"').replace(M._checksum(one("a", "2024-01-02")), M._checksum(one("x", "2024-01-02"))))
        return found

    monkeypatch.setattr(M, "_commits", raced)
    assert [x["id"] for x in M.publish_bundle(spark, root, one("d", "2024-01-09"))] == ["d", "x", "a", "b"]
    assert sorted(p.name for p in log.glob("*.json")) == [f"{k:010d}.json" for k in range(1, 9)]


def test_bundles(spark, tmp_path):
    root = str(tmp_path / "bundles")
    for i, day in (("a", "2024-01-02"), ("c", "2024-01-05"), ("b", "2024-01-03")):
        M.publish_bundle(spark, root, {"id": i, "universe": "u" if i != "b" else "v", "decision_at": day, "demo": i == "a"})
    assert [x["id"] for x in M.read_catalog(spark, root, demo=True)] == ["c", "b", "a"]
    assert [x["id"] for x in M.read_catalog(spark, root)] == ["c", "b"] and [x["id"] for x in M.read_catalog(spark, root, "v")] == ["b"]
    with pytest.raises(Exception):  # an entry is immutable
        M.publish_bundle(spark, root, {"id": "a", "universe": "u", "decision_at": "2025-01-01"})
    assert [x["id"] for x in M.publish_bundle(spark, root, {"id": "c", "universe": "u", "decision_at": "2024-01-05", "demo": False})] == ["c", "b", "a"]
    M.write_run({"nav": spark.range(3)}, str(tmp_path / "run"))
    M.write_metrics(spark.range(3), str(tmp_path / "metrics"))
    assert len(list((tmp_path / "metrics").glob("*.csv"))) == 1


def test_model_registry(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 60).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("d"), *[(F.rand(i) - 0.5).alias(c) for i, c in enumerate(serving.FEATURES)])
    rows = rows.withColumn("target", F.col("return_1") * 2)
    model, scored = learning.pooled_model(rows, serving.FEATURES)
    errors = learning.pooled_errors(scored).first()
    assert errors.n == scored.count() > 0 and errors.rmse < scored.agg(F.stddev("target")).first()[0]
    assert learning.evaluator().evaluate(scored) == pytest.approx(errors.rmse)
    registry, root = str(tmp_path / "registry"), str(tmp_path / "models")
    learning.register(spark, registry, root, "m1", model, "2024-02-01", errors.rmse)
    with pytest.raises(ValueError):
        learning.load(spark, registry, "m1")
    learning.approve(spark, registry, "m1")
    damaged = next(Path(root).glob("m1/stages/*/data/*.parquet"), None) or next(Path(root).glob("m1/metadata/part-*"))
    kept = damaged.read_bytes()
    damaged.with_name(f".{damaged.name}.crc").unlink(missing_ok=True)
    damaged.write_bytes(kept + b"x")
    with pytest.raises(ValueError, match="changed"):
        learning.load(spark, registry, "m1")
    damaged.write_bytes(kept)
    again = learning.load(spark, registry, "m1").transform(scored.drop("raw", "x", "prediction"))
    assert again.agg(F.sum("prediction")).first()[0] == pytest.approx(scored.agg(F.sum("prediction")).first()[0])
    with pytest.raises(ValueError):
        learning.approve(spark, registry, "m1")


def test_random_arms_and_views(spark):
    got = X.random_arms(spark, [1, 2], list("abcdef"), 2, [7, 8]).collect()
    assert len(got) == 8 and got == X.random_arms(spark, [1, 2], list("abcdef"), 2, [7, 8]).collect()
    assert all(len({r.asset for r in got if (r.arm, r.t) == k}) == 2 for k in {(r.arm, r.t) for r in got})
    t = spark.range(2).select(F.col("id").alias("t"))
    static = V.static_views(t, [("v", {"A": 1.0}, 0.05, 0.6)])
    assert V.dispatched("static", {"static": static}) is static and V.dispatched("ml", {}) is None and V.dispatched("combined", {}) is None
    with pytest.raises(ValueError):
        V.dispatched("other", {})
    assert [round(r.confidence, 3) for r in V.dispatched("combined", {"static": static}, {"static": 0.5}).collect()] == [0.3, 0.3]


def test_costs_refuse_ruin(spark):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("X", day, 0.1)], "strategy string, d date, g double")
    traded = spark.createDataFrame([("X", day, 2.0)], "strategy string, d date, notional double")
    assert [round(r.net, 6) for r in N.costs(daily, traded, 0, 100).orderBy("bps").collect()] == [0.1, 0.078]
    with pytest.raises(Exception, match="costs exceed"):
        N.costs(daily, traded, 6000).collect()


def test_job_deadlines(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    log = [(1, "claim", at(0)), (1, "tick", at(3000)), (1, "done", at(3700)), (2, "claim", at(0)), (2, "done", at(60)), (2, "claim", at(9000)), (3, "tick", at(5000))]
    rows = spark.createDataFrame(log, "job_id long, event string, ts timestamp")
    base = int(at(0).timestamp())
    got = {r.job_id: r.status for r in jobs.job_states_batch(rows).collect()}
    assert got == {1: "FAILED", 2: "SUCCEEDED", 3: "QUEUED"}  # events do not move a deadline, and nothing revives a finished job
    assert {r.job_id: r.status for r in jobs.job_states_batch(rows, base + 9000).collect()} == {1: "FAILED", 2: "SUCCEEDED", 3: "FAILED"}


def test_stream_follows_the_log(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    log = [(j, e, start + dt.timedelta(seconds=s)) for j, e, s in [(1, "claim", 0), (2, "claim", 10), (2, "done", 60), (3, "claim", 20), (3, "fail", 30), (1, "tick", 1800), (4, "tick", 7200), (2, "claim", 7300), (4, "claim", 7400), (5, "tick", 9000), (5, "tick", 9100)]]
    schema = "job_id long, event string, ts timestamp"
    for k in range(0, len(log), 4):
        spark.createDataFrame(log[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(df, batch):
        jobs.write_once(df, batch, str(tmp_path / "out"))
        jobs.write_once(df, batch, str(tmp_path / "out"))  # as after a failure
        seen.update({r.job_id: r.status for r in df.collect()})

    jobs.idempotent_sink(jobs.job_states(jobs.file_stream(spark, schema, str(tmp_path / "in"), 1)), keep, str(tmp_path / "check")).awaitTermination(120)
    want = {r.job_id: r.status for r in jobs.job_states_batch(spark.createDataFrame(log, schema), int(start.timestamp()) + 9100 - 600).collect()}
    assert seen == want and json.dumps(want)
    assert want[1] == "FAILED" and want[2] == "SUCCEEDED"


def test_dead_letters(spark):
    rows = spark.createDataFrame([("a", '{"k": 1}'), ("a", "{broken"), ("z", '{"k": 1}'), ("a", None)], "type string, payload string")
    good, dead = jobs.validated(rows, "k int", ["a"])
    assert [r.body.k for r in good.collect()] == [1] and dead.count() == 3


def test_a_pack_has_two_to_twenty_symbols(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "symbol string, d int")
    assert M.price_pack(rows, ["A", "B"]).count() == 2
    for wrong in (["A"], [], ["A", "A"], ["A", " "], [f"S{i}" for i in range(21)]):
        with pytest.raises(ValueError):
            M.price_pack(rows, wrong)
