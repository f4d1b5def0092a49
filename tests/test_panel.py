"""Panels, indicators, learners, store and streams on small inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalar as S
from quantloom.operators import indicators as I
from quantloom.operators import learners, ml, store
from quantloom.operators import panel as P
from quantloom.sources import files
from quantloom.streaming import jobs

D = dt.date


def panel_of(spark, px, asset="A"):
    return spark.createDataFrame([(asset, D(2020, 1, 1) + dt.timedelta(days=i), float(p), i + 1) for i, p in enumerate(px)], "asset string, d date, px double, rn long")


def test_union_calendar_carries_weekend_values(spark):
    fund = spark.createDataFrame([("F", D(2020, 1, 3), 100.0), ("F", D(2020, 1, 4), 110.0), ("F", D(2020, 1, 7), 120.0)], "asset string, d date, px double")
    calendar = spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 6),), (D(2020, 1, 7),)], "d date")
    both = {m: {r.d: r.px for r in P.price_panel(fund, calendar, m).collect()} for m in ("audited", "legacy")}
    assert both["audited"][D(2020, 1, 6)] == 110 and both["legacy"][D(2020, 1, 6)] == 100


def test_asof_keeps_the_newer_observation(spark):
    t = lambda d, h=0: dt.datetime(2020, 1, d, h)
    facts = spark.createDataFrame([("A", t(1), t(1, 18), 1.0), ("A", t(2), t(2, 18), 2.0), ("A", t(1, 5), t(3), 9.0)], "asset string, observed_at timestamp, available_at timestamp, px double")
    moments = spark.createDataFrame([("A", t(1, 17)), ("A", t(1, 18)), ("A", t(3, 12))], "asset string, decision_at timestamp")
    assert [r.px for r in P.asof(facts, moments).orderBy("decision_at").collect()] == [None, 1.0, 2.0]


def test_merge_takes_last_known(spark):
    old = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, None)], "d int, a double, b double")
    new = spark.createDataFrame([(2, None, 5.0), (3, 7.0, None)], "d int, a double, b double")
    assert [(r.d, r.a, r.b) for r in P.merged(old, new, "d", ["a", "b"]).orderBy("d").collect()] == [(1, 1.0, 1.0), (2, 2.0, 5.0), (3, 7.0, 5.0)]


def test_indicators_against_pandas(spark):
    rng = np.random.default_rng(0)
    px = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80))))
    panel = panel_of(spark, px)
    got = I.recursive_averages(panel).withColumn("vol", I.volatility(20, "px")).orderBy("rn").toPandas()
    assert np.allclose(got["ema_10"], px.ewm(span=10, adjust=False).mean())
    assert np.allclose(got["vol"], px.rolling(20).std(), equal_nan=True)
    rsi = I.rsi(panel).orderBy("rn").toPandas()["rsi"]
    step = px.diff().fillna(0)
    gain, loss = step.clip(lower=0).rolling(14).mean(), (-step).clip(lower=0).rolling(14).mean()
    assert np.allclose(rsi, 100 - 100 / (1 + gain / loss), equal_nan=True)
    assert rsi.first_valid_index() == 13


def test_rsi_without_loss(spark):
    rising = panel_of(spark, range(1, 30))
    assert I.rsi(rising).filter("rsi is not null").count() == 0
    assert {r.rsi for r in I.rsi(rising, full=False).collect()} == {50.0}


def test_features_do_not_see_the_future(spark):
    px = 80 + 0.12 * np.arange(120) + 6 * np.sin(np.arange(120) / 6.3)
    changed = px.copy()
    changed[100:] *= 3
    a, b = (I.ml_features(panel_of(spark, p)).filter("rn <= 100").orderBy("rn").toPandas() for p in (px, changed))
    pd.testing.assert_frame_equal(a, b)


def test_purge_counts(spark):
    i = np.arange(220)
    rows = ml.labelled(I.ml_features(panel_of(spark, 80 + 0.12 * i + 6 * np.sin(i / 6.3) + 2 * np.cos(i / 3.7))))
    counts = {r.fold: r["count"] for r in ml.temporal_split(rows).groupBy("fold").count().collect()}
    assert counts == {"train": 143, "purged": 5, "validation": 38}


def test_trees_learn_a_step():
    x = np.random.default_rng(1).normal(size=(400, 3))
    y = (x[:, 1] > 0.3) * 2.0
    m = learners.BoostedTrees(rounds=100, depth=2, rate=0.2).fit(x, y)
    assert np.abs(m.predict(x) - y).mean() < 0.15


def test_revisions_count_a_return_to_an_old_value(spark):
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 1.0, 2.0, 1.0])], "asset string, t int, px double")
    assert [r.revision for r in store.revisions(rows, ["asset"], ["px"], ["t"]).orderBy("t").collect()] == [1, 2, 3]


def test_gold_quotes(spark):
    raw = spark.createDataFrame([(D(2020, 1, 1), '[{"name":"HN","gold_type":[{"name":"PNJ","buy":"9.999","sell":"9.999"}]},{"name":"TPHCM","gold_type":[{"name":"Nhẫn PNJ 24K","buy":"5.100","sell":"x"},{"name":"PNJ","buy":"5.000","sell":null},{"name":"SJC","buy":"6.000.000","sell":"6.100.000"}]}]')], "d date, json string")
    r = files.gold_quotes(raw).first()
    assert (r.pnj_buy, r.pnj_sell, r.sjc_buy, r.sjc_sell) == (5000, None, 6000000, 6100000)


def test_series_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿date,price,symbol\n2020-01-02,1.0,A\nbad,2.0,A\n2020-01-02,3.0,A\n03/01/2020,4.0,A\n2020-01-05,,A\n", encoding="utf-8")
    out = files.read_series(spark, [str(tmp_path / "a.csv")], "A", "date string, price double, symbol string", price_col="price")
    assert [(r.d, r.px) for r in out.orderBy("d").collect()] == [(D(2020, 1, 2), 3.0), (D(2020, 1, 3), 4.0)]


def test_config_errors():
    config = {"assets": {"A": {"full_path": "x", "date_col": "d", "price_col": "p"}, "B": {}}, "default_selection": ["A"]}
    assert list(files.resolved(config)) == ["A"]
    for bad in (["C"], ["B"]):
        with pytest.raises(ValueError):
            files.resolved(config, bad)


def test_scalar_functions(spark):
    one = spark.range(1)
    row = one.select(S.div(F.lit(1.0), F.lit(0.0)).alias("z"), S.regime(F.lit(1.3), F.lit(0.0)).alias("r"), S.grouped_integer(F.lit("1.234.567")).alias("g"), S.clip(F.lit(None).cast("double"), 0, 1).alias("c"), S.normalised_price(F.lit(1.0000005), F.lit("thousand_vnd")).alias("p")).first()
    assert row.z is None and row.r == "stress" and row.g == 1234567 and row.c is None and str(row.p) == "1000.000500"


def test_job_state_rules():
    s = jobs.next_state(("QUEUED", 0, 0, 0, 100), "claim", 100)
    assert s == ("RUNNING", 1, 700, 0, 100)
    s = jobs.next_state(s, "fail", 200)
    assert s == ("QUEUED", 1, 0, 260, 100)
    assert jobs.next_state(s, "claim", 250) == s
    s = jobs.next_state(jobs.next_state(s, "claim", 260), "fail", 300)
    assert s[3] == 420
    assert jobs.next_state(jobs.next_state(s, "claim", 420), "fail", 430)[0] == "FAILED"
    assert jobs.next_state(("RUNNING", 1, 700, 0, 100), "claim", 800) == ("RUNNING", 2, 1400, 800, 100)
    assert jobs.next_state(("RUNNING", 2, 4000, 0, 100), "done", 3700) == ("FAILED", 2, 4000, 0, 100)  # an hour after it was made


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, e, dt.datetime(2024, 1, 1, 0, i)) for i, e in enumerate(["claim", "fail", "tick", "claim", "done", "claim", "tick"] * 5)]
    events = spark.createDataFrame(rows, "job_id long, event string, ts timestamp").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, events.schema, str(tmp_path / "in"))
    seen = {}
    q = jobs.idempotent_sink(jobs.job_states(stream), lambda df, n: seen.update({r.job_id: r.status for r in df.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.job_id: r.status for r in jobs.job_states_batch(events).collect()} == {k: v for k, v in seen.items()}


def test_asof_of_one_asset_over_many_spans(spark):
    """Values are carried over spans without facts; equal to a plain search."""
    rng = np.random.default_rng(7)
    base = dt.datetime(2024, 1, 1)
    when = lambda n, k: [base + dt.timedelta(hours=int(h)) for h in rng.integers(0, k, n)]
    facts = [("A" if i % 9 else "B", o, o + dt.timedelta(hours=int(rng.integers(0, 900))), float(i)) for i, o in enumerate(when(300, 9000))] + [("A", base, None, 1.0), (None, base, base, 1.0)]
    moments = sorted({("A" if i % 4 else "B", m) for i, m in enumerate(when(200, 16000))}) + [("none", base)]
    out = P.asof(spark.createDataFrame(facts, "asset string, observed_at timestamp, available_at timestamp, px double"), spark.createDataFrame(moments, "asset string, decision_at timestamp"))
    got = {(r.asset, r.decision_at): r.px for r in out.collect()}
    want = {(a, m): max(((o, v, px) for b, o, v, px in facts if a == b and v and v <= m), default=(None,))[-1] for a, m in moments}
    assert got == want
    spread = P.best_so_far(spark.range(400).selectExpr("'A' as asset", "timestamp_seconds(id * 86400) as at", "id as v"), "v", "at", ["at"])
    assert [r.v for r in spread.orderBy("at").collect()] == list(range(400))
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 1
