"""The thirteen tables of a whole walk-forward, written and read again, against plain loops."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quantloom import queries_paths as P
from quantloom.operators import runs
from quantloom.sources import market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    if not Path(SF).exists():
        pytest.skip("needs the driver's tables")
    root = f"file://{tmp_path_factory.mktemp('run')}"
    tables = P._run_tables(spark, SF)
    market.write_run(tables, root)
    return {name: spark.read.option("header", True).csv(f"{root}/{name}", schema=df.schema) for name, df in tables.items()}


@pytest.fixture(scope="module")
def prices(spark):
    return P.D.panel(spark, SF).toPandas()


def test_all_tables_are_there(run):
    names = "nav returns metrics weights turnover turnover_summary ledger selection training windows predictions constraints violations"
    assert sorted(run) == sorted(names.split())
    assert all(run[n].count() for n in run if n != "violations") and run["violations"].count() == 0


def test_values_follow_from_weights_and_prices(run, prices):
    px, days = prices.pivot(index="rn", columns="asset", values="px"), prices.drop_duplicates("rn").set_index("rn")["d"]
    weights, nav = run["weights"].toPandas(), run["nav"].toPandas()
    anchor, last = pd.Timestamp("1998-06-29").date(), int(px.index.max())
    assert sorted(weights["strategy"].unique()) == ["BL_ML", "EW", "HYBRID", "MVO"]
    assert weights.groupby(["strategy", "rn"])["w"].sum().to_numpy() == pytest.approx(1, abs=1e-8)
    for strategy, mine in weights.groupby("strategy"):
        decided = {rn + 1: g.set_index("asset")["w"] for rn, g in mine.groupby("rn") if rn + 1 <= last}
        starts, value, path = sorted(decided), 1.0, {}
        for e, n in zip(starts, [*starts[1:], last]):
            w = decided[e]
            for rn in range(e, n + 1):
                now = value * (1 - w.sum() + (w * px.loc[rn, w.index] / px.loc[e, w.index]).sum())
                if rn > e or n == e:
                    path[days[rn]] = now
            value = now
        for phase, part in (("IS", {d: v for d, v in path.items() if d <= anchor}), ("OOS", {d: v for d, v in path.items() if d >= anchor})):
            got = nav[(nav["strategy"] == strategy) & (nav["phase"] == phase)].set_index("d")["nav"].to_dict()
            first = part[min(part)]
            assert got.keys() == part.keys() and got[min(got)] == 1
            assert all(got[d] == pytest.approx(v / first, rel=1e-9) for d, v in part.items())


def test_metrics_and_turnover(run):
    nav, trades = run["nav"].toPandas(), run["turnover_summary"].toPandas()
    for m in run["metrics"].toPandas().itertuples():
        path = nav[(nav["phase"] == m.phase) & (nav["strategy"] == m.strategy)].sort_values("d")
        v = path["nav"].to_numpy()
        r = v[1:] / v[:-1] - 1
        assert (m.start, m.end, m.n) == (path["d"].min(), path["d"].max(), len(r))
        assert m.ann_vol == pytest.approx(r.std(ddof=1) * np.sqrt(252)) and m.max_drawdown == pytest.approx((v / np.maximum.accumulate(v) - 1).min())
        spent = trades[(trades["strategy"] == m.strategy) & ~trades["initial"] & (trades["d"] > m.start) & (trades["d"] <= m.end)]["turnover"].sum()
        assert m.total_turnover == pytest.approx(spent, abs=1e-9) and m.annual_turnover == pytest.approx(spent * 252 / len(r), abs=1e-9)


def test_nothing_looks_ahead(run):
    assert {r.check: r.n for r in runs.verdict(run).collect()} == {"nav": 0, "violations": 0, "windows": 0, "ledger": 0}
    ledger = run["ledger"].toPandas()
    assert (ledger["decision"] < ledger["execution"]).all()
    windows, predictions = run["windows"].toPandas(), run["predictions"].toPandas()
    assert (windows["last_label"] <= windows["u"] - 6).all() and (windows["last_label_day"] < windows["retrained"]).all()
    assert predictions["t"].min() >= windows["u"].min()
    selection = run["selection"].toPandas().dropna(subset=["selected_at"])
    assert (selection["selected_at"] <= selection["rn"]).all()


def test_faults_are_found(spark):
    """A late label, a trade on the day of its decision, a value of 0 and a broken limit each count."""
    days = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}") for i in range(10)], "rn long, d string").selectExpr("rn", "cast(d as date) d")
    fits = spark.createDataFrame([(5, "A", 5, 2, 3), (5, "B", 3, 3, 3), (5, "C", 3, 2, 3), (5, "D", 3, None, None)], "u long, asset string, last_label long, last_fitted long, validation_from long")
    assert {r.asset: r.passed for r in runs.fit_windows(fits, days).collect()} == {"A": False, "B": False, "C": True, "D": True}
    weights = spark.createDataFrame([("X", 1, "A", 0.7), ("X", 1, "B", 0.3), ("Y", 1, "A", 0.4), ("Y", 1, "B", 0.6)], "strategy string, rn long, asset string, w double")
    out = runs.constraints(weights, ["B"], ["Y"], 0.65, 0.7, 0.3).collect()
    got = {r.strategy: (round(r.cap, 9), round(r.group_cap, 9), round(r.floor, 9)) for r in out}
    assert got == {"X": (0.05, 0, 0), "Y": (0, 0.1, 0.1)}
    assert [r.n for r in runs.executions(weights, days.filter("rn < 2")).groupBy().count().withColumnRenamed("count", "n").collect()] == [0]
    nav = spark.createDataFrame([(1.0,), (0.0,), (None,)], "nav double")
    empty = {"violations": weights.limit(0), "windows": fits.selectExpr("true as passed"), "ledger": fits.selectExpr("u > 5 as in_time")}
    assert {r.check: r.n for r in runs.verdict({"nav": nav, **empty}).collect()} == {"nav": 2, "violations": 0, "windows": 0, "ledger": 4}
