"""Queries without an SQL equivalent against plain loops over the same small tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quantloom import queries as Q
from quantloom import queries_paths as P
from quantloom.operators import indicators as I
from quantloom.operators import ml, optimize, selection
from quantloom.operators import portfolio as N
from quantloom.operators.learners import BoostedTrees
from quantloom.plans import derived as D

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def returns(spark):
    return D.panel_returns(spark, SF).toPandas().pivot(index="rn", columns="asset", values="r").sort_index()


def plain_weights(returns, rn, assets, policy, views=None):
    window = returns.loc[rn - 18 : rn + 1, assets]
    p, q, conf = views or (None, None, None)
    none = np.zeros((0, len(assets)))
    w = optimize.allocate("BL_ML" if views else "MVO", assets, window.mean().to_numpy(), window.cov().to_numpy(), policy, p=none if p is None or not len(p) else p, q=[] if q is None else q, conf=[] if conf is None else conf)
    return optimize.pruned(w, np.isin(assets, policy.defensive), policy)


def by_decision(rows):
    return {k: g.set_index("asset")["w"] for k, g in rows.groupby(["strategy", "rn"])}


@pytest.fixture(scope="module")
def matrices(spark):
    return {r.t: r for r in P._view_matrices(spark, SF).collect()}


@pytest.fixture(scope="module")
def mvo(spark):
    return by_decision(Q.queries()["mean_variance_weights"](spark, SF).toPandas())


@pytest.fixture(scope="module")
def bl(spark):
    return by_decision(Q.queries()["black_litterman_weights"](spark, SF).toPandas())


def test_mean_variance_weights(returns, mvo):
    assets, last = list(returns.columns), int(returns.index.max())
    assert sorted(rn for _, rn in mvo) == [t for t in range(20, last, 5) if t + 1 <= last]
    for (_, rn), w in list(mvo.items())[::6]:
        assert w.loc[assets].to_numpy() == pytest.approx(plain_weights(returns, rn, assets, Q.POLICY), abs=1e-5)


def test_black_litterman_weights(returns, mvo, bl, matrices):
    assets = list(returns.columns)
    assert {rn for _, rn in bl} == {rn for _, rn in mvo}
    for (_, rn), w in list(bl.items())[::9]:
        v = matrices.get(rn)
        views = (np.array(v.p), np.array(v.q), np.array(v.conf)) if v else (np.zeros((0, len(assets))), [], [])
        assert not v or v.assets == assets
        assert w.loc[assets].to_numpy() == pytest.approx(plain_weights(returns, rn, assets, Q.POLICY, views), abs=1e-5)


def test_next_period_weights_are_the_last_ones(spark, mvo, bl):
    got = by_decision(Q.queries()["next_period_weights"](spark, SF).toPandas())
    last = max(rn for _, rn in mvo)
    assert set(got) == {("MVO", last), ("BL_ML", last)}
    for key, w in got.items():
        want = {**mvo, **bl}[key]
        assert w.to_numpy() == pytest.approx(want.loc[w.index].to_numpy(), abs=1e-6)


def test_active_subset_weights(spark, returns):
    rows = by_decision(Q.queries()["active_subset_weights"](spark, SF).toPandas())
    active = P.X.active_assets(P._in_force(spark, SF), list(returns.columns), ["Brand#11", "Brand#12"]).toPandas().groupby("rn")["asset"].apply(sorted)
    crisis = {r.rn for r in P._regimes(spark, SF).filter("regime = 'crisis'").collect()}
    due = [k for k in rows if k[0] == "MVO_ACTIVE" and k[1] >= 25]
    assert due and {len(w) for w in rows.values()} == {returns.shape[1]}
    for key in due[::7]:
        some, w = active[key[1]], rows[key]
        policy = optimize.replace(Q.POLICY, risk_aversion=5.0) if key[1] in crisis else Q.POLICY
        assert w.loc[some].to_numpy() == pytest.approx(plain_weights(returns, key[1], some, policy), abs=1e-5)
        assert (w.drop(some) == 0).all()


def test_representatives_use_only_what_was_known(spark, returns):
    got = Q._representatives(spark, SF).toPandas().groupby("t")["asset"].apply(sorted)
    for t in list(got.index)[::5]:
        corr = returns.loc[: t - 1].dropna().corr().fillna(0).to_numpy()
        d = np.round(np.clip(1 - corr, 0, 2), 9)
        np.fill_diagonal(d, 0)
        assert got[t] == [returns.columns[i] for i in selection.best_subset(d, 5)[0]]


def test_paired_bootstrap(spark):
    row = Q.queries()["paired_bootstrap"](spark, SF).first()
    rows, weights = Q._iv_weights(spark, SF)
    ew = N.equal_weights(N.rebalance_rows(rows, 25), rows.select("asset").distinct())
    r = N.nav_constant(rows, weights.unionByName(ew)).toPandas().pivot(index="rn", columns="strategy", values="r").sort_index()[["IV", "EW"]].to_numpy()
    out = []
    for rep in range(1000):
        starts = np.random.default_rng([20261014, rep]).integers(0, len(r) - 9, -(-len(r) // 10))
        s = np.concatenate([r[a : a + 10] for a in starts])[: len(r)]
        sharpe = np.sqrt(252) * s.mean(axis=0) / s.std(axis=0, ddof=1)
        out.append(sharpe[0] - sharpe[1])
    assert row.reps == 1000 and row["mean"] == pytest.approx(np.mean(out), abs=1e-9)
    assert row.interval == pytest.approx(np.quantile(out, [0.025, 0.975]), abs=1e-9)


def test_single_and_ensemble_forecasts(spark):
    rows = ml.labelled(I.ml_features(D.panel(spark, SF))).toPandas()
    single = Q.queries()["single_forecasts"](spark, SF).toPandas().set_index("asset")
    assert set(single.index) == set(rows["asset"])
    some = rows[rows["asset"] == "Brand#13"].sort_values("rn")
    x, y = some[ml.ML_FEATURES].to_numpy(float), some["y"].to_numpy(float)
    want = BoostedTrees(200, seed=42).fit(x[:-1], y[:-1]).predict(x[-1:])[0]
    assert single.loc["Brand#13", "pred"] == pytest.approx(want) and single.loc["Brand#13", "n_train"] == len(some) - 1

    got = Q.queries()["ensemble_forecasts"](spark, SF).toPandas().set_index("asset")
    feats = I.ml_features(D.panel(spark, SF)).filter("asset = 'Brand#13'").toPandas().sort_values("rn")
    n = int(len(some) * 0.8)
    valid = some.iloc[n:]
    train = some.iloc[:n]
    train = train[train["label_rn"] < valid["rn"].iloc[0]]
    mean, sd = train[ml.ML_FEATURES].mean().to_numpy(), train[ml.ML_FEATURES].std(ddof=0).to_numpy()
    scale = lambda d: (d[ml.ML_FEATURES].to_numpy(float) - mean) / np.where(sd == 0, 1, sd)
    each = [
        BoostedTrees(200, rows=0.8, columns=min(1.0, 0.7 + 0.05 * i), patience=10, seed=42 + i).fit(scale(train), train["y"].to_numpy(), (scale(valid), valid["y"].to_numpy())).predict(scale(feats.tail(1)))[0]
        for i in range(5)
    ]
    assert got.loc["Brand#13", "pred"] == pytest.approx(np.mean(each), abs=1e-9) and got.loc["Brand#13", "std"] == pytest.approx(np.std(each), abs=1e-9)
    assert got["confidence"].between(0.25, 0.70).all()


def test_served_requests(spark, returns):
    rows = Q.queries()["served_allocations"](spark, SF).toPandas()
    assert set(rows["status"]) == {"optimal"} and rows["error"].isna().all()
    for r in rows.itertuples():
        w = np.array(r.weights)
        safe = np.isin(r.assets, Q.POLICY.defensive)
        assert w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= Q.POLICY.cap + 1e-7
        assert w[safe].sum() >= Q.POLICY.floor - 1e-7 and w[~safe].sum() <= Q.POLICY.other_cap + 1e-7


def test_served_model(spark, returns):
    errors = Q.queries()["serving_model_errors"](spark, SF).first()
    views = Q.queries()["serving_predictions"](spark, SF).toPandas()
    assert errors.n > 0 and 0 < errors.mae <= errors.rmse
    assert sorted(views["asset"]) == sorted(returns.columns) and views["q_daily"].abs().max() < 0.2
    assert all(legs == {a: 1.0} for a, legs in zip(views["asset"], views["legs"]))


def test_ranker_scores_come_from_earlier_labels(spark):
    rows = Q.queries()["ranker_scores"](spark, SF).toPandas()
    assert (rows.groupby("t")["asset"].nunique() >= 2).all() and np.isfinite(rows[["score", "std"]].to_numpy()).all()
    assert (rows["t"] % 60 == 0).all() and rows["t"].min() >= 180
    assert isinstance(rows, pd.DataFrame)
