"""Retraining schedule, training rows and scores of the walk-forward against a plain loop; the ranking loss."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import walkforward as W
from quantloom.operators.learners import BoostedTrees, Pairwise

FEATURES = ["a", "b"]
N, ASSETS = 200, list("PQRSTU")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for asset in ASSETS:
        px = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, N)))
        for i in range(N):
            far = i + 5 < N
            out.append((asset, i + 1, float(px[i]), px[i + 5] / px[i] - 1 if far else None, i + 6 if far else None, float(rng.normal()), float(rng.normal()) if i > 10 else None))
    return pd.DataFrame(out, columns=["asset", "rn", "px", "y", "label_rn", *FEATURES])


@pytest.fixture(scope="module")
def force():
    """Members change each 20 rows; none before row 40."""
    out = []
    for rn in range(25, N + 1, 5):
        t = rn // 20 * 20
        out.append((rn, None if t < 40 else sorted(ASSETS[(t // 20 + k) % 6] for k in range(3))))
    return out


def tables(spark, rows, force):
    none = lambda v, kind: None if pd.isna(v) else kind(v)
    clean = [(r.asset, r.rn, r.px, none(r.y, float), none(r.label_rn, int), none(r.a, float), none(r.b, float)) for r in rows.itertuples()]
    table = spark.createDataFrame(clean, "asset string, rn long, px double, y double, label_rn long, a double, b double").repartition(3)
    return table, spark.createDataFrame(force, "rn long, members array<string>")


def plain_turns(force, mode):
    first = W.FEATURE_ROWS[mode] + W.HORIZON + W.LEAST
    out = []
    for rn, members in force:
        if members and rn - 6 > first and (not out or rn - out[-1][0] >= 10):
            out.append((rn, members))
    return out


def test_ranking_scores_equal_a_plain_loop(spark, rows, force):
    table, forced = tables(spark, rows, force)
    turns = W.fit_turns(forced)
    want_turns = plain_turns(force, "ranking")
    assert sorted((r.u, sorted(r.members)) for r in turns.collect()) == want_turns and len(want_turns) > 2
    got = {(r.t, r.asset): (r.score, r.std) for r in W.ranking_scores(table, forced, turns, FEATURES, members=2, rounds=6).collect()}
    want = {}
    for t, members in force:
        past = [(u, m) for u, m in want_turns if u <= t]
        if not past:
            continue
        u, fitted = past[-1]
        train = rows[rows["asset"].isin(fitted) & (rows["label_rn"] <= u - 6)].dropna(subset=FEATURES).sort_values(["rn", "asset"])
        grade = train.sort_values(["rn", "y", "asset"]).groupby("rn").cumcount().reindex(train.index).to_numpy(float)
        ask = rows[rows["asset"].isin(members) & (rows["rn"] == t - 1)].sort_values("asset")
        assert (train["label_rn"] < u - 5).all()
        scores = [W.ranked(train[FEATURES].to_numpy(float), grade, train["rn"].to_numpy(), train["label_rn"].to_numpy().astype(int), ask[FEATURES].to_numpy(float), m, 6) for m in range(2)]
        for asset, mean, std in zip(ask["asset"], np.mean(scores, axis=0), np.std(scores, axis=0)):
            want[t, asset] = (mean, std)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_nothing_after_a_decision_changes_its_scores(spark, rows, force):
    table, forced = tables(spark, rows, force)
    turns = W.fit_turns(forced, "absolute")
    some = lambda t: {(r.t, r.asset): r.pred for r in W.absolute_forecasts(t, forced, turns, FEATURES, members=1, rounds=4).collect() if r.t <= 170}
    before = some(table)
    late = rows.copy()
    late.loc[late["rn"] >= 170, FEATURES] = 99.0
    late.loc[late["label_rn"] >= 170, "y"] = 9.0
    after = some(tables(spark, late, force)[0])
    assert before and before.keys() == after.keys()
    assert all(before[k] == after[k] for k in before)


def test_audits_name_the_last_labels(spark, rows, force):
    table, forced = tables(spark, rows, force)
    got = W.audits(table, W.fit_turns(forced, "absolute")).collect()
    assert len(got) == 3 * len(plain_turns(force, "absolute"))
    for r in got:
        assert r.last_label == r.u - 6 and r.last_fitted < r.validation_from
        assert r.n_purged == 5 and r.n_train + r.n_purged + r.n_validation == r.u - 11


def test_cold_starts_end_at_the_first_fit(spark, rows, force):
    table, forced = tables(spark, rows, force)
    got = W.cold_starts(table, forced, W.fit_turns(forced)).collect()
    px = rows.set_index(["asset", "rn"])["px"]
    first = plain_turns(force, "ranking")[0][0]
    assert {r.t for r in got} == {rn for rn, m in force if m and rn < first}
    assert all((r["first"], r["last"]) == (px[r.asset, r.t - 20], px[r.asset, r.t - 1]) for r in got)


def test_pairwise_loss_and_gradient(monkeypatch):
    rng = np.random.default_rng(2)
    group, grade, f = rng.integers(0, 9, 60), rng.integers(0, 4, 60).astype(float), rng.normal(size=60)
    want, total, n = np.zeros(60), 0.0, 0
    for g in range(9):
        at = np.flatnonzero(group == g)
        for i in at:
            for j in at:
                if grade[i] > grade[j]:
                    p = 1 / (1 + np.exp(f[i] - f[j]))
                    want[i] += p / max(1, len(at) - 1)
                    want[j] -= p / max(1, len(at) - 1)
                    total, n = total + np.log1p(np.exp(f[j] - f[i])), n + 1
    for cells in (1_000_000, 50):
        monkeypatch.setattr(Pairwise, "CELLS", cells)
        one = Pairwise(grade, group)
        assert one.gradient(f) == pytest.approx(want) and one.loss(f) == pytest.approx(total / n)


def test_trees_split_where_a_plain_search_does():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3))
    y = np.where(x[:, 1] > 0.2, 2.0, -1.0) + 0.01 * rng.normal(size=80)
    model = BoostedTrees(1, depth=1, rate=1.0).fit(x, y)
    column, cut, low, high = model.trees[0]
    assert column == 1 and low < 0 < high
    b = model._binned(x)[:, 1] <= cut
    assert (b == (x[:, 1] <= 0.2)).mean() > 0.95 and low + model.base == pytest.approx(y[b].mean())
