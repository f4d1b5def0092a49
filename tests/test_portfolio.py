"""Hand-made cases: drifting holdings, next-close execution, costs, optimiser golden cases, pruning."""

import datetime as dt
import math
import time
from itertools import combinations

import numpy as np
import pytest

from quantloom.operators import optimize as O
from quantloom.operators import portfolio as N
from quantloom.operators import selection, stats


def prices(spark, **columns):
    first = dt.date(2024, 1, 1)
    rows = [(a, first + dt.timedelta(days=i), float(p), i + 1) for a, ps in columns.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "asset string, d date, px double, rn long")


def weights(spark, *rows):
    return spark.createDataFrame(list(rows), "strategy string, rn long, asset string, w double")


def test_next_close_and_drift(spark):
    nav = N.nav_drifting(prices(spark, A=[1, 2, 4, 8], B=[1, 1, 1, 1]), weights(spark, ("X", 1, "A", 0.5), ("X", 1, "B", 0.5)))
    assert [(r.rn, r.nav) for r in nav.orderBy("rn").collect()] == [(3, pytest.approx(1.5)), (4, pytest.approx(2.5))]


def test_trade_at_the_last_close_earns_nothing(spark):
    nav = N.nav_drifting(prices(spark, A=[1, 1, 2]), weights(spark, ("X", 2, "A", 1.0)))
    assert [(r.rn, r.nav) for r in nav.collect()] == [(3, 1.0)]


def test_closed_form_is_the_recurrence(spark):
    rng = np.random.default_rng(3)
    path = np.exp(np.cumsum(rng.normal(0, 0.02, (40, 3)), axis=0))
    px = prices(spark, **{a: path[:, i] for i, a in enumerate("ABC")})
    picks = {r: rng.dirichlet([1, 1, 1, 1])[:3] for r in (5, 12, 13, 30)}
    got = {r.rn: r.nav for r in N.nav_drifting(px, weights(spark, *[("X", r, a, float(w)) for r, ws in picks.items() for a, w in zip("ABC", ws)])).collect()}
    value, shares, cash, want = 1.0, np.zeros(3), 1.0, {}
    for i in range(40):
        value = cash + shares @ path[i]
        want[i + 1] = value
        if i in picks:  # decided at row i (1-based), traded at the next close
            w = picks[i]
            shares, cash = value * w / path[i], value * (1 - w.sum())
    for rn, nav in got.items():
        assert nav == pytest.approx(want[rn], abs=1e-12)


def test_turnover_and_costs(spark):
    px, w = prices(spark, A=[1, 1, 2, 2, 2], B=[1, 1, 1, 1, 1]), weights(spark, ("X", 1, "A", 0.5), ("X", 1, "B", 0.5), ("X", 3, "A", 0.5), ("X", 3, "B", 0.5))
    rows = {r.e: r for r in N.turnover(px, w).collect()}
    assert rows[2].initial and rows[2].turnover == pytest.approx(1.0)
    assert not rows[4].initial and rows[4].turnover == pytest.approx(1 / 6)
    daily = spark.createDataFrame([("X", dt.date(2024, 1, 1), 0.1), ("X", dt.date(2024, 1, 2), 0.2)], "strategy string, d date, g double")
    traded = spark.createDataFrame([("X", dt.date(2024, 1, 1), 1.0), ("X", dt.date(2024, 1, 2), 2.0)], "strategy string, d date, notional double")
    assert [round(r.net, 9) for r in N.costs(daily, traded, 100.0).orderBy("d").collect()] == [0.089, 0.176]


GOLDEN = [
    (["EQUITY", "BOND"], [0.0014, 0.0002], np.diag([0.0004, 0.0001]), O.Policy(2, 0.9, ("BOND",), 0.1, 0.9), [0.8, 0.2]),
    (["GOLD", "EQUITY", "BOND"], [0.0001, 0.0015, 0.0004], np.diag([0.0001, 0.0004, 0.0001]), O.Policy(1, 0.55, ("BOND", "GOLD"), 0.55, 0.4), [0.05, 0.4, 0.55]),
]


@pytest.mark.parametrize("assets, mu, cov, policy, want", GOLDEN)
def test_mean_variance_golden(assets, mu, cov, policy, want):
    assert O.allocate("MVO", assets, mu, cov, policy) == pytest.approx(want, abs=1e-7)


def test_black_litterman_golden():
    cov, policy = np.diag([0.0004, 0.0001]), O.Policy(1, 0.9, ("BOND",), 0.1, 0.9)
    pi, mu = O.posterior(cov, np.array([0.5, 0.5]), np.array([[1.0, 0]]), np.array([0.001]), np.array([1.0]))
    assert pi == pytest.approx([0.0005, 0.000125], abs=1e-13) and mu == pytest.approx([0.00075, 0.000125], abs=1e-13)
    assert O.allocate("BL_ML", ["EQUITY", "BOND"], [0.0008, 0.0002], cov, policy, [0.5, 0.5], [[1, 0]], [0.001], [1.0]) == pytest.approx([0.825, 0.175], abs=1e-7)
    cov = np.array([[0.0004, 0.00006], [0.00006, 0.0001]])
    assert O.allocate("BL_ML", ["EQUITY", "BOND"], [0.0008, 0.0002], cov, policy, [0.6, 0.4], [[1, -1]], [0.0008], [0.5]) == pytest.approx([33 / 38, 5 / 38], abs=1e-7)
    assert O.posterior(np.diag([1e-4, 4e-4]), np.array([0.5, 0.5]), np.zeros((0, 2)), np.zeros(0), np.zeros(0))[1] == pytest.approx([0.000125, 0.0005])


def test_equal_weights_and_bad_input():
    policy = O.Policy(1, 0.4, ("BOND", "GOLD"), 0.6, 0.4)
    assert O.allocate("EW", ["EQUITY", "BOND", "GOLD"], [0.0008, 0.0002, 0.0001], np.diag([0.0004, 0.0001, 0.000225]), policy) == pytest.approx([1 / 3] * 3, abs=1e-15)
    with pytest.raises(ValueError):
        O.allocate("EW", ["EQUITY", "BOND"], [0, 0], np.eye(2), O.Policy(1, 0.4))
    with pytest.raises(ValueError):
        O.allocate("MVO", ["A", "A"], [0, 0], np.eye(2), O.Policy())


def test_prune_keeps_the_cap():
    none = np.zeros(3, bool)
    assert O.pruned(np.array([0.5, 0.495, 0.005]), none, O.Policy(cap=0.5)) == pytest.approx([0.5, 0.5, 0])
    stays = np.array([0.499, 0.499, 0.002])
    assert O.pruned(stays, none, O.Policy(cap=0.499)) is stays


def test_best_subset_is_the_first_of_equals():
    d = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    assert selection.best_subset(d, 2)[0] == (1, 4)
    assert selection.best_subset(np.zeros((4, 4)), 2)[:2] == ((0, 1), 0.0)


def test_best_subset_by_branch_and_bound_equals_enumeration():
    rng = np.random.default_rng(3)
    for n, k in ((6, 2), (9, 3), (12, 4), (10, 1), (8, 8), (13, 5)):
        for rep in range(6):
            x = rng.normal(size=(n, 40)) + (rng.normal(size=(1, 40)) if rep % 2 else 0)
            if rep % 3 == 0:
                x[1], x[-1] = x[0], x[2]
            d = np.round(np.clip(1 - np.corrcoef(x), 0, 2), 9 if rep % 2 else 1)
            np.fill_diagonal(d, 0)
            every = np.array(list(combinations(range(n), k)))
            cost = d[:, every].min(axis=2).sum(axis=0)
            want = int(np.round(cost, 11).argmin())
            got, total, _ = selection.best_subset(d, k)
            assert got == tuple(every[want].tolist()) and total == pytest.approx(cost[want], abs=1e-9)
            parts = [selection.best_subset(d, k, i) for i in range(n - k + 1)]
            assert min((round(c, 11), s) for s, c, _ in parts)[1] == got


def test_best_subset_of_thirty_is_pruned():
    x = np.random.default_rng(1).normal(size=(30, 300))
    d = np.clip(1 - np.corrcoef(x), 0, 2)
    start = time.perf_counter()
    assert selection.best_subset(d, 5)[2] < 142_506 // 5
    assert time.perf_counter() - start < 3


def test_metric_summary_by_hand(spark):
    nav = [1.0, 1.1, 1.045, 1.2]
    rows = spark.createDataFrame([("X", dt.date(2024, 1, i + 1), v) for i, v in enumerate(nav)], "strategy string, d date, nav double")
    got = stats.metric_summary(rows).first()
    r = np.diff(nav) / nav[:-1]
    x = r - (1.06 ** (1 / 252) - 1)
    assert got.sharpe == pytest.approx(math.sqrt(252) * x.mean() / r.std(ddof=1))
    assert got.sortino == pytest.approx(math.sqrt(252) * x.mean() / abs(x[x < 0]).item())
    assert got.max_drawdown == pytest.approx(1.045 / 1.1 - 1)
    flat = stats.metric_summary(rows.withColumn("nav", rows.nav * 0 + 1.0)).first()
    assert flat.sharpe is None and flat.calmar is None


def test_served_requests():
    assets, mu, cov, policy, want = GOLDEN[1]
    w, gap = O.serve("MVO", assets, mu, cov, policy)
    assert w == pytest.approx(want, abs=1e-7) and gap < 1e-6
    w, _ = O.serve("BL_ML", ["EQUITY", "BOND"], [0.0008, 0.0002], np.diag([0.0004, 0.0001]), O.Policy(1, 0.9, ("BOND",), 0.1, 0.9), [[1, 0]], [0.001], [1.0])
    assert w == pytest.approx([0.825, 0.175], abs=1e-7)
    eye = np.eye(2)
    for code, args, more in (
        ("INVALID_SHAPE", (["A", "A"], [0, 0], eye), {}), ("INVALID_SHAPE", (["A", "B"], [0], eye), {}), ("NOT_FINITE", (["A", "B"], [0, np.nan], eye), {}),
        ("NOT_SYMMETRIC", (["A", "B"], [0, 0], np.array([[1, 0.5], [0, 1]])), {}), ("NOT_PSD", (["A", "B"], [0, 0], np.array([[1, 2], [2, 1]])), {}),
        ("INVALID_VIEWS", (["A", "B"], [0, 0], eye), {"p": [[1]], "q": [0], "conf": [1]}), ("INVALID_VIEWS", (["A", "B"], [0, 0], eye), {"p": [[0, 0]], "q": [0], "conf": [1]}),
        ("INVALID_CONFIDENCE", (["A", "B"], [0, 0], eye), {"p": [[1, 0]], "q": [0], "conf": [-0.1]}),
        ("INVALID_CONFIDENCE", (["A", "B"], [0, 0], eye), {"p": [[1, 0]], "q": [0], "conf": [1.1]}),
        ("MISSING_VIEWS", (["A", "B"], [0, 0], eye), {}),
        ("MISSING_VIEWS", (["A", "B"], [0, 0], eye), {"p": [], "q": [], "conf": []}),
        ("INVALID_VIEWS", (["A", "B"], [0, 0], eye), {"p": [[0, 0]], "q": [0], "conf": [1]}),
        ("INVALID_VIEWS", (["A", "B"], [0, 0], eye), {"p": [[1, 0]], "q": [0, 1], "conf": [1]}),
    ):
        with pytest.raises(O.AllocationError) as e:
            O.serve("BL_ML", *args, O.Policy(1, 0.9), **more)
        assert e.value.code == code
    with pytest.raises(O.AllocationError) as e:
        O.serve("MVO", ["A", "B"], [0, 0], eye, O.Policy(1, 0.4))
    assert e.value.code == "INFEASIBLE"


def test_a_confidence_of_zero_leaves_the_prior():
    cov = np.array([[4e-4, 6e-5], [6e-5, 1e-4]])
    none = O.serve("BL_ML", ["A", "B"], [0, 0], cov, O.Policy(1, 0.9), [[1, -1]], [0.5], [0])[0]
    pi, mu = O.posterior(cov, np.full(2, 0.5), np.array([[1.0, -1.0]]), np.array([0.0005]), np.array([0.0]))
    assert none.sum() == pytest.approx(1) and mu == pytest.approx(pi, rel=1e-4)


def test_posterior_covariance_is_the_inverse_of_summed_precisions():
    cov = np.array([[4e-4, 6e-5], [6e-5, 1e-4]])
    p, conf = np.array([[1.0, -1.0], [0.0, 1.0]]), np.array([0.7, 0.3])
    omega = np.diag(np.diag(p @ (0.05 * cov) @ p.T) / conf)
    want = np.linalg.inv(np.linalg.inv(0.05 * cov) + p.T @ np.linalg.inv(omega) @ p)
    assert O.posterior_covariance(cov, p, conf) == pytest.approx(want, rel=1e-9)


def test_a_singular_covariance_is_adjusted_and_reported():
    report = O.adjustment(np.full((2, 2), 0.01))
    assert report["applied"] and report["largest_change"] == pytest.approx(1e-8) and not O.adjustment(np.eye(2))["applied"]


def test_requests_with_views(spark):
    """Each request takes its own views, the one without is refused, and weights equal a plain solve."""
    cov = {1: [[4e-4, 6e-5], [6e-5, 1e-4]], 2: [[2e-4, 1e-5], [1e-5, 3e-4]], 3: [[1e-4, 1e-4], [1e-4, 1e-4]]}
    moments = [(rn, "AB"[i], "AB"[j], 0.001, c[i][j]) for rn, c in cov.items() for i in range(2) for j in range(2)]
    seen = {1: ([[1.0, -1.0]], [0.0008], [0.7]), 3: ([[0.0, 1.0], [1.0, 0.0]], [0.0002, 0.0001], [0.3, 0.0])}
    views = spark.createDataFrame([(rn, ["A", "B"], *v) for rn, v in seen.items()], "t long, assets array<string>, p array<array<double>>, q array<double>, conf array<double>")
    policy = O.Policy(1.5, 0.9)
    out = {r.rn: r for r in O.served(spark.createDataFrame(moments, "rn long, a string, b string, mean double, cov double"), policy, "BL_ML", views).collect()}
    assert (out[2].status, out[2].error, out[2].weights) == ("failed", "MISSING_VIEWS", None)
    for rn, (p, q, conf) in seen.items():
        want = O.allocate("BL_ML", ["A", "B"], [0.001] * 2, cov[rn], policy, p=p, q=q, conf=conf)
        assert out[rn].status == "optimal" and out[rn].weights == pytest.approx(list(want), abs=1e-7)
    assert out[3].adjusted and not out[1].adjusted


def test_repair_keeps_to_the_support():
    policy = O.Policy(1, 0.6, ("B",), 0.2, 0.8)
    safe, v = np.array([False, True, False, False]), np.array([0.5, 0.0, 0.3, 0.2])
    w = O.repaired(v, safe, policy, np.array([True, True, False, True]))
    assert w[2] == 0 and w.sum() == pytest.approx(1) and w[1] >= 0.2 - 1e-9 and w.max() <= 0.6 + 1e-9
    assert O.repaired(v, safe, policy) == pytest.approx(O.projected(v, safe, policy))
    for support in ([False] * 4, [True, False, False, True]):  # nothing; no defensive asset for the floor
        with pytest.raises(ValueError):
            O.repaired(v, safe, policy, np.array(support))


def test_signs_of_zero(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (-1.0, -2.0), (1.0, None)], "f double, y double")
    assert [r.status for r in stats.graded(rows, "f", "y").collect()] == ["HIT", "MISS", "HIT", "PENDING"]
