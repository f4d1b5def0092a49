"""Mean-variance and Black-Litterman allocation of a few dozen assets, one small numpy problem per decision,
spread over the cluster by grouped maps."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    risk_aversion: float = 1.5
    cap: float = 0.5
    defensive: tuple[str, ...] = ()
    floor: float = 0.0
    other_cap: float = 1.0


def regularised(cov: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Symmetric, without NaN, eigenvalues at least `least`."""
    s = np.nan_to_num(np.asarray(cov, float))
    s = (s + s.T) / 2
    values, vectors = np.linalg.eigh(s)
    return s if values[0] >= least else (vectors * np.maximum(values, least)) @ vectors.T


def adjustment(cov: np.ndarray, least: float = 1e-8) -> dict:
    """What `regularised` does to a covariance: whether it changes it, its smallest eigenvalue, and the largest change of
    an eigenvalue."""
    s = np.asarray(cov, float)
    low = float(np.linalg.eigvalsh((s + s.T) / 2)[0])
    return {"applied": low < least, "least_eigenvalue": low, "largest_change": max(0.0, least - low)}


def posterior_covariance(cov: np.ndarray, p: np.ndarray, conf: np.ndarray, tau: float = 0.05) -> np.ndarray:
    """Covariance of the posterior means: tau times the covariance, less what the views tell."""
    prior = tau * cov
    if not len(p):
        return prior
    cross = prior @ p.T
    inner = p @ cross
    omega = np.diag(np.maximum(np.diag(inner), 1e-10) / np.clip(conf, 1e-6, 1))
    return prior - cross @ np.linalg.solve(inner + omega, cross.T)


def posterior(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, conf: np.ndarray, tau: float = 0.05, delta: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Equilibrium returns and their update by views (rows of p, returns q, confidences)."""
    pi = delta * cov @ market
    if not len(p):
        return pi, pi
    spread = tau * cov @ p.T
    inner = p @ spread
    omega = np.diag(np.maximum(np.diag(inner), 1e-10) / np.clip(conf, 1e-6, 1))
    return pi, pi + spread @ np.linalg.solve(inner + omega, q - p @ pi)


def capped_simplex(v: np.ndarray, mass: float, cap: float) -> np.ndarray:
    """Nearest point with sum `mass` and entries in [0, cap]: the shift is found exactly among the places
    where an entry meets a bound."""
    edges = np.unique(np.concatenate([v, v - cap]))
    sums = np.clip(v[None, :] - edges[:, None], 0, cap).sum(axis=1)
    k = int(np.searchsorted(-sums, -mass, side="right"))
    if k == 0:
        shift = edges[0]
    elif k == len(edges):
        shift = edges[-1]
    else:
        a, b = edges[k - 1], edges[k]
        shift = a if sums[k - 1] == sums[k] else a + (sums[k - 1] - mass) * (b - a) / (sums[k - 1] - sums[k])
    return np.clip(v - shift, 0, cap)


def bounds(safe: np.ndarray, policy: Policy) -> tuple[float, float]:
    n, k = len(safe), int(safe.sum())
    low = max(policy.floor, 1 - policy.other_cap, 1 - (n - k) * policy.cap, 0.0)
    high = min(1.0, k * policy.cap)
    if n * policy.cap < 1 - 1e-12 or low > high + 1e-12:
        raise ValueError("infeasible")
    return low, high


def projected(v: np.ndarray, safe: np.ndarray, policy: Policy) -> np.ndarray:
    """Nearest feasible weights: if the defensive mass is outside its range, it is set to the near end and
    both groups are projected apart."""
    low, high = bounds(safe, policy)
    w = capped_simplex(v, 1.0, policy.cap)
    mass = w[safe].sum()
    if low - 1e-15 <= mass <= high + 1e-15 or not safe.any() or safe.all():
        return w
    goal = low if mass < low else high
    w = np.empty_like(v)
    w[safe], w[~safe] = capped_simplex(v[safe], goal, policy.cap), capped_simplex(v[~safe], 1 - goal, policy.cap)
    return w


def repaired(v: np.ndarray, safe: np.ndarray, policy: Policy, support: np.ndarray | None = None) -> np.ndarray:
    """Nearest feasible weights that are 0 outside the support (a mask); ValueError where the support admits none."""
    if support is None:
        return projected(v, safe, policy)
    out = np.zeros_like(v)
    if not support.any():
        raise ValueError("infeasible")
    out[support] = projected(v[support], safe[support], policy)
    return out


def mean_variance(mu: np.ndarray, cov: np.ndarray, assets: list[str], policy: Policy, rounds: int = 1000) -> np.ndarray:
    """Maximises mu'w - aversion w'cov w by projected gradients with momentum and restarts."""
    safe = np.isin(assets, policy.defensive)
    cov = regularised(cov)
    scale = max(float(np.abs(mu).max()), 2 * policy.risk_aversion * float(np.abs(cov).max()), 1e-12)
    hessian, linear = 2 * policy.risk_aversion * cov / scale, mu / scale
    step = 1 / max(float(np.linalg.eigvalsh(hessian)[-1]), 1e-9)
    w = y = projected(np.full(len(mu), 1 / len(mu)), safe, policy)
    t = 1.0
    for _ in range(rounds):
        new = projected(y - step * (hessian @ y - linear), safe, policy)
        if (y - new) @ (new - w) > 0:
            t, y = 1.0, w
            new = projected(y - step * (hessian @ y - linear), safe, policy)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t_new
        if moved < 1e-14:
            break
    return w


def pruned(w: np.ndarray, safe: np.ndarray, policy: Policy, least: float = 0.01) -> np.ndarray:
    """Small weights go if the rest can be made feasible without them; else nothing changes."""
    keep = w >= least
    if not keep.any() or keep.all():
        return w
    try:
        return repaired(w / w[keep].sum(), safe, policy, keep)
    except ValueError:
        return w


def allocate(strategy: str, assets: list[str], mu, cov, policy: Policy, market=None, p=None, q=None, conf=None) -> np.ndarray:
    """EW, MVO or BL_ML weights; ValueError for unusable input."""
    mu, cov = np.asarray(mu, float), np.asarray(cov, float)
    n = len(assets)
    if len(set(assets)) != n or mu.shape != (n,) or cov.shape != (n, n) or not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        raise ValueError("invalid input")
    safe = np.isin(assets, policy.defensive)
    if strategy == "EW":
        w = np.full(n, 1 / n)
        if np.abs(projected(w, safe, policy) - w).max() > 1e-9:
            raise ValueError("infeasible")
        return w
    if strategy == "BL_ML":
        m = np.full(n, 1 / n) if market is None else np.asarray(market, float)
        mu = posterior(regularised(cov), m, np.asarray(p, float).reshape(-1, n), np.asarray(q, float), np.asarray(conf, float))[1]
    elif strategy != "MVO":
        raise ValueError("unknown strategy")
    return mean_variance(mu, cov, assets, policy)


class AllocationError(ValueError):
    """A request that cannot be answered; `code` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def checked(assets: list[str], mu, cov, p=None, q=None, conf=None) -> None:
    """Refuses wrong shapes, values that are not finite, covariances that are not symmetric or have a negative
    eigenvalue, and views that do not fit or have confidences outside [0, 1]."""
    mu, cov, n = np.asarray(mu, float), np.asarray(cov, float), len(assets)
    if not n or len(set(assets)) != n or mu.shape != (n,) or cov.shape != (n, n):
        raise AllocationError("INVALID_SHAPE")
    if not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        raise AllocationError("NOT_FINITE")
    scale = max(float(np.abs(cov).max()), 1e-12)
    if np.abs(cov - cov.T).max() > 1e-8 * scale:
        raise AllocationError("NOT_SYMMETRIC")
    if np.linalg.eigvalsh((cov + cov.T) / 2)[0] < -1e-8 * scale:
        raise AllocationError("NOT_PSD")
    if p is not None and len(p):
        p, q, conf = np.asarray(p, float), np.asarray(q, float), np.asarray(conf, float)
        if p.ndim != 2 or p.shape[1] != n or q.shape != (len(p),) or conf.shape != (len(p),) or not (np.isfinite(p).all() and np.isfinite(q).all()) or (np.abs(p).sum(axis=1) == 0).any():
            raise AllocationError("INVALID_VIEWS")
        if not ((conf >= 0) & (conf <= 1)).all():
            raise AllocationError("INVALID_CONFIDENCE")


def serve(strategy: str, assets: list[str], mu, cov, policy: Policy, p=None, q=None, conf=None) -> tuple[np.ndarray, float]:
    """Checked weights and the optimality gap of a request: how far a gradient step and projection move them, which
    is 0 at the optimum. AllocationError where the input, the limits or the solver fail."""
    checked(assets, mu, cov, p, q, conf)
    if strategy == "BL_ML" and (p is None or not len(p)):
        raise AllocationError("MISSING_VIEWS")
    none = np.zeros((0, len(assets)))
    p, q, conf = (none, [], []) if p is None or not len(p) else (p, q, conf)
    safe = np.isin(assets, policy.defensive)
    try:
        w = allocate(strategy, assets, mu, cov, policy, p=p, q=q, conf=conf)
        near = projected(w, safe, policy)
    except AllocationError:
        raise
    except ValueError as e:
        raise AllocationError("INFEASIBLE" if "infeasible" in str(e) else "INVALID_REQUEST") from e
    if np.abs(near - w).max() > 1e-7:
        raise AllocationError("NOT_CONVERGED")
    if strategy == "EW":
        return near, 0.0
    fixed = regularised(cov)
    if strategy == "BL_ML":
        mu = posterior(fixed, np.full(len(assets), 1 / len(assets)), np.asarray(p, float).reshape(-1, len(assets)), np.asarray(q, float), np.asarray(conf, float))[1]
    slope = 2 * policy.risk_aversion * fixed @ near - np.asarray(mu, float)
    scale = max(float(np.abs(slope).max()), 1e-12)
    gap = float(np.abs(projected(near - slope / scale * 1e-3, safe, policy) - near).max())
    if gap > 1e-5:
        raise AllocationError("NOT_CONVERGED")
    return near, gap


SERVED = "rn long, strategy string, status string, error string, assets array<string>, weights array<double>, adjusted boolean, least_eigenvalue double"


def served(moments: DataFrame, policy: Policy, strategy: str = "MVO", views: DataFrame | None = None) -> DataFrame:
    """A row for each request (rn): status, error code, assets and weights, and whether the covariance had to be adjusted. A
    request that fails says so and does not end the others. views: a row for each request that has some (t, assets, p, q,
    conf), see views.matrices; BL_ML without any is refused."""

    def run(pdf: pd.DataFrame, seen: pd.DataFrame | None = None) -> pd.DataFrame:
        assets = sorted(pdf["a"].unique())
        cov = pdf.pivot(index="a", columns="b", values="cov").reindex(index=assets, columns=assets).to_numpy()
        mu = pdf.groupby("a")["mean"].first().loc[assets].to_numpy()
        status, error, weights, report = "optimal", None, None, {"applied": None, "least_eigenvalue": None}
        try:
            weights = serve(strategy, assets, mu, cov, policy, *_views_of(seen, assets))[0].tolist()
            report = adjustment(cov)
        except AllocationError as e:
            status, error = "failed", e.code
        one = {"rn": int(pdf["rn"].iloc[0]), "strategy": strategy, "status": status, "error": error, "assets": assets, "weights": weights, "adjusted": report["applied"], "least_eigenvalue": report["least_eigenvalue"]}
        return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in one.items()})

    if views is None:
        return moments.groupBy("rn").applyInPandas(lambda pdf: run(pdf), SERVED)
    packed = views.select(F.col("t").alias("rn"), "assets", "p", "q", "conf").join(moments.select("rn").distinct(), "rn", "left_semi")
    return moments.groupBy("rn").cogroup(packed.groupBy("rn")).applyInPandas(lambda pdf, seen: run(pdf, seen), SERVED)


def solved(moments: DataFrame, policy: Policy, strategy: str = "MVO", prune: float = 0.01, views: DataFrame | None = None, tight: DataFrame | None = None, tight_aversion: float = 5.0) -> DataFrame:
    """Weights (strategy, rn, asset, w) of each decision from rows (rn, a, b, mean, cov): mean of a and
    covariance of a with b. views: one row per decision (t, names, assets, p, q, conf), see views.matrices; rows
    of P whose legs are not all among the decision's assets go. tight: decisions (rn) that take the higher
    aversion. One small matrix per group."""
    rows = moments.select("rn", "a", "b", "mean", "cov")
    if tight is not None:
        rows = rows.join(tight.select("rn", F.lit(True).alias("tight")), "rn", "left")
    else:
        rows = rows.withColumn("tight", F.lit(None).cast("boolean"))

    def run(pdf: pd.DataFrame, seen: pd.DataFrame | None = None) -> pd.DataFrame:
        assets = sorted(pdf["a"].unique())
        cov = pdf.pivot(index="a", columns="b", values="cov").loc[assets, assets].to_numpy()
        mu = pdf.groupby("a")["mean"].first().loc[assets].to_numpy()
        p, q, conf = _views_of(seen, assets)
        own = replace(policy, risk_aversion=tight_aversion) if pdf["tight"].iloc[0] is True or pdf["tight"].iloc[0] == 1 else policy
        w = allocate(strategy, assets, mu, cov, own, p=p, q=q, conf=conf)
        w = pruned(w, np.isin(assets, policy.defensive), policy, prune)
        return pd.DataFrame({"strategy": strategy, "rn": pdf["rn"].iloc[0], "asset": assets, "w": w})

    schema = "strategy string, rn long, asset string, w double"
    if views is None:
        return rows.groupBy("rn").applyInPandas(lambda pdf: run(pdf), schema)
    packed = views.select(F.col("t").alias("rn"), "assets", "p", "q", "conf").join(moments.select("rn").distinct(), "rn", "left_semi")
    return rows.groupBy("rn").cogroup(packed.groupBy("rn")).applyInPandas(lambda pdf, seen: run(pdf, seen), schema)


def posteriors(moments: DataFrame, views: DataFrame, tau: float = 0.05, delta: float = 2.5) -> DataFrame:
    """Equilibrium returns of equal weights and their update by the decision's views (rn, asset, prior, posterior), and
    each mean's variance before and after, with the covariance as it is."""

    def run(pdf: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        assets = sorted(pdf["a"].unique())
        cov = pdf.pivot(index="a", columns="b", values="cov").loc[assets, assets].to_numpy()
        p, q, conf = _views_of(seen, assets)
        pi, mu = posterior(cov, np.full(len(assets), 1 / len(assets)), p, q, conf, tau, delta)
        return pd.DataFrame({"rn": pdf["rn"].iloc[0], "asset": assets, "prior": pi, "posterior": mu, "prior_var": tau * np.diag(cov), "posterior_var": np.diag(posterior_covariance(cov, p, conf, tau))})

    packed = views.select(F.col("t").alias("rn"), "assets", "p", "q", "conf").join(moments.select("rn").distinct(), "rn", "left_semi")
    return moments.select("rn", "a", "b", "cov").groupBy("rn").cogroup(packed.groupBy("rn")).applyInPandas(run, "rn long, asset string, prior double, posterior double, prior_var double, posterior_var double")


def _views_of(seen: pd.DataFrame | None, assets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P in the order of the assets, Q and confidences."""
    if seen is None or not len(seen):
        return np.zeros((0, len(assets))), np.zeros(0), np.zeros(0)
    one = seen.iloc[0]
    p = np.array([np.asarray(x, float) for x in one["p"]]).reshape(-1, len(one["assets"]))
    at = {a: i for i, a in enumerate(one["assets"])}
    mine = [at[a] for a in assets if a in at]
    outside = np.delete(p, mine, axis=1)
    keep = ~(outside != 0).any(axis=1)
    out = np.zeros((int(keep.sum()), len(assets)))
    out[:, [i for i, a in enumerate(assets) if a in at]] = p[keep][:, mine]
    return out, np.asarray(one["q"], float)[keep], np.asarray(one["conf"], float)[keep]
