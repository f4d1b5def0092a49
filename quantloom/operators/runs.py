"""The tables of a run, from its weights (strategy, rn, asset, w), its holdings (see portfolio.holdings), prices
(asset, d, rn, px) and the audits of its selections and fits. Each table is one lazy plan; a run's universe and its days
bound them, not the trades behind the prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAYS, div
from . import experiments, stats
from . import portfolio as N

#: What a residual may be off by before it counts as a violation.
TOLERANCE = 1e-8


def returns(nav: DataFrame) -> DataFrame:
    """Daily returns (phase, strategy, d, r) inside each phase."""
    before = F.lag("nav").over(Window.partitionBy("phase", "strategy").orderBy("d"))
    return nav.select("phase", "strategy", "d", (F.col("nav") / before - 1).alias("r")).filter("r is not null")


def metrics(nav: DataFrame, trades: DataFrame) -> DataFrame:
    """Metrics of each phase and strategy with its first and last day, and the turnover after the first day without the
    first allocation, in total and to a year."""
    spans = nav.groupBy("phase", "strategy").agg(F.min("d").alias("start"), F.max("d").alias("end"))
    inside = trades.filter("not initial").select("strategy", F.col("d").alias("at"), "turnover")
    spent = spans.join(inside, "strategy").filter("at > start and at <= end").groupBy("phase", "strategy").agg(F.sum("turnover").alias("total_turnover"))
    out = stats.metric_summary(nav, ["phase", "strategy"]).join(spans, ["phase", "strategy"]).join(spent, ["phase", "strategy"], "left")
    out = out.withColumn("total_turnover", F.coalesce("total_turnover", F.lit(0.0)))
    return out.withColumn("annual_turnover", div(F.col("total_turnover") * DAYS, "n"))


def executions(weights: DataFrame, days: DataFrame) -> DataFrame:
    """Each decision of a strategy with the days of the decision, the trade and the first return, and whether they come one
    after the other. Decisions without a next close are not carried out."""
    on = lambda n, name: days.select((F.col("rn") - n).alias("rn"), F.col("d").alias(name))
    rows = weights.select("strategy", "rn").distinct().join(on(0, "decision"), "rn").join(on(1, "execution"), "rn").join(on(2, "first_return"), "rn", "left")
    return rows.withColumn("in_time", (F.col("decision") < F.col("execution")) & F.coalesce(F.col("execution") < F.col("first_return"), F.lit(True)))


def fit_windows(training: DataFrame, days: DataFrame) -> DataFrame:
    """Each fit (u, asset) with its days, and whether it passes: no label of a fitted row reaches the validation part
    and none reaches past the decision. A fit without a validation part has only the second to meet."""
    on = lambda key, name: days.select(F.col("rn").alias(key), F.col("d").alias(name))
    rows = training.join(on("u", "retrained"), "u").join(on("last_label", "last_label_day"), "last_label")
    apart = F.coalesce(F.col("last_fitted") < F.col("validation_from"), F.lit(True))
    return rows.select("u", "asset", "retrained", "last_label_day", "last_label", "last_fitted", "validation_from", (apart & (F.col("last_label") < F.col("u"))).alias("passed"))


def constraints(weights: DataFrame, defensive: list[str], bounded: list[str], cap: float, floor: float, group_cap: float) -> DataFrame:
    """Residuals of each decision; those of the groups only for the strategies that are bounded by them."""
    own = F.col("strategy").isin(bounded)
    out = N.residuals(weights, defensive, cap, floor, group_cap)
    return out.withColumns({c: F.when(own, F.col(c)).otherwise(0.0) for c in ("group_cap", "floor")})


def violations(constraints: DataFrame) -> DataFrame:
    return constraints.filter(F.greatest("budget", "negative", "cap", "group_cap", "floor") > TOLERANCE)


def tables(prices: DataFrame, weights: DataFrame, held: DataFrame, anchor: Column, selection: DataFrame, training: DataFrame, predictions: DataFrame, limits: dict) -> dict[str, DataFrame]:
    """The thirteen tables by name. anchor: the day that ends the first phase; selection (rn, selected_at, members),
    training (see walkforward.audits), predictions (t, asset, ...); limits: arguments of constraints()."""
    days = prices.select("rn", "d").distinct()
    nav, trades = experiments.phases(N.path(held), anchor).select("phase", "strategy", "d", "nav"), N.traded(held)
    named = days.select("rn", F.col("d").alias("decision"))
    checked = constraints(weights, **limits)
    return {
        "nav": nav, "returns": returns(nav), "metrics": metrics(nav, trades),
        "weights": weights.join(named, "rn").select("strategy", "rn", "decision", "asset", "w"),
        "turnover": N.ledger(held), "turnover_summary": trades, "ledger": executions(weights, days),
        "selection": selection.join(named, "rn").select("rn", "decision", "selected_at", F.to_json("members").alias("members")),
        "training": training, "windows": fit_windows(training, days),
        "predictions": predictions.join(named.withColumnRenamed("rn", "t"), "t"),
        "constraints": checked, "violations": violations(checked),
    }


def verdict(run: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how many rows of each kind speak against the run; all are 0 for a sound one."""
    bad = {
        "nav": ~F.coalesce((F.col("nav") > 0) & (F.abs("nav") < float("inf")), F.lit(False)), "violations": F.lit(True),
        "windows": ~F.col("passed"), "ledger": ~F.col("in_time"),
    }
    parts = [run[name].agg(F.count_if(x).alias("n")).select(F.lit(name).alias("check"), "n") for name, x in bad.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
