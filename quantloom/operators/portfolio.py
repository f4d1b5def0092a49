"""Value paths, turnover, costs and weight rules, all declarative: weights are (strategy, rn, asset, w) with
rn the row of the decision; prices are (asset, d, px, rn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAYS, div

ALPHA = {"normal": 0.60, "stress": 0.30, "crisis": 0.10}


def rebalance_rows(panel: DataFrame, window: int = 20, every: int = 5) -> DataFrame:
    """Distinct rows with (rn - window) % every = 0, from the window on."""
    return panel.select("rn", "d").distinct().filter((F.col("rn") >= window) & ((F.col("rn") - window) % every == 0))


def equal_weights(decisions: DataFrame, assets: DataFrame, strategy: str = "EW") -> DataFrame:
    named = assets.agg(F.collect_set("asset").alias("a"))
    rows = decisions.select("rn").join(F.broadcast(named)).select("rn", F.explode("a").alias("asset"), F.size("a").alias("n"))
    return rows.select(F.lit(strategy).alias("strategy"), "rn", "asset", (1.0 / F.col("n")).alias("w"))


def inverse_volatility_weights(decisions: DataFrame, volatility: DataFrame, strategy: str = "IV") -> DataFrame:
    """Weights by 1 / volatility (asset, rn, vol) at the decision."""
    rows = decisions.select("rn").join(volatility.filter("vol > 0"), "rn").withColumn("i", 1 / F.col("vol"))
    return rows.select(F.lit(strategy).alias("strategy"), "rn", "asset", (F.col("i") / F.sum("i").over(Window.partitionBy("rn"))).alias("w"))


def _periods(weights: DataFrame, delay: int, last: DataFrame) -> DataFrame:
    """Each decision's weights with the rows from its execution to the next one (or the panel's end)."""
    at = weights.select("strategy", "rn").distinct().withColumn("e", F.col("rn") + delay)
    after = F.lead("e").over(Window.partitionBy("strategy").orderBy("e"))
    spans = at.withColumn("n", after).join(F.broadcast(last)).withColumn("n", F.coalesce("n", "last")).filter("e <= last").select("strategy", "rn", "e", "n")
    return weights.join(spans, ["strategy", "rn"]).drop("rn")


def nav_constant(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Legacy path: weights decided at row rn earn the return of the next row on, rebalanced daily."""
    last = returns.agg(F.max("rn").alias("last"))
    held = _periods(weights, 0, last).select("strategy", "asset", "w", F.explode(F.expr("if(n > e, sequence(e + 1, n), array())")).alias("rn"))
    daily = held.join(returns.select("asset", "rn", "d", "r"), ["asset", "rn"]).groupBy("strategy", "rn", "d").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    upto = Window.partitionBy("strategy").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("strategy", "rn", "d", "r", F.exp(F.sum(F.log1p("r")).over(upto)).alias("nav"))


def holdings(prices: DataFrame, weights: DataFrame, delay: int = 1) -> DataFrame:
    """Fixed shares from each execution (one row after the decision) to the next: per (strategy, e, asset, rn)
    the value of the holding per unit of the portfolio's value at e."""
    last = prices.agg(F.max("rn").alias("last"))
    held = _periods(weights, delay, last).withColumn("rn", F.explode(F.sequence("e", "n")))
    rows = held.join(prices.select("asset", "rn", "d", "px"), ["asset", "rn"])
    start = F.first("px").over(Window.partitionBy("strategy", "e", "asset").orderBy("rn"))
    return rows.select("strategy", "e", "n", "asset", "rn", "d", "w", (F.col("w") * F.col("px") / start).alias("value"))


def nav_drifting(prices: DataFrame, weights: DataFrame, delay: int = 1) -> DataFrame:
    """Audited path: what is not invested is cash; the path is 1 until the first execution. Inside a period
    it has a closed form; the periods' end values multiply."""
    return path(holdings(prices, weights, delay))


def path(held: DataFrame) -> DataFrame:
    """Values along the periods: a row's own growth times the growth of the periods that have ended before, in one
    window of the strategy's days."""
    growth = held.groupBy("strategy", "e", "n", "rn", "d").agg((F.sum("value") + 1 - F.sum("w")).alias("g"))
    earlier = Window.partitionBy("strategy").orderBy("e", "rn").rowsBetween(Window.unboundedPreceding, -1)
    base = F.exp(F.coalesce(F.sum(F.when((F.col("rn") == F.col("n")) & (F.col("n") > F.col("e")), F.log("g"))).over(earlier), F.lit(0.0)))
    return growth.withColumn("base", base).filter("rn > e or n = e").select("strategy", "e", "rn", "d", (F.col("base") * F.col("g")).alias("nav"))


def turnover(prices: DataFrame, weights: DataFrame, delay: int = 1) -> DataFrame:
    """Per execution half the sum of absolute changes from the drifted weights (cash included), the traded
    notional, and whether it is the first."""
    return traded(holdings(prices, weights, delay))


def traded(held: DataFrame) -> DataFrame:
    out = ledger(held).groupBy("strategy", "e", "d").agg(F.sum(F.abs("change")).alias("notional"), F.sum("change").alias("net"))
    first = F.min("e").over(Window.partitionBy("strategy"))
    return out.select("strategy", "e", "d", "notional", ((F.col("notional") + F.abs("net")) / 2).alias("turnover"), (F.col("e") == first).alias("initial"))


def ledger(held: DataFrame) -> DataFrame:
    """Per execution and asset the drifted weight before it, the target and the change. An asset that is held
    but has no target any more is sold: its target is 0. Holdings are read once: a period's last row counts for the
    next execution, its first for its own."""
    whole = Window.partitionBy("strategy", "e", "rn")
    ends = (F.col("rn") == F.col("n")) & (F.col("n") > F.col("e"))
    rows = held.filter(ends | (F.col("rn") == F.col("e"))).withColumn("pre", F.col("value") / (F.sum("value").over(whole) + 1 - F.sum("w").over(whole)))
    none = F.lit(None).cast("double")
    own = F.when(F.col("rn") == F.col("e"), F.struct(F.col("e").alias("e"), F.col("d").alias("d"), none.alias("pre"), F.col("w").alias("target")))
    later = F.when(ends, F.struct(F.col("n").alias("e"), F.lit(None).cast("date").alias("d"), F.col("pre").alias("pre"), none.alias("target")))
    both = rows.select("strategy", "asset", F.explode(F.array_compact(F.array(own, later))).alias("x")).groupBy("strategy", "x.e", "asset").agg(*[F.max(f"x.{c}").alias(c) for c in ("d", "pre", "target")])
    both = both.withColumn("d", F.max("d").over(Window.partitionBy("strategy", "e"))).filter("d is not null")
    pre, target = F.coalesce("pre", F.lit(0.0)), F.coalesce("target", F.lit(0.0))
    return both.select("strategy", "e", "d", "asset", pre.alias("pre"), target.alias("target"), (target - pre).alias("change"))


def turnover_per_year(trades: DataFrame, n_returns: DataFrame) -> DataFrame:
    """Per strategy the turnover of all but the first execution, to a year; n_returns is (strategy, n)."""
    rows = trades.filter("not initial").dropDuplicates(["strategy", "e"]).groupBy("strategy").agg(F.sum("turnover").alias("total"))
    return rows.join(n_returns, "strategy").select("strategy", (F.col("total") * DAYS / F.col("n")).alias("turnover_year"))


def execution_dates(panel: DataFrame, window: int = 20, every: int = 5) -> DataFrame:
    """Of each rebalance the day of the decision, of the trade at the next close, and of the first return on it."""
    days = panel.select("rn", "d").distinct()
    by = Window.orderBy("rn")
    rows = days.select("rn", F.col("d").alias("decision"), F.lead("d", 1).over(by).alias("execution"), F.lead("d", 2).over(by).alias("first_return"))
    return rows.filter((F.col("rn") >= window) & ((F.col("rn") - window) % every == 0))


def costs(daily: DataFrame, traded: DataFrame, *grid: float) -> DataFrame:
    """Net returns (strategy, d, g) for each rate of the grid: on execution days 1 - bps * notional of the value
    is left. A rate that leaves nothing is an error."""
    rows = daily.join(traded.groupBy("strategy", "d").agg(F.sum("notional").alias("notional")), ["strategy", "d"], "left")
    rows = rows.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    left = 1 - F.col("bps") / 1e4 * F.coalesce("notional", F.lit(0.0))
    checked = F.when(left > 0, left).otherwise(F.raise_error(F.lit("costs exceed the portfolio")).cast("double"))
    return rows.select("strategy", "d", "bps", ((1 + F.col("g")) * checked - 1).alias("net"))


def pruned(weights: DataFrame, least: float = 0.01) -> DataFrame:
    """Weights under the least go; the others share them in proportion; if all are under it, equal weights."""
    by = Window.partitionBy("strategy", "rn")
    keep = F.when(F.col("w") >= least, F.col("w")).otherwise(0.0)
    rows = weights.withColumn("_k", keep).withColumn("_s", F.sum("_k").over(by)).withColumn("_n", F.count("*").over(by))
    return rows.withColumn("w", F.when(F.col("_s") > 0, F.col("_k") / F.col("_s")).otherwise(1.0 / F.col("_n"))).drop("_k", "_s", "_n")


def blended(mvo: DataFrame, bl: DataFrame, regimes: DataFrame, strategy: str = "HYBRID") -> DataFrame:
    """alpha * mvo + (1 - alpha) * bl by regime of the decision, floored at 0, normalised, pruned."""
    alpha = F.element_at(F.create_map(*[x for k, v in ALPHA.items() for x in (F.lit(k), F.lit(v))]), F.col("regime"))
    rows = mvo.select("rn", "asset", F.col("w").alias("a")).join(bl.select("rn", "asset", F.col("w").alias("b")), ["rn", "asset"]).join(regimes.select("rn", "regime"), "rn")
    mix = F.greatest(alpha * F.col("a") + (1 - alpha) * F.col("b"), F.lit(0.0))
    rows = rows.select(F.lit(strategy).alias("strategy"), "rn", "asset", mix.alias("m"))
    return pruned(rows.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("strategy", "rn"))).drop("m"))


def residuals(weights: DataFrame, defensive: list[str], cap: float = 0.5, floor: float = 0.15, group_cap: float = 0.70) -> DataFrame:
    """How far each weight vector is outside each limit (0 inside)."""
    safe = F.col("asset").isin(defensive)
    zero = F.lit(0.0)
    return weights.groupBy("strategy", "rn").agg(
        F.abs(F.sum("w") - 1).alias("budget"), F.greatest(-F.min("w"), zero).alias("negative"), F.greatest(F.max("w") - cap, zero).alias("cap"),
        F.greatest(F.sum(F.when(~safe, F.col("w")).otherwise(0.0)) - group_cap, zero).alias("group_cap"), F.greatest(floor - F.sum(F.when(safe, F.col("w")).otherwise(0.0)), zero).alias("floor"),
    )


def concentration(weights: DataFrame) -> DataFrame:
    """Per strategy the mean Herfindahl index and the mean effective number of holdings."""
    daily = weights.groupBy("strategy", "rn").agg(F.sum(F.col("w") * F.col("w")).alias("h"))
    return daily.groupBy("strategy").agg(F.avg("h").alias("hhi"), F.avg(F.when(F.col("h") > 0, div(F.lit(1.0), "h"))).alias("effective"))


def units_replay(prices: DataFrame, weights: DataFrame, delay: int = 1) -> DataFrame:
    """The path once more from units: shares bought at each execution for the wealth at its close, cash for the
    rest, wealth as cash and shares times price. Wealth at executions is chained through log growth, shares
    follow from it, so path() can be checked against it."""
    held = holdings(prices, weights, delay)
    px = prices.select("asset", "rn", "px")
    at = held.filter("rn = e").select("strategy", "e", "n", "asset", "w").join(px.withColumnRenamed("rn", "e"), ["asset", "e"]).withColumnRenamed("px", "p0")
    growth = at.join(px.select("asset", F.col("rn").alias("n"), F.col("px").alias("p1")), ["asset", "n"]).groupBy("strategy", "e", "n").agg((1 + F.sum(F.col("w") * (F.col("p1") / F.col("p0") - 1))).alias("g"))
    wealth = growth.select("strategy", "e", F.exp(F.coalesce(F.sum(F.log("g")).over(Window.partitionBy("strategy").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("wealth"))
    shares = at.join(wealth, ["strategy", "e"]).select("strategy", "e", "n", "asset", (F.col("wealth") * F.col("w") / F.col("p0")).alias("units"), (F.col("wealth") * F.col("w")).alias("spent"), "wealth")
    days = shares.withColumn("rn", F.explode(F.sequence("e", "n"))).join(prices.select("asset", "rn", "d", "px"), ["asset", "rn"])
    out = days.groupBy("strategy", "e", "n", "rn", "d").agg((F.max("wealth") - F.sum("spent") + F.sum(F.col("units") * F.col("px"))).alias("nav"))
    return out.filter("rn > e or n = e").select("strategy", "rn", "d", "nav")


def alpha_grid(mvo: DataFrame, bl: DataFrame, regimes: DataFrame, grid: list[float]) -> DataFrame:
    """Blends of two weight sets for each coefficient that is used in the normal regime; the strategy names it."""
    each = F.explode(F.array(*[F.lit(float(a)) for a in grid])).alias("coefficient")
    others = F.element_at(F.create_map(*[x for k, v in ALPHA.items() for x in (F.lit(k), F.lit(v))]), F.col("regime"))
    rows = mvo.select("rn", "asset", F.col("w").alias("a")).join(bl.select("rn", "asset", F.col("w").alias("b")), ["rn", "asset"]).join(regimes.select("rn", "regime"), "rn").select("*", each)
    alpha = F.when(F.col("regime") == "normal", F.col("coefficient")).otherwise(others)
    rows = rows.select(F.concat(F.lit("alpha_"), F.col("coefficient").cast("string")).alias("strategy"), "rn", "asset", F.greatest(alpha * F.col("a") + (1 - alpha) * F.col("b"), F.lit(0.0)).alias("m"))
    return pruned(rows.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("strategy", "rn"))).drop("m"))
