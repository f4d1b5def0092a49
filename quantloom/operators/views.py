"""Views on assets: records (t, name, legs map<asset, coefficient>, q_annual, confidence, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAYS, clip, scaled_view

SOURCE_WEIGHTS = {"rule": 0.3, "relative": 0.3, "ml": 0.4, "static": 0.0}


def _leg(*pairs):
    return F.create_map(*[x for p in pairs for x in p])


def rule_views(features: DataFrame) -> DataFrame:
    """From (t, asset, n, ma_ratio, rsi, mom_20): a bullish or bearish view where the averages differ by more
    than two per cent; confidence moves with overbought and oversold RSI. Needs 31 rows."""
    up, down = F.col("ma_ratio") > 0.02, F.col("ma_ratio") < -0.02
    rows = features.filter((F.col("n") >= 31) & (up | down))
    q = F.when(up, 0.05 + 0.5 * F.abs("mom_20")).otherwise(-0.03 - 0.3 * F.abs("mom_20"))
    hot, cold = F.col("rsi") > 70, F.col("rsi") < 30
    factor = F.when(hot, F.when(up, 0.7).otherwise(1.2)).when(cold, F.when(up, 1.2).otherwise(0.7)).otherwise(1.0)
    conf = clip(F.when(up, 0.6).otherwise(0.5) * factor, 0.3, 0.9)
    return rows.select("t", F.concat(F.when(up, F.lit("bullish_")).otherwise(F.lit("bearish_")), "asset").alias("name"), _leg((F.col("asset"), F.lit(1.0))).alias("legs"), q.alias("q_annual"), conf.alias("confidence"), F.lit("rule").alias("source"))


def relative_views(momenta: DataFrame) -> DataFrame:
    """All pairs of assets of one t by difference of 20-day momentum; the stronger one is long. The day's
    assets are gathered in one array and unfolded into pairs."""
    packed = momenta.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("asset", "mom_20"))).alias("x"))
    pairs = packed.select("t", "x", F.posexplode("x").alias("i", "a")).select("t", "a", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("b"))
    diff = F.col("a.mom_20") - F.col("b.mom_20")
    rows = pairs.withColumn("diff", diff).filter(F.abs("diff") >= 0.01)
    long, short = F.when(F.col("diff") > 0, F.col("a.asset")).otherwise(F.col("b.asset")), F.when(F.col("diff") > 0, F.col("b.asset")).otherwise(F.col("a.asset"))
    size = F.abs("diff")
    return rows.select(
        "t", F.concat(long, F.lit("_over_"), short).alias("name"), _leg((long, F.lit(1.0)), (short, F.lit(-1.0))).alias("legs"),
        F.least(F.lit(0.30), size * DAYS / 20).alias("q_annual"), F.least(F.lit(0.8), 0.4 + 10 * size).alias("confidence"), F.lit("relative").alias("source"),
    )


def model_views(predictions: DataFrame, horizon: int = 5) -> DataFrame:
    """From (t, asset, pred, conf, vol_20, n_obs): forecasts of 0.1 % and more as annual views."""
    rows = predictions.filter(F.abs("pred") >= 0.001)
    return rows.select("t", F.concat(F.lit("ml_"), "asset").alias("name"), _leg((F.col("asset"), F.lit(1.0))).alias("legs"), scaled_view("pred", "vol_20", "n_obs", horizon).alias("q_annual"), F.col("conf").alias("confidence"), F.lit("ml").alias("source"))


def ranking_views(scores: DataFrame, spread: float = 0.20) -> DataFrame:
    """Pairs of the upper against the lower half of a ranking (t, asset, score, std): daily q by distance of
    ranks, confidence by distance of scores less their spread. One pair at least, first over last."""
    order = Window.partitionBy("t").orderBy(F.desc("score"), "asset")
    ranked = scores.withColumn("i", F.row_number().over(order) - 1)
    packed = ranked.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "asset", "score", "std"))).alias("x"), F.count("*").alias("k"))
    pairs = packed.select("t", "k", F.explode("x").alias("a"), "x").select("t", "k", "a", F.explode("x").alias("b"))
    half = F.expr("k div 2")
    rows = pairs.filter((F.col("a.i") < F.greatest(half, F.lit(1))) & (F.col("b.i") >= half + F.col("a.i")) & (F.col("b.i") > F.col("a.i")))
    conf = clip(0.5 + 2 * (F.col("a.score") - F.col("b.score")) - 5 * (F.col("a.std") + F.col("b.std")) / 2, 0.25, 0.75)
    q = F.lit(spread / DAYS) * (F.col("b.i") - F.col("a.i")) / F.col("k")
    return rows.select("t", F.concat("a.asset", F.lit("_over_"), "b.asset").alias("name"), _leg((F.col("a.asset"), F.lit(1.0)), (F.col("b.asset"), F.lit(-1.0))).alias("legs"), q.alias("q_daily"), conf.alias("confidence"), F.lit("ranking").alias("source"))


def combined(views: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Confidence times the weight of the view's source; sources of weight 0 go."""
    w = weights or SOURCE_WEIGHTS
    weight = F.element_at(F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    return views.withColumn("_w", weight).filter("_w > 0").withColumn("confidence", F.col("confidence") * F.col("_w")).drop("_w")


def dampened(confidence: str, ratio: str, limit: float = 1.3):
    return F.when(F.col(ratio) > limit, F.col(confidence) * limit / F.col(ratio)).otherwise(F.col(confidence))


def regimes(returns: DataFrame, ratios: DataFrame, lookback: int = 60) -> DataFrame:
    """Per day the volatility ratio, the drawdown of the equal-weight path over the lookback (the peak starts
    at the first value after a return) and its mean return."""
    from ..functions.scalar import regime

    mean = returns.filter("r is not null").groupBy("d").agg(F.avg("r").alias("m"))
    back = Window.orderBy("d").rowsBetween(-(lookback - 1), 0)
    path = mean.withColumn("x", F.collect_list("m").over(back)).withColumn("equity_momentum", F.avg("m").over(back))
    fold = "aggregate(x, named_struct('nav', 1D, 'peak', 0D), (s, r) -> named_struct('nav', s.nav * (1 + r), 'peak', greatest(s.peak, s.nav * (1 + r))), s -> s.nav / s.peak - 1)"
    out = path.withColumn("drawdown", F.expr(fold)).join(ratios, "d")
    return out.select("d", "vol_ratio", "drawdown", "equity_momentum", regime("vol_ratio", "drawdown").alias("regime"))


def defensive_views(regimes_: DataFrame, assets: list[str], defensive: str) -> DataFrame:
    """In stress 5 % at 0.85 of the confidence 0.80, in crisis 10 % at 1.0: the defensive asset over all
    others alike."""
    others = [a for a in assets if a != defensive]
    legs = _leg((F.lit(defensive), F.lit(1.0)), *[(F.lit(a), F.lit(-1.0 / len(others))) for a in others])
    rows = regimes_.filter("regime <> 'normal'")
    crisis = F.col("regime") == "crisis"
    return rows.select("d", F.concat(F.lit("defensive_"), "regime").alias("name"), legs.alias("legs"), (F.when(crisis, 0.10).otherwise(0.05) / DAYS).alias("q_daily"), (0.80 * F.when(crisis, 1.0).otherwise(0.85)).alias("confidence"))


def matrices(views: DataFrame, assets: list[str], daily: bool = False) -> DataFrame:
    """Per t the rows P in asset order, Q per day and confidences; a view with a leg outside goes whole."""
    inside = F.size(F.array_except(F.map_keys("legs"), F.array(*[F.lit(a) for a in assets]))) == 0
    row = F.array(*[F.coalesce(F.try_element_at("legs", F.lit(a)), F.lit(0.0)) for a in assets])
    q = F.col("q_daily") if daily else F.col("q_annual") / DAYS
    one = F.struct("name", row.alias("p"), q.alias("q"), F.coalesce("confidence", F.lit(0.5)).alias("c"))
    packed = views.filter(inside).groupBy("t").agg(F.array_sort(F.collect_list(one)).alias("v"))
    return packed.select("t", F.array(*[F.lit(a) for a in assets]).alias("assets"), F.col("v.name").alias("names"), F.col("v.p").alias("p"), F.col("v.q").alias("q"), F.col("v.c").alias("conf"))




def static_views(moments: DataFrame, views: list[tuple[str, dict[str, float], float, float]]) -> DataFrame:
    """The same named views (legs, annual q, confidence) at each decision (t)."""
    one = F.array(*[F.struct(F.lit(n).alias("name"), _leg(*[(F.lit(a), F.lit(float(c))) for a, c in legs.items()]).alias("legs"), F.lit(float(q)).alias("q_annual"), F.lit(float(c)).alias("confidence")) for n, legs, q, c in views])
    return moments.select("t").distinct().select("t", F.explode(one).alias("v")).select("t", "v.*", F.lit("static").alias("source"))


def dispatched(mode: str, sources: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame | None:
    """The views of a mode: rule_based, relative and ml take their own source, combined takes all at the
    sources' weights. No model, no ml views: null."""
    if mode == "combined":
        out = None
        for one in sources.values():
            out = one if out is None else out.unionByName(one)
        return None if out is None else combined(out, weights)
    name = {"rule_based": "rule", "relative": "relative", "ml": "ml", "static": "static"}.get(mode)
    if name is None:
        raise ValueError(f"unknown view mode {mode}")
    return sources.get(name)


def cold_start_views(prices: DataFrame, spread: float = 0.20, digits: int | None = None) -> DataFrame:
    """Ranking views from 20-row momenta (t, asset, first, last) while no model is trained: deviation 0.1,
    confidence at most 0.45. digits: places of the momenta."""
    score = F.col("last") / F.col("first") - 1
    scores = prices.filter("first > 0").select("t", "asset", (score if digits is None else F.round(score, digits)).alias("score"), F.lit(0.1).alias("std"))
    several = Window.partitionBy("t")
    scores = scores.withColumn("_n", F.count("*").over(several)).filter("_n >= 2").drop("_n")
    return ranking_views(scores, spread).withColumn("confidence", F.least("confidence", F.lit(0.45)))


def with_defensive(views: DataFrame, defensive: DataFrame, ratios: DataFrame) -> DataFrame:
    """Daily model views (t, name, legs, q_daily, confidence) with confidences dampened by the volatility ratio of
    their decision (t, vol_ratio), and the defensive views behind them; where a decision has no model view
    the defensive ones stand alone."""
    columns = ["t", "name", "legs", "q_daily", "confidence"]
    calm = views.join(ratios.select("t", "vol_ratio"), "t", "left").withColumn("confidence", dampened("confidence", "vol_ratio"))
    return calm.select(*columns).unionByName(defensive.select(*columns))


def view_counts(views: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rebalances, and views made at them."""
    each = decisions.select("t").distinct().join(views.groupBy("t").agg(F.count("*").alias("n")), "t", "left")
    return each.agg(F.count("*").alias("rebalances"), F.sum(F.coalesce("n", F.lit(0))).alias("views"))
