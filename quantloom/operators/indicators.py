"""Technical indicators and features over a panel (asset, d, px, rn): window functions that share one
sort by asset, and recursive averages by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, div


def by_asset():
    return Window.partitionBy("asset").orderBy("d")


def trailing(n: int):
    return by_asset().rowsBetween(-(n - 1), 0)


def strict(value: Column, counted: str | Column, n: int) -> Column:
    """The value where the window holds n known ones, else null."""
    return F.when(F.count(counted).over(trailing(n)) == n, value)


def momentum(n: int, px: str = "px") -> Column:
    return div(px, F.lag(px, n).over(by_asset())) - 1


def returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", momentum(1))


def sma(n: int, px: str = "px", full: bool = False) -> Column:
    mean = F.avg(px).over(trailing(n))
    return strict(mean, px, n) if full else mean


def volatility(n: int, r: str = "r", full: bool = True) -> Column:
    sd = F.stddev_samp(r).over(trailing(n))
    return strict(sd, r, n) if full else sd


def price_dispersion(n: int = 20, px: str = "px") -> Column:
    return strict(div(F.stddev_samp(px).over(trailing(n)), F.avg(px).over(trailing(n))), px, n)


def rsi(panel: DataFrame, n: int = 14, full: bool = True) -> DataFrame:
    """Adds `rsi`, by simple means of gains and losses. The first row counts as no gain and no loss. Without
    any loss it is null, or 50 in the lenient form, which also takes short windows as 50."""
    step = F.coalesce(F.col("px") - F.lag("px", 1).over(by_asset()), F.lit(0.0))
    moved = panel.withColumn("_g", F.greatest(step, F.lit(0.0))).withColumn("_l", F.greatest(-step, F.lit(0.0)))
    gain, loss = F.avg("_g").over(trailing(n)), F.avg("_l").over(trailing(n))
    value = F.when(F.count("px").over(trailing(n)) == n, 100 - 100 / (1 + div(gain, loss)))
    return moved.withColumn("rsi", value if full else F.coalesce(value, F.lit(50.0))).drop("_g", "_l")


def bollinger(n: int = 20, width: float = 2.0, px: str = "px") -> tuple[Column, Column, Column]:
    mid, sd = F.avg(px).over(trailing(n)), F.stddev_samp(px).over(trailing(n))
    return mid - width * sd, mid, mid + width * sd


def percent_b(n: int = 20, px: str = "px") -> Column:
    low, _, high = bollinger(n, 2.0, px)
    return strict(div(F.col(px) - low, high - low), px, n)


def true_range() -> Column:
    before = F.lag("close", 1).over(by_asset())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("_tr", true_range()).withColumn("atr", F.avg("_tr").over(trailing(n))).drop("_tr")


SPANS = {"ema_10": 10, "ema_30": 30, "ema_12": 12, "ema_26": 26}


def _folded(values: str, span: int) -> Column:
    """What a block adds to a recursive average that enters it as 0, and what is left of the average: the block is the
    affine map e -> keep * e + add."""
    a = 2.0 / (span + 1)
    return F.struct(F.expr(f"pow({1 - a}D, size({values}))").alias("keep"), F.expr(f"aggregate({values}, 0D, (e, v) -> e * {1 - a}D + {a}D * v)").alias("add"))


def _carried(maps: str, first: str) -> Column:
    """The average that enters a block: the maps of the blocks before it, applied to the first value."""
    before = Window.partitionBy("asset").orderBy("_block")
    earlier = F.collect_list(maps).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return F.aggregate(earlier, F.first(first).over(before), lambda e, m: e * m["keep"] + m["add"])


def _spread(values: str, carry: str, span: int) -> Column:
    """The averages of a block's rows."""
    a = 2.0 / (span + 1)
    next_ = f"s.e * {1 - a}D + {a}D * v"
    return F.expr(f"aggregate({values}, named_struct('e', {carry}, 'out', cast(array() as array<double>)), (s, v) -> named_struct('e', {next_}, 'out', array_append(s.out, {next_})), s -> s.out)")


def recursive_averages(panel: DataFrame, block: int = 256) -> DataFrame:
    """Adds ema_10, ema_30 and the MACD line, signal and histogram (12, 26, 9); every average starts at its own first
    value. An asset's rows lie in blocks by rn, each a group of its own; only the blocks' affine maps, two numbers for
    each average, meet in one window of the asset. Prices are known on every row."""
    others = [c for c in panel.columns if c not in ("asset", "rn")]
    rows = panel.groupBy("asset", F.expr(f"(rn - 1) div {block}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("rn", *others))).alias("_rows"))
    rows = rows.withColumn("_px", F.col("_rows.px")).withColumn("_x", F.col("_px")[0])
    rows = rows.withColumns({f"_m{c}": _folded("_px", n) for c, n in SPANS.items()})
    rows = rows.withColumns({f"_c{c}": _carried(f"_m{c}", "_x") for c in SPANS})
    rows = rows.withColumns({f"_e{c}": _spread("_px", f"_c{c}", n) for c, n in SPANS.items()})
    rows = rows.withColumn("_line", F.expr("zip_with(_eema_12, _eema_26, (a, b) -> a - b)")).withColumn("_l", F.col("_line")[0])
    rows = rows.withColumn("_ms", _folded("_line", 9)).withColumn("_cs", _carried("_ms", "_l")).withColumn("_signal", _spread("_line", "_cs", 9))
    each = rows.select("asset", F.explode(F.arrays_zip("_rows", F.col("_eema_10").alias("ema_10"), F.col("_eema_30").alias("ema_30"), F.col("_line").alias("macd"), F.col("_signal").alias("macd_signal"))).alias("_r"))
    own = [F.col("asset") if c == "asset" else F.col(f"_r._rows.{c}").alias(c) for c in panel.columns]
    return each.select(*own, "_r.ema_10", "_r.ema_30", "_r.macd", "_r.macd_signal", (F.col("_r.macd") - F.col("_r.macd_signal")).alias("macd_hist"))


def drawdown(value: str = "px") -> Column:
    return div(value, F.max(value).over(by_asset().rowsBetween(Window.unboundedPreceding, 0))) - 1


def cumulative_return(px: str = "px") -> Column:
    return div(px, F.first(px).over(by_asset()))


def forward_return(h: int, px: str = "px") -> Column:
    return div(F.lead(px, h).over(by_asset()), px) - 1


def percentile_rank(value: str) -> Column:
    """Average-tie rank over the day's known values, divided by the number of rows of the day."""
    known = Window.partitionBy("d", F.col(value).isNull()).orderBy(value)
    ties = Window.partitionBy("d", F.col(value))
    rank = F.rank().over(known) + (F.count("*").over(ties) - 1) / 2
    return F.when(F.col(value).isNotNull(), rank / F.count("*").over(Window.partitionBy("d")))


def relevance(value: str) -> Column:
    """Grade from 0 by value within the day; ties in asset order."""
    return (F.row_number().over(Window.partitionBy("d").orderBy(value, "asset")) - 1).cast("bigint")


def market_features(market: DataFrame) -> DataFrame:
    """Returns over 5, 20 and 60 days and 20-day volatility of one series (d, px)."""
    one = Window.orderBy("d")
    r = market.withColumn("_r", div("px", F.lag("px", 1).over(one)) - 1)
    back = [(div("px", F.lag("px", n).over(one)) - 1).alias(f"market_ret_{n}") for n in (5, 20, 60)]
    win = one.rowsBetween(-19, 0)
    return r.select("d", *back, F.when(F.count("_r").over(win) == 20, F.stddev_samp("_r").over(win)).alias("market_vol_20"))


def ranking_features(panel: DataFrame, market: DataFrame, digits: int = 12) -> DataFrame:
    """The cross-sectional feature frame: momenta, volatilities, RSI, MACD histogram, %B, market features
    and their ranks within the day; momenta and volatilities to so many places, so that ranks do not hang on
    the last bits."""
    own = rsi(returns(recursive_averages(panel)), 14)
    own = own.select(
        "asset", "d", "rn", *[F.round(momentum(n), digits).alias(f"momentum_{n}") for n in (5, 20, 60)], *[F.round(volatility(n), digits).alias(f"vol_{n}") for n in (20, 60)], "rsi", "macd_hist", percent_b(20).alias("pct_b"),
    )
    both = own.join(F.broadcast(market_features(market)), "d", "left")
    both = both.withColumns({f"rank_momentum_{n}": percentile_rank(f"momentum_{n}") for n in (5, 20, 60)} | {"rank_vol": percentile_rank("vol_20")})
    return both.withColumn("rank_overall", (F.col("rank_momentum_5") + F.col("rank_momentum_20") + F.col("rank_momentum_60")) / 3)


def ml_features(panel: DataFrame, first_row: int = 30) -> DataFrame:
    """Eight features of the per-asset learner, from the first full window on."""
    rows = rsi(returns(recursive_averages(panel)), 14, full=False)
    out = rows.select(
        "asset", "d", "rn", "px", *[F.coalesce(momentum(n), F.lit(0.0)).alias(f"momentum_{n}") for n in (5, 10, 20)], "rsi", (div("ema_10", "ema_30") - 1).alias("ma_ratio"),
        volatility(20, full=False).alias("vol_20"), "macd_hist", price_dispersion(20).alias("price_std_20"),
    )
    return out.filter(F.col("rn") >= first_row)


def serving_features(panel: DataFrame) -> DataFrame:
    return returns(panel).select("asset", "d", "rn", F.col("r").alias("return_1"), momentum(5).alias("momentum_5"), momentum(20).alias("momentum_20"), volatility(20).alias("volatility_20"))


def bounded_confidence(spread, low: float = 0.25, high: float = 0.70) -> Column:
    return clip(0.70 - F.col(spread) / 0.005, low, high)
