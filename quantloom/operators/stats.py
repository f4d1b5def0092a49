"""Return and risk statistics, covariance, quantiles: aggregates that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAYS, annualised, daily_risk_free, div


def sharpe(r: str = "r") -> Column:
    x = F.col(r) - F.lit(daily_risk_free())
    return F.sqrt(F.lit(float(DAYS))) * div(F.avg(x), F.stddev_samp(x))


def sortino(r: str = "r") -> Column:
    """The downside is the root mean square of the negative excess returns alone."""
    x = F.col(r) - F.lit(daily_risk_free())
    return F.sqrt(F.lit(float(DAYS))) * div(F.avg(x), F.sqrt(F.avg(F.when(x < 0, x * x))))


def asset_summary(returns: DataFrame) -> DataFrame:
    """Per asset: total and annual return, annual volatility, from (asset, d, px, r)."""
    out = returns.groupBy("asset").agg(
        (div(F.max_by("px", "d"), F.min_by("px", "d")) - 1).alias("total_return"),
        F.count("r").alias("n"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(DAYS)))).alias("ann_vol"),
    )
    return out.withColumn("ann_return", annualised("total_return", "n"))


def metric_summary(nav: DataFrame, key: str | list[str] = "strategy") -> DataFrame:
    """Per strategy (or other keys) the seven metrics of a value path (strategy, d, nav)."""
    by = Window.partitionBy(key).orderBy("d")
    rows = nav.withColumn("r", div("nav", F.lag("nav").over(by)) - 1).withColumn("dd", div("nav", F.max("nav").over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    out = rows.groupBy(key).agg(
        F.max_by("nav", "d").alias("final_nav"),
        (div(F.max_by("nav", "d"), F.min_by("nav", "d")) - 1).alias("total_return"),
        F.count("r").alias("n"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(DAYS)))).alias("ann_vol"),
        sharpe().alias("sharpe"),
        sortino().alias("sortino"),
        F.min("dd").alias("max_drawdown"),
    )
    out = out.withColumn("ann_return", annualised("total_return", "n"))
    return out.withColumn("calmar", div("ann_return", F.abs("max_drawdown")))


def window_rows(returns: DataFrame, every: int, window: int) -> DataFrame:
    """Each decision row t (every `every` sessions, from `window` on) with the returns of the window up to
    it: (t, asset, rn, r). A row unfolds into the decisions that use it, so no join is needed."""
    first = F.ceil(F.greatest(F.col("rn") - 1 - window, F.lit(0)) / every).cast("bigint")
    last = F.floor((F.col("rn") - 2) / every).cast("bigint")
    rows = returns.filter("r is not null").withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.select((F.col("_k") * every + window).alias("t"), "asset", "rn", "r").filter(F.col("rn").between(F.col("t") - window + 2, F.col("t") + 1))


def covariance(rows: DataFrame) -> DataFrame:
    """Per t all pairs (a, b) of assets with covariance and correlation (null where a side is constant).
    The assets' returns of one (t, rn) are gathered into one array - as many as there are assets - and
    unfolded into pairs."""
    packed = rows.groupBy("t", "rn").agg(F.collect_list(F.struct("asset", "r")).alias("x"))
    pairs = packed.select("t", F.explode("x").alias("p"), "x").select("t", "p", F.explode("x").alias("q")).select("t", F.col("p.asset").alias("a"), F.col("q.asset").alias("b"), F.col("p.r").alias("x"), F.col("q.r").alias("y"))
    out = pairs.groupBy("t", "a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.count("*").alias("n"))
    return out.select("t", "a", "b", "cov", div("cov", F.col("sx") * F.col("sy")).alias("corr"), "n")


def block_moments(returns: DataFrame, every: int, first: int = 0) -> DataFrame:
    """Mergeable sums (block, a, b, n, sa, sb, saa, sbb, sab, ca, cb) of the pairs a <= b over blocks of `every` rows, block 0
    from row `first` on. Values are taken from the asset's first return (ca, cb), so a constant side has sums of
    0. Rows on which not every asset has a return are left out. A row is unfolded once, within its block's
    array; a pair has one row for each block."""
    rows = returns.filter("r is not null").groupBy("rn").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("v"))
    head = rows.agg(F.max_by("v", F.struct(F.size("v"), -F.col("rn"))).alias("head")).select(F.col("head.asset").alias("names"), F.col("head.r").alias("base"))
    whole = rows.join(F.broadcast(head)).filter("v.asset = names")  # one row
    shifted = whole.select(F.expr(f"(rn - {first}) div {every}").alias("block"), "names", "base", F.expr("transform(v, (x, i) -> x.r - base[i])").alias("x"))
    blocks = shifted.filter("block >= 0").groupBy("block").agg(F.collect_list("x").alias("m"), F.first("names").alias("names"), F.first("base").alias("base"))
    blocks = blocks.withColumn("s", F.expr("transform(names, (_, j) -> aggregate(m, 0D, (s, x) -> s + x[j]))")).withColumn("q", F.expr("transform(names, (_, j) -> aggregate(m, 0D, (s, x) -> s + x[j] * x[j]))"))
    each = blocks.select("*", F.posexplode("names").alias("i", "a")).withColumn("c", F.expr("transform(sequence(i, size(names) - 1), j -> aggregate(m, 0D, (s, x) -> s + x[i] * x[j]))"))
    pairs = each.select("block", F.size("m").cast("bigint").alias("n"), "i", "a", "names", "base", "s", "q", F.posexplode("c").alias("k", "sab"))
    at = F.expr("i + k")
    return pairs.select(
        "block", "a", F.col("names")[at].alias("b"), "n", F.expr("s[i]").alias("sa"), F.col("s")[at].alias("sb"), F.expr("q[i]").alias("saa"), F.col("q")[at].alias("sbb"), "sab",
        F.expr("base[i]").alias("ca"), F.col("base")[at].alias("cb"),
    )


def merged_moments(blocks: DataFrame, back: int | None = None) -> DataFrame:
    """Of each block and the blocks before it (`back` in all; none: every one) mean of a, covariance and correlation
    of all pairs (block, a, b, n, mean, cov, corr). Sums of blocks are added, no row is read again. A variance below
    1e-13 of the raw square is rounding and counts as 0: then the correlation is null."""
    span = Window.partitionBy("a", "b").orderBy("block").rangeBetween(Window.unboundedPreceding if back is None else 1 - back, 0)
    sums = blocks.select("block", "a", "b", "ca", "cb", *[F.sum(c).over(span).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    free = F.col("n") - 1
    va, vb = [F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab"]
    va, vb = (F.when(v > 1e-13 * F.col(f"s{x}{x}"), v) for v, x in ((va, "a"), (vb, "b")))
    cov = div(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), free)
    out = sums.select("block", "a", "b", "n", (F.col("ca") + F.col("sa") / F.col("n")).alias("ma"), (F.col("cb") + F.col("sb") / F.col("n")).alias("mb"), cov.alias("cov"), div(cov * free, F.sqrt(va * vb)).alias("corr"))
    one = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("ma").alias("mean"))
    other = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("mb").alias("mean"))
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other)))
    return out.select("block", sides.alias("p"), "n", "cov", "corr").select("block", "p.a", "p.b", "n", "p.mean", "cov", "corr")


def distance(cov: DataFrame) -> DataFrame:
    """1 - correlation in [0, 2]; an unknown correlation counts as 0; no distance to oneself."""
    d = F.least(F.greatest(1 - F.coalesce("corr", F.lit(0.0)), F.lit(0.0)), F.lit(2.0))
    return cov.select("t", "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(d).alias("dist"))


def volatility_ratio(returns: DataFrame, short: int = 20, longer: int = 120) -> DataFrame:
    """Per day the mean short volatility over the mean long one, with windows cut at the start."""
    by = Window.partitionBy("asset").orderBy("d")
    sd = [F.stddev_samp("r").over(by.rowsBetween(-(n - 1), 0)).alias(c) for n, c in ((short, "s"), (longer, "l"))]
    return returns.select("d", *sd).groupBy("d").agg(div(F.avg("s"), F.avg("l")).alias("vol_ratio"))


def only_in_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows, repeated ones counted, each of two runs has that the other lacks."""
    one, two = a.exceptAll(b).select(F.lit(1).alias("x")), b.exceptAll(a).select(F.lit(2).alias("x"))
    return one.union(two).agg(F.count_if(F.col("x") == 1).alias("only_first"), F.count_if(F.col("x") == 2).alias("only_second"))


def same_sign(forecast: str, outcome: str) -> Column:
    """Whether both have the same sign, 0 being one of its own; null while the outcome is unknown."""
    return F.signum(forecast) == F.signum(outcome)


def graded(rows: DataFrame, forecast: str, outcome: str) -> DataFrame:
    """Adds a status: PENDING while a forecast's outcome is unknown, else HIT or MISS by sign."""
    return rows.withColumn("status", F.when(F.col(outcome).isNull(), "PENDING").when(same_sign(forecast, outcome), "HIT").otherwise("MISS"))


def hit_rate(graded: DataFrame) -> DataFrame:
    """Forecast counts and hit rate by (kind, phase) and by (kind, phase, asset)."""
    return graded.sparkSession.sql(
        """select kind, phase, case when grouping(asset) = 1 then 'Overall' else asset end as asset, count(*) as n_issued, count(correct) as n_scored,
                  count(*) - count(correct) as n_unmatured, cast(sum(cast(correct as int)) as bigint) as n_correct,
                  avg(cast(correct as double)) as rate
           from {graded} group by grouping sets ((kind, phase), (kind, phase, asset))""",
        graded=graded,
    )
