"""Comparison of runs: path statistics from returns, phases, seeds, effect sizes, selections in force. A run is
named by (experiment, phase); nothing is gathered beyond one row for each of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAYS, annualised, daily_risk_free, div

METRICS = ["final_nav", "ann_return", "ann_volatility", "sharpe", "max_drawdown"]


def return_stats(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the statistics of daily returns (d, r); the path starts at 1, which counts as its first peak."""
    upto = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    nav = returns.withColumn("_nav", F.exp(F.sum(F.log1p("r")).over(upto)))
    nav = nav.withColumn("_dd", F.col("_nav") / F.greatest(F.max("_nav").over(upto), F.lit(1.0)) - 1)
    volatility = F.stddev_samp("r") * F.sqrt(F.lit(float(DAYS)))
    out = nav.groupBy(*keys).agg(
        F.max_by("_nav", "d").alias("final_nav"), F.count("*").alias("n_returns"), volatility.alias("ann_volatility"),
        div((F.avg("r") - F.lit(daily_risk_free())) * DAYS, volatility).alias("sharpe"), F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
    )
    return out.withColumn("ann_return", annualised(F.col("final_nav") - 1, "n_returns"))


def phases(nav: DataFrame, anchor: Column, first: str = "IS", second: str = "OOS") -> DataFrame:
    """A path (strategy, d, nav) cut at the anchor day, which ends one part and starts the other; both parts
    start again at 1."""
    parts = F.array(F.when(F.col("d") <= anchor, F.lit(first)), F.when(F.col("d") >= anchor, F.lit(second)))
    rows = nav.withColumn("phase", F.explode(F.array_compact(parts)))
    start = F.first("nav").over(Window.partitionBy("strategy", "phase").orderBy("d"))
    return rows.withColumn("nav", F.col("nav") / start)


def effect_sizes(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences of the metrics between each two runs (experiment), the first by name on the left. A run is one row."""
    long = stats.unpivot(["experiment"], metrics, "metric", "value")
    a = long.select("metric", F.col("experiment").alias("left"), F.col("value").alias("a"))
    b = long.select("metric", F.col("experiment").alias("right"), F.col("value").alias("b"))
    return a.join(b, "metric").filter(F.col("left") < F.col("right")).select("left", "right", "metric", (F.col("a") - F.col("b")).alias("effect"))


def head_to_head(rows: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """Metric rows (scenario, strategy) with their differences from the base scenario's of the same strategy."""
    ref = rows.filter(F.col("scenario") == base).select("strategy", *[F.col(m).alias(f"_{m}") for m in metrics])
    return rows.join(ref, "strategy", "left").select("scenario", "strategy", *metrics, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics])


def by_sharpe(rows: DataFrame) -> DataFrame:
    """Scenarios from the highest Sharpe ratio down; unknown ones last, ties by name."""
    order = Window.orderBy(F.desc_nulls_last("sharpe"), "scenario")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).orderBy("place")


def median_path(arms: DataFrame) -> DataFrame:
    """Per day the median return over the arms (arm, d, r)."""
    return arms.groupBy("d").agg(F.median("r").alias("r"), F.count("*").alias("arms"))


def path_gap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two value paths (d, nav) on the days that both have, each divided by its value on the first of them: number of
    days, largest and last difference, correlation of their returns."""
    both = one.select("d", F.col("nav").alias("a")).join(other.select("d", F.col("nav").alias("b")), "d")
    by = Window.orderBy("d")  # as many rows as days
    both = both.select("d", (F.col("a") / F.first("a").over(by)).alias("a"), (F.col("b") / F.first("b").over(by)).alias("b"))
    rows = both.withColumns({f"r{c}": div(c, F.lag(c).over(by)) - 1 for c in "ab"})
    corr = div(F.covar_samp("ra", "rb"), F.stddev_samp("ra") * F.stddev_samp("rb"))
    return rows.agg(F.count("*").alias("n_common"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_gap"), F.max_by(F.col("a") - F.col("b"), "d").alias("final_gap"), corr.alias("corr"))


def random_arms(spark: SparkSession, decisions: list[int], assets: list[str], k: int, seeds: list[int]) -> DataFrame:
    """For each seed and decision k assets drawn without replacement, in the universe's order; a seed's draws
    follow each other, so they are made where the decisions are named."""
    rows = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        for t in decisions:
            rows += [(f"random_{seed}", t, assets[i]) for i in sorted(rng.choice(len(assets), k, replace=False).tolist())]
    return spark.createDataFrame(rows, "arm string, t long, asset string")


def full_arm(decisions: DataFrame, assets: DataFrame, name: str = "full") -> DataFrame:
    """Every asset at every decision."""
    packed = assets.agg(F.array_sort(F.collect_set("asset")).alias("a"))
    return decisions.select("t").crossJoin(packed).select(F.lit(name).alias("arm"), "t", F.explode("a").alias("asset"))


def pair_correlation(chosen: DataFrame, correlation: DataFrame) -> DataFrame:
    """Per arm and decision mean and median correlation of the pairs of chosen assets (arm, t, asset); correlation
    is (t, a, b, corr)."""
    sets = chosen.groupBy("arm", "t").agg(F.array_sort(F.collect_set("asset")).alias("x"))
    pairs = sets.select("arm", "t", "x", F.posexplode("x").alias("i", "a")).select("arm", "t", "a", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("b"))
    both = pairs.join(correlation.select("t", "a", "b", "corr"), ["t", "a", "b"])
    return both.groupBy("arm", "t").agg(F.avg("corr").alias("mean_pair"), F.median("corr").alias("median_pair"), F.count("*").alias("pairs"))


def selection_structure(rows: DataFrame) -> DataFrame:
    """Per (experiment, phase) events, mean coverage, mean Jaccard similarity and the changes."""
    return rows.groupBy("experiment", "phase").agg(F.count("*").alias("events"), F.avg("objective").alias("coverage"), F.avg("jaccard").alias("mean_jaccard"), F.sum(F.coalesce("switched", F.lit(0))).cast("bigint").alias("changes"))


def due(decisions: DataFrame, every: int, key: str = "strategy") -> DataFrame:
    """Decisions (key, rn) at which a task that is done at most each `every` rows is done: the first, then each
    first decision at least `every` rows after the last time. One ordered fold per key; a key has as many rows
    as there are decisions."""
    packed = decisions.groupBy(key).agg(F.array_sort(F.collect_set(F.col("rn").cast("bigint"))).alias("x"))
    fold = f"aggregate(x, cast(array() as array<bigint>), (s, r) -> if(size(s) = 0 or r - element_at(s, -1) >= {every}, concat(s, array(r)), s))"
    return packed.select(key, F.explode(F.expr(fold)).alias("rn"))


def in_force(decisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each decision (rn) the newest selection (t, members) made by then: both lie in one order and the last
    selection is carried along."""
    left = chosen.select(F.col("t").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.struct("t", "members").alias("sel"))
    right = decisions.select(F.col("rn").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["sel"].dataType).alias("sel"))
    upto = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumn("sel", F.last("sel", ignorenulls=True).over(upto))
    return rows.filter("kind = 1").select(F.col("at").alias("rn"), F.col("sel.t").alias("selected_at"), F.col("sel.members").alias("members"))


def active_assets(force: DataFrame, assets: list[str], always: list[str]) -> DataFrame:
    """Per decision the members in force with what is always held, first mention first, of the panel's assets
    alone; all of them where nothing was selected yet. One row for each, with its place."""
    every = F.array(*[F.lit(a) for a in assets])
    wanted = F.array_distinct(F.concat("members", F.array(*[F.lit(a) for a in always])))
    mine = F.when(F.col("members").isNull(), every).otherwise(F.filter(wanted, lambda x: F.array_contains(every, x)))
    return force.select("rn", F.posexplode(mine).alias("place", "asset"))
