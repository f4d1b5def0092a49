"""Price panels in long form: (asset, d, px, rn), rn the session's number from 1.

Calendars, gap filling, as-of values, duplicates and incremental merges. Every operator takes and
returns DataFrames and shuffles by asset or by day at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_asset():
    return Window.partitionBy("asset").orderBy("d")


def prefix():
    return by_asset().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays of the range, both ends included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return days.filter(F.dayofweek("d").between(2, 6))


def session_days(index: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct days on which the index was observed."""
    days = index.select("d").filter(F.col("d").isNotNull()).distinct()
    if start:
        days = days.filter(F.col("d") >= F.lit(start).cast("date"))
    return days.filter(F.col("d") <= F.lit(end).cast("date")) if end else days


def keep_last(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of rows with equal keys the last by the given order."""
    last = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def series(rows: DataFrame, start: str | None = None, end: str | None = None, order: str = "ordinal") -> DataFrame:
    """Clean price series: rows with a date and a price, inside the range, the last of each (asset, d) by
    ingest order."""
    out = rows.filter(F.col("d").isNotNull() & F.col("px").isNotNull())
    if start:
        out = out.filter(F.col("d") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("d") <= F.lit(end).cast("date"))
    return keep_last(out, ["asset", "d"], [order])


def filled(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each asset on each day of the calendar with its last known price; never filled backwards. The
    calendar is gathered into one array (days, not rows of data) and unfolded per asset."""
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("days"))
    grid = prices.select("asset").distinct().join(F.broadcast(days)).select("asset", F.explode("days").alias("d"))
    px = F.last("px", ignorenulls=True).over(prefix())
    return grid.join(prices.select("asset", "d", "px"), ["asset", "d"], "left").select("asset", "d", px.alias("px"))


def complete_days(rows: DataFrame) -> DataFrame:
    """Days on which every asset has a price, numbered per asset."""
    whole = Window.partitionBy("d")
    out = rows.withColumn("_all", F.count("*").over(whole)).withColumn("_known", F.count("px").over(whole)).filter("_all = _known").drop("_all", "_known")
    return out.withColumn("rn", F.row_number().over(by_asset()).cast("bigint"))


def price_panel(prices: DataFrame, calendar: DataFrame, mode: str = "audited") -> DataFrame:
    """legacy: observations off the calendar are lost before filling. audited: the union of both calendars
    is filled, then restricted to the calendar (an as-of join)."""
    if mode == "legacy":
        return complete_days(filled(prices, calendar))
    union = calendar.select("d").union(prices.select("d")).distinct()
    return complete_days(filled(prices, union).join(F.broadcast(calendar.select("d")), "d", "left_semi").select("asset", "d", "px"))


def best_so_far(rows: DataFrame, value: str, at: str, order: list[str], days: int = 30) -> DataFrame:
    """`value` of each row becomes the largest of the asset's rows up to it in the order, whose first column is the time
    `at`. An asset's rows lie in spans of so many days, each a group of its own; what the spans before bring in is
    a second, small pass over one row for each span. So a single asset spreads over tasks."""
    spans = rows.withColumn("_span", F.expr(f"unix_seconds(cast({at} as timestamp)) div {days * 86400}"))
    upto = Window.partitionBy("asset", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("asset").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = spans.groupBy("asset", "_span").agg(F.max(value).alias("_top")).select("asset", "_span", F.max("_top").over(before).alias("_carried"))
    out = spans.withColumn(value, F.max(value).over(upto)).join(tops, ["asset", "_span"])
    return out.withColumn(value, F.greatest(value, "_carried")).drop("_span", "_carried")


def asof(facts: DataFrame, moments: DataFrame, days: int = 30) -> DataFrame:
    """For each (asset, decision_at) the latest observation that was available by then: facts (asset,
    observed_at, available_at, px). An old observation that arrives late never replaces a newer one that
    was there. Both sides are laid in one order and the best so far is carried along: no theta join. Facts and moments
    without an asset or a time match nothing; such moments are left out."""
    best = F.struct("observed_at", "available_at", "px")
    left = facts.select("asset", F.col("available_at").alias("at"), F.lit(0).alias("kind"), best.alias("fact"), F.lit(None).cast("timestamp").alias("decision_at"))
    right = moments.select("asset", F.col("decision_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["fact"].dataType).alias("fact"), "decision_at")
    both = best_so_far(left.union(right).filter("asset is not null and at is not null"), "fact", "at", ["at", "kind"], days)
    return both.filter("kind = 1").select("asset", "decision_at", "fact.observed_at", "fact.available_at", "fact.px")


def sessions_after(days: DataFrame, n: int) -> DataFrame:
    """Each session (d) with the n-th one after it (later; null at the end)."""
    one = days.select("d").distinct()
    return one.withColumn("later", F.lead("d", n).over(Window.orderBy("d")))


def available_at(kind, observed, fifth_session=None, published=None) -> Column:
    """Stocks: the same day at 18:00. Gold: the next day at 00:00. Funds: the fifth session after it at
    18:00, or when the provider says, if later."""
    day = F.col(observed).cast("timestamp")
    fund = F.greatest(F.col(fifth_session).cast("timestamp") + F.expr("interval 18 hours"), F.col(published)) if fifth_session else None
    out = F.when(F.col(kind) == "stock", day + F.expr("interval 18 hours")).when(F.col(kind) == "gold", F.date_add(F.col(observed), 1).cast("timestamp"))
    return out.when(F.col(kind) == "fund", fund) if fund is not None else out


def merged(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key and column the new value, or the old one where the new is null; then the last known value
    along the key."""
    both = old.select(key, *columns, F.lit(0).alias("_s")).unionByName(new.select(key, *columns, F.lit(1).alias("_s")))
    one = both.groupBy(key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("_s", c))).getField(c).alias(c) for c in columns])
    upto = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.select(key, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])


def wide(panel: DataFrame, assets: list[str], value: str = "px") -> DataFrame:
    return panel.groupBy("d").pivot("asset", assets).agg(F.first(value))


def long(rows: DataFrame, assets: list[str], value: str = "px") -> DataFrame:
    return rows.unpivot(["d"], assets, "asset", value)
