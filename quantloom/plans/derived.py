"""Price panels, bars and ledgers derived from the star schema: a brand is an asset, the volume-weighted
price of a week or a day, damped to a tenth of its logarithm so that returns have the size of market
returns, is its price."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import returns
from ..operators.panel import price_panel
from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price(amount, quantity):
    return 100 * F.pow(amount / quantity, F.lit(0.1))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    return lines.join(parts, "l_partkey")


def held(df: DataFrame) -> DataFrame:
    """For small aggregates that one query reads many times: computed once, in memory or on executors' disks.
    An equal plan finds the same rows again; clearCache() lets them go."""
    return df if df.storageLevel.useDisk else df.persist(StorageLevel.MEMORY_AND_DISK)


def settled(df: DataFrame) -> DataFrame:
    """Computed now and read again from a table in the shared folder: for steps of a long chain. Held rows keep their whole
    plan, which doubles with each step that reads them twice; a table's plan is one scan, with its true size."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prices(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The one scan of the trades that assets, calendar and prices of a panel share."""
    rows = trades(spark, sf_dir).groupBy("asset", F.date_trunc(unit, "l_shipdate").cast("date").alias("d"))
    return held(rows.agg(price(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("px")))


def market(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc(unit, "l_shipdate").cast("date").alias("d"))
    return rows.agg(price(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("px"))


def panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    raw = prices(spark, sf_dir, unit)
    return held(price_panel(raw, raw.select("d").distinct(), "legacy"))


def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(panel(spark, sf_dir)).withColumn("r", F.round("r", 10))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly open, high, low and close of the unit price, ordered by a full row key."""
    rows = trades(spark, sf_dir).select("asset", F.date_trunc("week", "l_shipdate").cast("date").alias("d"), price(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"))
    return rows.groupBy("asset", "d").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price observations: the user is the asset, the type the provider."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("asset"), F.col("ts").cast("date").alias("observation_date"), F.col("event_type").alias("provider"),
        F.round("value", 2).alias("price"), F.col("ts").alias("available_at"), "event_id",
    )
