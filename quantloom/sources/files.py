"""File sources and sinks with explicit schemas; bad values become null, never errors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import grouped_integer, parsed_date
from ..operators.panel import series

PHASES = {"train": ("2020-01-01", "2023-10-01"), "test": ("2023-10-01", "2026-07-01"), "full": ("2020-01-01", "2026-07-01")}


def asset_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def resolved(config: dict, selection: list[str] | None = None) -> dict[str, dict]:
    """The chosen assets' entries; ValueError for none, unknown names or missing keys."""
    names = selection or config.get("default_selection") or list(config["assets"])
    unknown = [n for n in names if n not in config["assets"]]
    if not names or unknown:
        raise ValueError(f"unknown assets: {unknown}" if unknown else "empty selection")
    for n in names:
        lost = {"full_path", "date_col", "price_col"} - set(config["assets"][n])
        if lost:
            raise ValueError(f"{n} lacks {sorted(lost)}")
    return {n: config["assets"][n] for n in names}


def period(phase: str, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    return (start, end) if start and end else PHASES[phase]


def read_series(spark: SparkSession, paths: list[str], asset: str, schema: str, date_col: str = "date", price_col: str = "close", start: str | None = None, end: str | None = None) -> DataFrame:
    """One asset's clean series from CSV files; later files and lines win over earlier ones."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8").select(
            F.lit(asset).alias("asset"), parsed_date(date_col, "yyyy-MM-dd", "dd/MM/yyyy").alias("d"), F.col(price_col).cast("double").alias("px"),
            F.struct(F.lit(i).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ordinal"),
        )
        out = rows if out is None else out.unionByName(rows)
    return series(out, start, end).drop("ordinal")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("ticker")).filter("ticker <> ''")


def fund_prices(rows: DataFrame) -> DataFrame:
    """NAV in thousands, two places."""
    return rows.withColumn("price", F.round(F.col("nav") / 1000, 2))


GOLD_JSON = "array<struct<name:string,gold_type:array<struct<name:string,buy:string,sell:string>>>>"


def gold_quotes(raw: DataFrame, city: str = "TPHCM") -> DataFrame:
    """(d, json) to (d, pnj_buy, pnj_sell, sjc_buy, sjc_sell) of one city; an exact PNJ name is preferred to
    one that contains it; SJC must be exact."""
    types = raw.select("d", F.explode(F.from_json("json", GOLD_JSON)).alias("place")).filter(F.col("place.name") == city).select("d", F.explode("place.gold_type").alias("g"))
    rows = types.select("d", F.upper(F.trim("g.name")).alias("name"), grouped_integer("g.buy").alias("buy"), grouped_integer("g.sell").alias("sell"))
    rank = F.when(F.col("name") == "PNJ", 0).when(F.col("name").contains("PNJ"), 1)
    exact = F.col("name") == "SJC"

    def first(c: str, order, where):
        return F.min_by(c, F.when(where & F.col(c).isNotNull(), order))

    return rows.withColumn("_r", rank).groupBy("d").agg(*[first(c, F.col("_r"), F.col("_r").isNotNull()).alias(f"pnj_{c}") for c in ("buy", "sell")], *[first(c, F.lit(0), exact).alias(f"sjc_{c}") for c in ("buy", "sell")])


def write_splits(rows: DataFrame, path: str, split: str) -> None:
    """Full, train and test sets; the boundary day is in both parts."""
    day = F.lit(split).cast("date")
    for name, part in (("full", rows), ("train", rows.filter(F.col("d") <= day)), ("test", rows.filter(F.col("d") >= day))):
        part.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{path}/{name}")


def weights_log(weights: DataFrame) -> DataFrame:
    """Per strategy and row the weights of 1e-6 and more as JSON, largest first, six places."""
    one = F.struct((-F.col("w")).alias("n"), "asset", F.round("w", 6).alias("w"))
    packed = weights.filter("w >= 1e-6").groupBy("strategy", "rn").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return packed.select("strategy", "rn", F.to_json(F.map_from_arrays("x.asset", "x.w")).alias("weights"))


def ohlcv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.OHLCV)
