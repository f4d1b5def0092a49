"""Inputs of a served model: moments, training matrix with times of knowledge, checks of its temporal contract,
panel checks, results' checks, validity of bundles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import serving_features
from .stats import covariance

FEATURES = ["return_1", "momentum_5", "momentum_20", "volatility_20"]


def moments(returns: DataFrame, lookback: int = 252) -> DataFrame:
    """Mean returns and covariances (a, b, mean, cov, n) of the last `lookback` returns (asset, rn, r)."""
    last = Window.partitionBy("asset").orderBy(F.desc("rn"))
    rows = returns.filter("r is not null").withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= lookback).select(F.lit(0).cast("bigint").alias("t"), "asset", "rn", "r")
    mean = rows.groupBy(F.col("asset").alias("a")).agg(F.avg("r").alias("mean"))
    return covariance(rows).join(mean, "a").select("a", "b", "mean", "cov", "n")


def condition(moment_rows: DataFrame) -> DataFrame:
    """Rank and condition number of the covariance of one universe."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cov").to_numpy()
        c = float(np.linalg.cond(m))
        return pd.DataFrame({"assets": [len(m)], "rank": [int(np.linalg.matrix_rank(m))], "condition": [c if np.isfinite(c) else None]})

    return moment_rows.groupBy(F.lit(0)).applyInPandas(run, "assets long, rank long, condition double")


def known_upto(rows: DataFrame, known: str = "known_at") -> Column:
    """The latest time of knowledge of a row or any before it."""
    return F.max(known).over(Window.partitionBy("asset").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))


def training_rows(panel: DataFrame, cutoff: Column) -> DataFrame:
    """From (asset, d, rn, px, known_at): the four features of each row from the 21st on, the next row's return,
    its day, and by when features and label were known; labels up to the cutoff."""
    by = Window.partitionBy("asset").orderBy("rn")
    feats = serving_features(panel).join(panel.select("asset", "rn", "px", "known_at"), ["asset", "rn"])
    rows = feats.withColumn("feature_known_at", known_upto(feats))
    rows = rows.select("asset", "rn", "d", *FEATURES, "feature_known_at", (F.lead("px").over(by) / F.col("px") - 1).alias("target"), F.lead("d").over(by).alias("label_d"), F.lead("feature_known_at").over(by).alias("label_known_at"))
    return rows.filter((F.col("rn") >= 21) & (F.col("label_d") <= cutoff))


def contract_violations(rows: DataFrame, training_cutoff: Column, knowledge_cutoff: Column) -> DataFrame:
    """Counts of training rows that break each rule of the temporal contract."""
    rules = {
        "label_before_feature": F.col("label_d") <= F.col("d"), "label_after_cutoff": F.col("label_d") > training_cutoff,
        "label_known_first": F.col("label_known_at") < F.col("feature_known_at"), "known_after_cutoff": F.col("label_known_at") > knowledge_cutoff,
        "feature_known_before_its_day": F.col("feature_known_at").cast("date") < F.col("d"), "label_known_before_its_day": F.col("label_known_at").cast("date") < F.col("label_d"),
        "missing_feature": F.greatest(*[F.col(c).isNull() for c in FEATURES]),
    }
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()])


def panel_violations(snap: DataFrame, assets: int, as_of: Column, max_age_days: int, least_returns: int) -> DataFrame:
    """Per asset of a snapshot (asset, observation_date, price, provider, price_basis, available_at) the broken
    rules: not aligned with the sessions of all, mixed conventions, later than the moment, stale, gapped, short."""
    sessions = snap.groupBy("observation_date").agg(F.count_distinct("asset").alias("k")).agg(F.count("*").alias("sessions"))
    gap = F.date_diff("observation_date", F.lag("observation_date").over(Window.partitionBy("asset").orderBy("observation_date")))
    rows = snap.withColumn("_gap", gap).groupBy("asset").agg(
        F.count_distinct("observation_date").alias("n"), F.count_distinct(F.struct("provider", F.coalesce("price_basis", F.lit("")))).alias("conventions"),
        F.count_if(F.col("available_at") > as_of).alias("late"), F.max("observation_date").alias("last"), F.max("_gap").alias("gap"), F.count_if(F.col("price").isNull() | (F.col("price") <= 0)).alias("bad"),
    )
    rules = [
        ("UNALIGNED", F.col("n") != F.col("sessions")), ("MIXED_CONVENTION", F.col("conventions") > 1), ("LATE", F.col("late") > 0), ("INVALID_PRICE", F.col("bad") > 0),
        ("STALE", F.date_diff(as_of.cast("date"), F.col("last")) > max_age_days), ("GAP", F.col("gap") > max(1, max_age_days)), ("SHORT", F.col("n") - 1 < least_returns),
    ]
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(c)) for c, bad in rules]))
    return rows.crossJoin(F.broadcast(sessions)).select("asset", "n", F.explode(codes).alias("code"))


def valid_until(now: Column, last_session: Column, max_age_days: int) -> Column:
    """The earlier of a day from now and the end of the last day on which the data are fresh enough."""
    end = F.date_add(last_session, max_age_days + 1).cast("timestamp") - F.expr("interval 1 microsecond")
    return F.least(now + F.expr("interval 24 hours"), end)


def result_violations(weights: DataFrame, defensive: list[str], cap: float, floor: float, other_cap: float, slack: float = 1e-7) -> DataFrame:
    """Per (strategy, rn) the first broken rule of a weight vector, or OK."""
    w, safe = F.col("w"), F.col("asset").isin(defensive)
    rows = weights.groupBy("strategy", "rn").agg(
        F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == F.lit(float("inf"))) | (w < -slack) | (w > cap + slack)).alias("bad"), F.sum(w).alias("total"), F.sum(F.when(safe, w).otherwise(0.0)).alias("mass"),
    )
    code = F.when(F.col("bad") > 0, "INVALID_WEIGHT").when(F.abs(F.col("total") - 1) > slack, "INVALID_SUM").when((F.col("mass") + slack < floor) | (1 - F.col("mass") > other_cap + slack), "GROUP_LIMIT").otherwise("OK")
    return rows.select("strategy", "rn", code.alias("code"))
