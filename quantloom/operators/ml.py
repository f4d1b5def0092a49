"""Forecasting: temporal splits without label overlap, scalers, boosted trees per asset, ensembles and a
pairwise ranker. Learners are small and independent, so they run as grouped maps, one asset or one decision
to a group; everything around them is declarative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, div
from .learners import BoostedTrees, Pairwise

ML_FEATURES = ["momentum_5", "momentum_10", "momentum_20", "rsi", "ma_ratio", "vol_20", "macd_hist", "price_std_20"]


def by_row():
    return Window.partitionBy("asset").orderBy("rn")


def labelled(features: DataFrame, horizon: int = 5) -> DataFrame:
    """Adds the forward return `y` and the row where the label ends; rows without a label go."""
    rows = features.withColumn("y", div(F.lead("px", horizon).over(by_row()), "px") - 1).withColumn("label_rn", F.lead("rn", horizon).over(by_row()))
    return rows.filter("y is not null")


def temporal_split(rows: DataFrame, part: float = 0.8, purge: bool = True, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Adds `fold`: the first part of each asset's rows (or of those of other keys) trains, the rest validates;
    training rows whose label ends at the first validation row or later are purged."""
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_i", F.row_number().over(whole.orderBy("rn"))).withColumn("_n", F.floor(F.count("*").over(whole) * F.lit(part)))
    rows = rows.withColumn("_v", F.min(F.when(F.col("_i") > F.col("_n"), F.col("rn"))).over(whole))
    late = (F.col("label_rn") >= F.col("_v")) if purge else F.lit(False)
    return rows.withColumn("fold", F.when(F.col("_i") > F.col("_n"), "validation").when(late, "purged").otherwise("train")).drop("_i", "_n", "_v")


def scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """Per asset mean and population deviation of each column; a deviation of 0 counts as 1."""
    sd = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return train.groupBy("asset").agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_sd"))])


def ensemble_forecasts(rows: DataFrame, features: list[str], members: int = 5, least: int = 100, rounds: int = 200, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Per asset (or other keys) forecasts of the rows of fold `latest` by an ensemble trained on `fold` (train /
    validation): mean and population deviation of the members. Groups with fewer training rows give none."""
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn").dropna(subset=features)
        train, valid, last = (pdf[pdf["fold"] == f] for f in ("train", "validation", "latest"))
        empty = pd.DataFrame({c: [] for c in (*keys, "rn", "pred", "std", "n_train", "trees")}, dtype=object)
        if len(train) < least or not len(last):
            return empty
        x = train[features].to_numpy(float)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd == 0] = 1

        def scaled(d):
            return (d[features].to_numpy(float) - mean) / sd

        out, trees = [], 0
        for i in range(members):
            m = BoostedTrees(rounds, rows=0.8, columns=min(1.0, 0.7 + 0.05 * i), patience=10, seed=42 + i)
            m.fit(scaled(train), train["y"].to_numpy(float), (scaled(valid), valid["y"].to_numpy(float)))
            out.append(m.predict(scaled(last)))
            trees += len(m.trees)
        own = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame({**own, "rn": last["rn"].to_numpy(), "pred": np.mean(out, axis=0), "std": np.std(out, axis=0), "n_train": len(train), "trees": trees})

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", rn long, pred double, std double, n_train long, trees long"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def ranker_scores(rows: DataFrame, features: list[str], members: int = 5, rounds: int = 200) -> DataFrame:
    """Per decision t, from its training rows (t, d, asset, grade, features) and scoring rows (grade null):
    mean score and population deviation of pairwise-boosted members. Rows with a missing feature give none. Each
    member of each decision is a group of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=features)
        train, new = pdf[pdf["grade"].notna()], pdf[pdf["grade"].isna()]
        if train["d"].nunique() < 2 or len(new) < 2:
            return pd.DataFrame({"t": [], "asset": [], "score": []}, dtype=object)
        x, z = train[features].to_numpy(float), new[features].to_numpy(float)
        gradient = Pairwise(train["grade"].to_numpy(float), pd.factorize(train["d"])[0]).gradient
        model = BoostedTrees(rounds, depth=4, rate=0.05, rows=0.8, seed=42 + int(pdf["member"].iloc[0])).fit(x, train["grade"].to_numpy(float), gradient=gradient)
        return pd.DataFrame({"t": pdf["t"].iloc[0], "asset": new["asset"].to_numpy(), "score": model.predict(z)})

    each = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    scores = each.groupBy("t", "member").applyInPandas(run, "t long, asset string, score double")
    return scores.groupBy("t", "asset").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("std"))


def ensemble_confidence(std: str = "std"):
    return clip(0.70 - F.col(std) / 0.005, 0.25, 0.70)


def feature_confidence(columns: list[str]):
    """0.6 less five times the population variance of the row's features, between 0.3 and 0.9."""
    n = len(columns)
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / n
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in columns), F.lit(0.0)) / n
    return clip(0.6 - 5 * var, 0.3, 0.9)


def accuracy_penalty(graded: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """Per forecast (asset, rn, correct) a factor from the asset's last `window` results before it: accuracy
    under 0.40 scales confidence by accuracy / 0.40; fewer than `least` results leave it."""
    back = by_row().rowsBetween(-window, -1)
    acc, n = F.avg(F.col("correct").cast("double")).over(back), F.count("correct").over(back)
    return graded.withColumn("accuracy", F.when(n >= least, acc)).withColumn("factor", F.when((n >= least) & (acc < 0.40), acc / 0.40).otherwise(1.0))


def errors(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, RMSE and R2 per asset."""
    e = F.col(y) - F.col(pred)
    out = rows.groupBy("asset").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_s"), (F.var_pop(y) * F.count("*")).alias("_t"))
    return out.select("asset", "mae", "rmse", (1 - div("_s", "_t")).alias("r2"))
