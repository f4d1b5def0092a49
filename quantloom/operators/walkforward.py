"""Learned views of a walk-forward: models that are fitted anew each RETRAIN rows on the members then in force and
score the members in force at each decision until the next fit.

At a decision (its row rn) prices up to the row before are known. A fit at u trains on rows whose label ends
at u - 1 - HORIZON at the latest, and its rows are split in time again, with the rows purged whose label
reaches the validation part. So no label and no scaler reaches past its decision. Fits are independent: each
(fit, member) or (fit, asset) is a group of its own with as many rows as sessions times members in force, and all fits of all
decisions run side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import experiments, ml
from .learners import BoostedTrees, Pairwise

RETRAIN, HORIZON, LEAST = 10, 5, 100
FEATURE_ROWS = {"ranking": 40, "absolute": 30}


def fit_turns(force: DataFrame, mode: str = "ranking") -> DataFrame:
    """(u, members): the decisions (rn, members in force) at which a model is fitted: the first with enough rows
    before it, then each first one at least RETRAIN rows after the last."""
    ready = force.filter(F.col("members").isNotNull() & (F.col("rn") - 1 - HORIZON > FEATURE_ROWS[mode] + HORIZON + LEAST))
    turns = experiments.due(ready.select(F.lit(mode).alias("strategy"), "rn"), RETRAIN)
    return turns.select("rn").join(force, "rn").select(F.col("rn").alias("u"), "members")


def training_rows(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """The labelled rows (asset, rn, label_rn, y, ...) that each fit u may use."""
    each = turns.select("u", F.explode("members").alias("asset"))
    return rows.filter("y is not null").join(each, "asset").filter(F.col("label_rn") <= F.col("u") - 1 - HORIZON)


def scoring_rows(rows: DataFrame, force: DataFrame, turns: DataFrame) -> DataFrame:
    """For each decision t with a model, u its newest fit, and the row before t of each member in force."""
    decisions = force.filter("members is not null").select("rn")
    model = experiments.in_force(decisions, turns.select(F.col("u").alias("t"), "members")).filter("selected_at is not null")
    asked = model.select("rn", F.col("selected_at").alias("u")).join(force, "rn").select("u", F.col("rn").alias("t"), F.explode("members").alias("asset"), (F.col("rn") - 1).alias("rn"))
    return rows.join(asked, ["asset", "rn"])


def audits(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Per fit and asset how many rows train, are purged and validate, and the last row a label of the fit uses."""
    split = ml.temporal_split(training_rows(rows, turns), keys=("u", "asset"))
    fold = [F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in ("train", "purged", "validation")]
    return split.groupBy("u", "asset").agg(*fold, F.max("label_rn").alias("last_label"), F.max(F.when(F.col("fold") == "train", F.col("label_rn"))).alias("last_fitted"), F.min(F.when(F.col("fold") == "validation", F.col("rn"))).alias("validation_from"))


def ranked(x: np.ndarray, grade: np.ndarray, rn: np.ndarray, label_rn: np.ndarray, new: np.ndarray, member: int, rounds: int = 200) -> np.ndarray:
    """Scores of new rows by one pairwise-boosted member: the first 80 % of the days train, without those whose label
    reaches the rest, on which it stops early."""
    days = np.unique(rn)
    if len(days) < 2:
        return np.zeros(len(new))
    start = days[min(int(len(days) * 0.8), len(days) - 1)]
    fit, held = (rn < start) & (label_rn < start), rn >= start
    loss = Pairwise(grade[held], rn[held]).loss if held.any() else None
    model = BoostedTrees(rounds, depth=4, rate=0.05, rows=0.8, patience=10, seed=42 + member)
    model.fit(x[fit], grade[fit], (x[held], grade[held]), Pairwise(grade[fit], rn[fit]).gradient, loss)
    return model.predict(new)


def ranking_scores(rows: DataFrame, force: DataFrame, turns: DataFrame, features: list[str], members: int = 5, rounds: int = 200) -> DataFrame:
    """(t, asset, score, std): mean and population deviation over the members of the model in force at t. Grades are
    the places of the labels among the fit's members of a day. Rows with a missing feature are left out."""
    by_day = Window.partitionBy("u", "rn").orderBy("y", "asset")
    columns = ["u", "t", "asset", "rn", "label_rn", "grade", *features]
    train = training_rows(rows, turns).dropna(subset=features).withColumn("t", F.lit(None).cast("long")).withColumn("grade", (F.row_number().over(by_day) - 1).cast("double"))
    new = scoring_rows(rows, force, turns).dropna(subset=features).withColumn("grade", F.lit(None).cast("double"))
    both = train.select(*columns).unionByName(new.select(*columns)).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rn", "asset", "t"])
        old, ask = pdf[pdf["grade"].notna()], pdf[pdf["grade"].isna()]
        if not len(old) or not len(ask):
            return pd.DataFrame({"t": [], "asset": [], "score": []}, dtype=object)
        x, z = old[features].to_numpy(float), ask[features].to_numpy(float)
        score = ranked(x, old["grade"].to_numpy(float), old["rn"].to_numpy(), old["label_rn"].to_numpy(), z, int(pdf["member"].iloc[0]), rounds)
        return pd.DataFrame({"t": ask["t"].astype("int64").to_numpy(), "asset": ask["asset"].to_numpy(), "score": score})

    scores = both.groupBy("u", "member").applyInPandas(run, "t long, asset string, score double")
    return scores.groupBy("t", "asset").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("std"))


def absolute_forecasts(rows: DataFrame, force: DataFrame, turns: DataFrame, features: list[str], members: int = 5, rounds: int = 200) -> DataFrame:
    """(t, asset, pred, std, n_train, trees) of each member in force at t by the asset's newest ensemble. An asset that was
    not in force at the fit has no model and gives none."""
    columns = ["u", "asset", "rn", "fold", "y", *features]
    train = ml.temporal_split(training_rows(rows, turns), keys=("u", "asset")).select(*columns)
    asked = scoring_rows(rows, force, turns)
    new = asked.withColumn("fold", F.lit("latest")).withColumn("y", F.lit(None).cast("double")).select(*columns)
    out = ml.ensemble_forecasts(train.unionByName(new), features, members, LEAST, rounds, keys=("u", "asset"))
    return out.select((F.col("rn") + 1).alias("t"), "asset", "pred", "std", "n_train", "trees")


def cold_starts(panel: DataFrame, force: DataFrame, turns: DataFrame, back: int = 20) -> DataFrame:
    """(t, asset, first, last): prices `back` rows before t and on the row before it, of the members in force at decisions
    before the first fit."""
    before = turns.agg(F.min("u").alias("start"))
    early = force.filter("members is not null").join(F.broadcast(before)).filter("start is null or rn < start")  # one row
    asked = early.select(F.col("rn").alias("t"), F.explode("members").alias("asset"))
    px = panel.select("asset", "rn", "px")
    first = px.select("asset", (F.col("rn") + back).alias("t"), F.col("px").alias("first"))
    last = px.select("asset", (F.col("rn") + 1).alias("t"), F.col("px").alias("last"))
    return asked.join(first, ["asset", "t"]).join(last, ["asset", "t"])
