"""Learners around the price panel: one regressor for each asset, a pooled boosted model for serving, audits of
fits, served views, and a registry of saved models."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .learners import BoostedTrees

MIN_ROWS, MIN_VALID = 85, 50


def complete_days(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows of the days that have every asset, with their place in the day by name."""
    whole = Window.partitionBy("d")
    k = assets.select("asset").distinct().agg(F.count("*").alias("_k"))
    out = rows.withColumn("_n", F.count("*").over(whole)).join(F.broadcast(k)).filter("_n = _k").drop("_n", "_k")
    return out.withColumn("place", F.row_number().over(whole.orderBy("asset")).cast("bigint"))


def audit(rows: DataFrame) -> DataFrame:
    """Per asset of split rows (fold, d, label_d): how many rows train, from when to when, the last day that a
    label of theirs uses, and where validation starts."""
    train = F.col("fold") == "train"
    return rows.groupBy("asset").agg(
        F.count_if(train).alias("n_train"), F.min(F.when(train, F.col("d"))).alias("train_from"), F.max(F.when(train, F.col("d"))).alias("train_to"),
        F.max(F.when(train, F.col("label_d"))).alias("last_label"), F.min(F.when(F.col("fold") == "validation", F.col("d"))).alias("validation_from"),
    )


def single_forecasts(rows: DataFrame, features: list[str], rounds: int = 200) -> DataFrame:
    """Per asset one regressor over its labelled rows and its forecast for the last of them; none for an asset
    with too few rows. An asset's history is one group: it has as many rows as there are sessions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows_ = pdf.sort_values("rn")
        valid = rows_.dropna(subset=[*features, "y"])
        if len(rows_) < MIN_ROWS or len(valid) < MIN_VALID:
            return pd.DataFrame({"asset": [], "rn": [], "pred": [], "n_train": []}, dtype=object)
        x = valid[features].to_numpy(float)
        model = BoostedTrees(rounds, seed=42).fit(x[:-1], valid["y"].to_numpy(float)[:-1])
        return pd.DataFrame({"asset": [valid["asset"].iloc[0]], "rn": [int(valid["rn"].iloc[-1])], "pred": [float(model.predict(x[-1:])[0])], "n_train": [len(valid) - 1]})

    return rows.groupBy("asset").applyInPandas(run, "asset string, rn long, pred double, n_train long")


def pooled_model(rows: DataFrame, features: list[str], part: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """A boosted model of all assets' rows (d, features, target) up to the day that ends the first part of the
    days, and the later rows with its predictions. Trees grow on Spark's own histograms."""
    days = rows.select("d").distinct()
    cut = days.agg(F.percentile(F.unix_date("d").cast("double"), F.lit(part)).alias("cut"))
    both = rows.join(F.broadcast(cut)).withColumn("_first", F.unix_date("d") <= F.col("cut")).drop("cut")
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), GBTRegressor(featuresCol="x", labelCol="target", maxDepth=2, stepSize=0.1, maxIter=20, seed=42)]
    model = Pipeline(stages=steps).fit(both.filter("_first").drop("_first"))
    return model, model.transform(both.filter("not _first").drop("_first"))


def pooled_errors(scored: DataFrame) -> DataFrame:
    e = F.col("target") - F.col("prediction")
    return scored.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def evaluator(metric: str = "rmse") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol="target", predictionCol="prediction", metricName=metric)


def served_views(model: PipelineModel, newest: DataFrame, features: list[str], confidence: float = 0.5) -> DataFrame:
    """Per asset of the newest row one view: its own leg, the prediction as daily q, a fixed confidence. Rows with
    a missing feature give none."""
    out = model.transform(newest.dropna(subset=features))
    return out.select("asset", "rn", F.create_map(F.col("asset"), F.lit(1.0)).alias("legs"), F.col("prediction").alias("q_daily"), F.lit(confidence).alias("confidence"), vector_to_array("x").alias("features"))


# ------------------------------------------------------------------ registry

REGISTRY = "model_id string, path string, status string, training_cutoff date, rmse double, sha256 string, at timestamp"


def model_hash(spark: SparkSession, path: str) -> str:
    """Digest of all files of a saved model, by name and content. Hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*?/(?=(metadata|stages)/)", "")
    each = files.select(F.concat_ws(":", name, F.sha2("content", 256)).alias("f"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256)).first()[0]


def register(spark: SparkSession, registry: str, root: str, model_id: str, model: PipelineModel, training_cutoff: str, rmse: float) -> None:
    """Saves a model, which may not exist yet, and notes it as a candidate."""
    path = f"{root}/{model_id}"
    model.write().save(path)
    _note(spark, registry, model_id, path, "CANDIDATE", training_cutoff, rmse, model_hash(spark, path))


def approve(spark: SparkSession, registry: str, model_id: str) -> None:
    row = status(spark, registry).filter(F.col("model_id") == model_id).first()
    if row is None or row["status"] != "CANDIDATE":
        raise ValueError(f"{model_id} is no candidate")
    _note(spark, registry, model_id, row["path"], "APPROVED", str(row["training_cutoff"]), row["rmse"], row["sha256"])


def _note(spark: SparkSession, registry: str, model_id: str, path: str, status_: str, training_cutoff: str, rmse: float, sha256: str) -> None:
    one = spark.createDataFrame([(model_id, path, status_, training_cutoff, float(rmse), sha256)], "model_id string, path string, status string, training_cutoff string, rmse double, sha256 string")
    one.select("model_id", "path", "status", F.col("training_cutoff").cast("date").alias("training_cutoff"), "rmse", "sha256", F.current_timestamp().alias("at")).write.mode("append").parquet(registry)


def status(spark: SparkSession, registry: str) -> DataFrame:
    """The newest note of each model."""
    newest = Window.partitionBy("model_id").orderBy(F.desc("at"))
    return spark.read.schema(REGISTRY).parquet(registry).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def load(spark: SparkSession, registry: str, model_id: str) -> PipelineModel:
    """An approved model, if its files are those that were registered."""
    row = status(spark, registry).filter((F.col("model_id") == model_id) & (F.col("status") == "APPROVED")).first()
    if row is None:
        raise ValueError(f"{model_id} is not approved")
    if model_hash(spark, row["path"]) != row["sha256"]:
        raise ValueError(f"{model_id} was changed")
    return PipelineModel.load(row["path"])
