"""Incremental merges of a table that is kept in phases (train, test, full), each with a coverage of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _phases(spark: SparkSession, extends: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(list(extends.items()), "phase string, extends boolean")


def coverage(saved: DataFrame, key: str = "d") -> DataFrame:
    """First and last day and the number of rows of each phase."""
    return saved.groupBy("phase").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n_saved"))


def clipped(saved: DataFrame, new: DataFrame, extends: dict[str, bool], key: str = "d") -> DataFrame:
    """The new rows that each phase takes: none before its first day, and after its last day only where it extends.
    There are as many phases as named, so they are broadcast."""
    known = coverage(saved, key).join(_phases(saved.sparkSession, extends), "phase")
    rows = new.filter(F.col(key).isNotNull()).crossJoin(F.broadcast(known.select("phase", "first", "last", "extends")))
    return rows.filter((F.col(key) >= F.col("first")) & (F.col("extends") | (F.col(key) <= F.col("last")))).drop("first", "last", "extends")


def merged(saved: DataFrame, new: DataFrame, extends: dict[str, bool], columns: list[str], key: str = "d") -> DataFrame:
    """Each phase with the new rows of its coverage: per day and column the new value, or the saved one where the new is
    null, then the last known value along the phase. Of new rows of one day the last by values counts."""
    both = saved.select("phase", key, *columns, F.lit(0).alias("_s")).unionByName(clipped(saved, new, extends, key).select("phase", key, *columns, F.lit(1).alias("_s")))
    one = both.groupBy("phase", key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("_s", c))).getField(c).alias(c) for c in columns])
    upto = Window.partitionBy("phase").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.select("phase", key, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])


def notes(saved: DataFrame, new: DataFrame, extends: dict[str, bool], key: str = "d") -> DataFrame:
    """What an update does to each phase: rows taken, rows before the whole dataset (ignored), rows after a closed phase
    (refused), days left open between its last day and the first new one, and a status."""
    known = coverage(saved, key).join(_phases(saved.sparkSession, extends), "phase")
    start = saved.agg(F.min(key).alias("start"))
    day = F.col(key)

    def count(what: Column) -> Column:
        return F.count_if(F.coalesce(what, F.lit(False)))

    days = new.filter(day.isNotNull()).select(key).distinct()
    taken = (day >= F.col("first")) & (F.col("extends") | (day <= F.col("last")))
    met = days.crossJoin(F.broadcast(known.select("phase", "first", "last", "extends").crossJoin(start))).groupBy("phase").agg(
        count(taken).alias("n_taken"), count(day < F.col("start")).alias("n_before"), count(~F.col("extends") & (day > F.col("last"))).alias("n_refused"),
        F.min(F.when(taken, day)).alias("from_"), count(taken & (day > F.col("last"))).alias("n_extending"),
    )
    out = known.select("phase", "last", "n_saved").join(met, "phase", "left").na.fill(0, ["n_taken", "n_before", "n_refused", "n_extending"])
    gap = F.greatest(F.datediff("from_", "last") - 1, F.lit(0))
    status = F.when(F.col("n_taken") == 0, "skipped").when(F.col("n_extending") > 0, "extended").otherwise("refreshed")
    return out.select("phase", "n_saved", "n_taken", "n_before", "n_refused", F.when(F.col("n_taken") > 0, gap).otherwise(0).cast("int").alias("gap_days"), status.alias("status"))


def update(spark: SparkSession, path: str, new: DataFrame, extends: dict[str, bool], columns: list[str], key: str = "d") -> DataFrame:
    """Merges new rows into the table at the path, which is partitioned by phase. Only partitions that take rows are written
    again; the others keep their files. Returns the notes of the update."""
    saved = spark.read.parquet(path)
    said = notes(saved, new, extends, key).collect()  # a row for each phase
    due = [r.phase for r in said if r.n_taken]
    if due:
        some = saved.filter(F.col("phase").isin(due))
        out = merged(some, new, {p: extends[p] for p in due}, columns, key)
        out.repartition("phase").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase").parquet(path)
    return spark.createDataFrame([tuple(r) for r in said], "phase string, n_saved long, n_taken long, n_before long, n_refused long, gap_days int, status string")
