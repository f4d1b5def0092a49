"""The corpus pipeline: documents to token ids, stage by stage. Each stage's result is written and read
again before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, linededup, minhash, mixing, quality
from quantloom.llm.common import read_table, written

#: SQL can express neither the classifier nor the sketches nor the merges; tests use brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, does not reject; all columns."""
    return quality.kept(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are aligned with an earlier document; one that loses all its
    text goes. n_chars follows the text."""
    out, removed = linededup.without_repeated_lines(docs), F.col(linededup.removed_name(docs))
    left = F.length(F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   "))) > 0
    out = out.filter((removed == 0) | left)
    if "n_chars" in docs.columns:
        chars = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8); all columns."""
    return minhash.deduplicated(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mixture's weights and order: a source's documents may come several times or in part, the
    epochs one after the other, each in its block permutation. The order is that of the rows, since the
    columns are those of documents."""
    epoch, order = mixing.used_names(docs)
    return mixing.mixed(docs).repartitionByRange(epoch, order).sortWithinPartitions(epoch, order).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each row."""
    return bpe.encoded(docs).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
