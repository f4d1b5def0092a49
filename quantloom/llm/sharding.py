"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A node with k leaves is split at the weighted median (weight: bytes) that gives k // 2 leaves to the left,
along its widest dimension: the one of length, source, language, content hash whose range in the node is
the largest share of its range over all documents. Medians of all nodes of a level are found together by
narrowing histograms: bytes are summed by bin, the bin that holds the median is cut into bins again, and
ties of the value are split by content hash. A node is named by its first leaf, so the leaves are the shards
and the tree never comes to the driver.

Equal texts have equal metadata: source and language of a group of copies are those of its row with the
smallest doc_id. So a group goes to one shard, its border to the nearer side. Only a group that holds more
than 1 / TOGETHER of a shard, and that a border falls in, is split there by doc_id: for so large a group
equal texts in one shard and shards of near equal size exclude each other.

Law `bytes`: the shards' sizes are near equal; a split stops when the undecided bin holds less than
1 / SLACK of a shard.

Defined cases: a null text has size 1 and checksum 0; null source and lang count as code -1, a null doc_id
sorts first and is kept; repeated rows are separate rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

BINS = 4096
SLACK = 1000
TOGETHER = 100
DIMENSIONS = ("size", "source_code", "lang_code", "text_crc32")


def metadata(docs: DataFrame) -> DataFrame:
    def code(c: str):
        return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("long")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        code("source").alias("source_code"),
        code("lang").alias("lang_code"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("place"),
    )
    rows = written(rows, "shard-metadata")
    copies = rows.groupBy("size", "text_crc32", "text_hash").agg(F.count("*").alias("n"), F.min(F.struct("place", "source_code", "lang_code")).alias("first")).filter("n > 1")
    copies = written(copies.select("size", "text_crc32", "text_hash", "first.source_code", "first.lang_code").withColumnsRenamed({"source_code": "s", "lang_code": "l"}), "shard-copies", light=True)
    out = rows.join(copies, ["size", "text_crc32", "text_hash"], "left")
    return out.select("doc_id", "size", "text_crc32", F.coalesce("s", "source_code").alias("source_code"), F.coalesce("l", "lang_code").alias("lang_code"), "place")


def _first_state(rows: DataFrame, whole) -> DataFrame:
    """A row for each node that is still to be split: the dimension, what the left side must hold, and
    the range [lo, hi) where the border is."""
    mins, maxs = [F.min(c).alias(f"min_{c}") for c in DIMENSIONS], [F.max(c).alias(f"max_{c}") for c in DIMENSIONS]
    stats = rows.filter("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("total"), *mins, *maxs)
    widths = [((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.lit(float(max(1, whole[f"max_{c}"] - whole[f"min_{c}"])))).alias(c) for c in DIMENSIONS]
    widest = F.greatest(*widths)
    dim, lo, hi = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i in reversed(range(len(DIMENSIONS))):
        here, c = widths[i] == widest, DIMENSIONS[i]
        dim, lo, hi = F.when(here, F.lit(i)).otherwise(dim), F.when(here, F.col(f"min_{c}")).otherwise(lo), F.when(here, F.col(f"max_{c}") + 1).otherwise(hi)
    none = F.lit(None).cast("long")
    left = F.expr("leaves div 2")
    return stats.select(
        "node", dim.alias("dim"), F.lit(0).alias("stage"), lo.alias("lo"), hi.alias("hi"), F.floor(F.col("total") / F.col("leaves") * left).cast("long").alias("need"),
        none.alias("t0"), none.alias("t1"), none.alias("t2"), F.lit(False).alias("done"),
    )


def _values(rows: DataFrame) -> DataFrame:
    value = F.col(DIMENSIONS[-1])
    for i in reversed(range(len(DIMENSIONS) - 1)):
        value = F.when(F.col("dim") == i, F.col(DIMENSIONS[i])).otherwise(value)
    return rows.withColumn("v0", value).withColumn("v1", F.col("text_crc32")).withColumn("v2", F.col("place"))


def _narrowed(rows: DataFrame, state: DataFrame, slack: int, together: int, whole) -> DataFrame:
    """One step for all nodes that are not done. A content hash that holds no more than `together` bytes is not
    split."""
    open_ = state.filter("not done").withColumn("step", F.expr(f"(hi - lo + {BINS - 1}) div {BINS}"))
    here = _values(rows.select("node", "place", *DIMENSIONS).join(open_, "node"))
    here = here.withColumn("v", F.expr("case stage when 0 then v0 when 1 then v1 else v2 end"))
    here = here.filter("v >= lo and v < hi and (stage < 1 or v0 = t0) and (stage < 2 or v1 = t1)")
    keys = [*state.columns, "step"]
    bins = here.groupBy(*keys, F.expr("(v - lo) div step").alias("bin")).agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    hit = bins.withColumn("upto", upto).filter("upto - w <= need and need < upto")
    hit = hit.withColumn("need", F.expr("need - (upto - w)")).withColumn("lo", F.expr("lo + bin * step")).withColumn("hi", F.expr("least(hi, lo + step)"))
    last = f"(w <= {slack} or (hi - lo = 1 and (stage = 2 or stage = 1 and w <= {together})))"
    border = "if(need * 2 >= w, hi, lo)"
    down = f"(hi - lo = 1 and not {last})"
    new = hit.selectExpr(
        "node", "dim", f"if({down}, stage + 1, stage) as stage",
        f"case when not {down} then lo when stage = 0 then {whole['min_text_crc32']}L else {whole['min_place']}L end as lo",
        f"case when not {down} then hi when stage = 0 then {whole['max_text_crc32'] + 1}L else {whole['max_place'] + 1}L end as hi",
        "need",
        f"case when stage > 0 then t0 when {last} then {border} when {down} then lo end as t0",
        f"case when stage <> 1 then t1 when {last} then {border} when {down} then lo end as t1",
        f"case when stage = 2 and {last} then {border} else t2 end as t2",
        f"{last} as done",
    )
    return state.filter("done").unionByName(new)


def _children(rows: DataFrame, state: DataFrame) -> DataFrame:
    cut = _values(rows.join(state.select("node", "dim", "t0", "t1", "t2"), "node", "left"))
    left = F.expr("v0 < t0 or (v0 = t0 and t1 is not null and (v1 < t1 or (v1 = t1 and t2 is not null and v2 < t2)))")
    to_left = F.expr("leaves div 2")
    return cut.select(
        *[c for c in rows.columns if c not in ("node", "leaves")],
        F.when(F.col("t0").isNull() | left, F.col("node")).otherwise(F.col("node") + to_left).cast("int").alias("node"),
        F.when(F.col("t0").isNull(), F.col("leaves")).when(left, to_left).otherwise(F.col("leaves") - to_left).cast("int").alias("leaves"),
    )


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard; as many shards as named, or as target_bytes asks for."""
    table = rows = written(metadata(docs), "shard-rows")
    columns = ["place", *DIMENSIONS]
    whole = rows.agg(F.sum("size").alias("total"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]).first()
    if whole["total"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    leaves = shards or max(1, -(-whole["total"] // target_bytes))
    slack, together = (max(1, whole["total"] // (leaves * x)) for x in (SLACK, TOGETHER))
    rows = rows.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(leaves))
    for _ in range((leaves - 1).bit_length()):
        state = written(_first_state(rows, whole), "shard-splits", light=True)
        while not state.filter("not done").isEmpty():
            before, state = state, written(_narrowed(rows, state, slack, together, whole), "shard-splits", light=True)
            discard(before)
        before, rows = table, written(_children(rows, state), "shard-rows")
        table = rows
        discard(before)
        discard(state)
    return rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard by doc_id: ranks inside ranges of (shard, doc_id), and
    before them the counts of the shard's earlier ranges."""
    ranged = written(rows.repartitionByRange("shard", "doc_id").withColumn("part", F.spark_partition_id()), "shard-ranges")
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return ranged.withColumn("rank", rank).join(first, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("rank")).drop("part", "rank", "first")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    rows = with_slots(kd_shards(docs, shards))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
