"""Near-duplicate vectors by sorted projection passes.

In a pass every vector gets BITS random hashes (the sides of random planes it lies on), and the vectors of a
label and length are ordered by them lexicographically. Vectors at a small angle mostly agree in the first
hashes and so stand near each other. The order is cut into blocks of BLOCK, and each vector is compared, in
double precision, with all of its own block and of the next one: a window of BLOCK neighbours at least. A
label of up to two blocks is covered by one window, so one pass finds all of its links; a larger one gets
passes by its size, more for each doubling, since in a dense label more hashes are needed to tell neighbours
apart. A vector carries its blocks of all passes, so a pair is counted only in the first pass whose window
holds it and no pairs are written out: a window gives each vector its number of new links and one edge to
what it is united with. The edges of all passes are united into components.

The work grows with the vectors times BLOCK times the passes. A run of more vectors than a window that all
lie closer to each other than the links' angle stays one component, but its n_links count those found.

Equal vectors of one label are one vector with a count from the start. Places in the order come from ranges
of it and the counts before them, so no label is sorted by one task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing; vectors of different length link with nothing; a null vec_id is never
a component; repeated rows count as vectors of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

COSINE = 0.98
BLOCK = 4096
BITS = 62
PASSES, PASSES_EACH_DOUBLING = 4, 2
TILE = 256


def unit(vector: list[float]) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def passes(size: F.Column) -> F.Column:
    """Passes for a label of so many vectors."""
    doublings = F.ceil(F.log2(size / (2 * BLOCK)))
    return F.when(size <= 2 * BLOCK, F.lit(1)).otherwise(PASSES + PASSES_EACH_DOUBLING * doublings).cast("int")


@lru_cache(8)
def planes(dim: int, count: int) -> np.ndarray:
    """dim x (count * BITS) random directions."""
    return np.concatenate([np.random.Generator(np.random.PCG64([dim, p])).normal(size=(dim, BITS)) for p in range(count)], axis=1)


def signatures(m: np.ndarray, count: int) -> np.ndarray:
    """The hashes of each row in each pass as one integer, first hash highest."""
    sides = (m @ planes(m.shape[1], count) > 0).reshape(len(m), count, BITS)
    out = np.zeros((len(m), count), np.int64)
    for j in range(BITS):
        out = out * 2 + sides[:, :, j]
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [unit(v) for v in batch.column(5).to_pylist()]
        count, dim = np.asarray(batch.column(4)), np.array([len(v) for v in vectors])
        signs = [np.zeros(0, np.int64)] * len(vectors)
        for c, d in sorted(set(zip(count.tolist(), dim.tolist(), strict=True))):
            at = np.flatnonzero((count == c) & (dim == d))
            for i, s in zip(at, signatures(np.stack([vectors[i] for i in at]), c), strict=True):
                signs[i] = s
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["label", "dim", "id", "copies", "unit", "signs"])


def blocks_of(vectors: DataFrame) -> DataFrame:
    """label, dim, id and its block in each pass: ranks inside ranges of the order, and before them the counts of the
    label's earlier ranges."""
    each = vectors.select("label", "dim", "id", F.posexplode("signs").alias("pass", "sign"))
    ranged = written(each.repartitionByRange("pass", "label", "dim", "sign", "id").withColumn("part", F.spark_partition_id()), "vector-order")
    counts = ranged.groupBy("pass", "label", "dim", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pass", "label", "dim").orderBy("part")) - F.col("n")
    counts = counts.select("pass", "label", "dim", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("pass", "label", "dim", "part").orderBy("sign", "id")) - 1
    placed = ranged.withColumn("rank", rank).join(counts, ["pass", "label", "dim", "part"])
    placed = placed.select("label", "dim", "id", F.struct("pass", F.expr(f"(before + rank) div {BLOCK}").alias("block")).alias("at"))
    return placed.groupBy("label", "dim", "id").agg(F.sort_array(F.collect_list("at")).alias("at")).select("label", "dim", "id", F.col("at.block").alias("blocks"))


def _linked(m: np.ndarray, copies: np.ndarray, blocks: np.ndarray, number: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the copies of others that it is linked with and that no earlier pass had in a window
    with it, and the first vector it is united with. The first `own` vectors are the window's block, which
    are compared with each other and with the rest, the next block."""
    n, first = np.zeros(len(m), np.int64), np.arange(len(m))
    for a in range(0, own, TILE):
        b = min(a + TILE, own)
        link = m[a:b] @ m[a:].T >= COSINE
        link[:, : b - a] = np.triu(link[:, : b - a], 1)
        rows = np.flatnonzero(link.any(axis=1))
        if not len(rows):
            continue
        link = link[rows]
        for q in range(number):
            link &= np.abs(blocks[a + rows, q][:, None] - blocks[a:, q][None, :]) > 1
        n[a + rows] += link @ copies[a:]
        n[a:] += copies[a + rows] @ link
        for row, to in zip((a + rows).tolist(), link, strict=True):
            met = np.append(first[a:][to], first[row])
            if (met != met[0]).any():
                first[np.isin(first, met)] = met.min()
    return n, first


def _compared(key: tuple, table: pa.Table) -> pa.Table:
    """Links and edges of a window, or of many whole small labels."""
    number, out = key[0].as_py(), []
    t = table.sort_by([("label", "ascending"), ("dim", "ascending"), ("side", "ascending"), ("id", "ascending")])
    label, dim, ids, side, copies = (np.asarray(t.column(c)) for c in ("label", "dim", "id", "side", "copies"))
    units, blocks = t.column("unit").to_pylist(), t.column("blocks").to_pylist()
    cuts = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        own = int((side[a:b] == 0).sum())
        m = np.frombuffer(b"".join(units[a:b]), np.float64).reshape(b - a, -1)
        n, first = _linked(m, copies[a:b], np.array(blocks[a:b], np.int64).reshape(b - a, -1), number, own)
        some = np.flatnonzero(n)
        out.append((ids[a:b][some], n[some], ids[a:b][first[some]]))
    x, n, first = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table([pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], ["id", "n", "first"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    fine = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sound = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & fine)
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]  # 128 bits stand for a vector
    distinct = written(sound.select("vec_id", "label", "v", *key).groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct-vectors")

    groups = written(distinct.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("size")), "labels", light=True)
    lumps = -(-(groups.filter(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 1) // BLOCK)
    members = distinct.withColumn("dim", F.size("v")).join(groups, ["label", "dim"])
    members = members.select("label", "dim", "id", "copies", passes(F.col("size")).alias("passes"), "v")
    units = written(members.mapInArrow(_signed, "label long, dim int, id long, copies long, unit binary, signs array<long>"), "unit-vectors")
    dealt = units.drop("signs").join(blocks_of(units), ["label", "dim", "id"]).join(groups, ["label", "dim"])
    dealt = dealt.select("*", F.posexplode("blocks").alias("pass", "block"))
    windows = F.expr("if(block > 0, array(struct(block as window, 0 as side), struct(block - 1 as window, 1 as side)), array(struct(block as window, 0 as side)))")
    dealt = dealt.select("*", F.explode(windows).alias("w"))
    group = F.when(F.col("size") > BLOCK, F.xxhash64("label", "dim")).otherwise(F.pmod(F.xxhash64("label", "dim"), F.lit(lumps)))
    dealt = dealt.select("pass", (F.col("size") > BLOCK).alias("large"), group.alias("c"), "w.window", "w.side", "label", "dim", "id", "copies", "unit", "blocks")
    found = written(dealt.groupBy("pass", "large", "c", "window").applyInArrow(_compared, "id long, n long, first long"), "near-vectors")
    labels = components(found.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))

    known = distinct.join(labels, "id", "left").join(counts, "id", "left")
    known = known.select("label", "k1", "k2", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = known.withColumnsRenamed({"label": "known_label", "k1": "known_1", "k2": "known_2"})
    out = rows.select("vec_id", "label", *key, F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False)).alias("sound"))
    out = out.join(known, F.col("sound") & (F.col("label") == F.col("known_label")) & (F.col("k1") == F.col("known_1")) & (F.col("k2") == F.col("known_2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
