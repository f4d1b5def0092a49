"""Centroid clustering over subvector dictionaries, in exact integers.

Vectors are scaled to integers and cut into chunks of CHUNK. A chunk is stored encoded without loss: its
dimensions are cut into blocks of one width, each block has a dictionary of its distinct subvectors, and a
vector is a row of codes. The width doubles as long as that makes a round cheaper (fewer codes for each
vector against more distinct subvectors), so chunks of copies get wide blocks. In a round a chunk computes the
squared distance of each distinct subvector to each centroid once and sums them by code; the sums of a
cluster's components come from the counts of the codes. A task sends one row for each cluster, so a round
shuffles tasks times clusters rows whatever the number of vectors, and the driver sees only the centroids.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones
are not kept; nor are those with a component of RANGE or more in size, whose squared distances would not fit
64 bits; a null vec_id is clustered but never starts a cluster; rows that repeat a vec_id are vectors of
their own; with fewer vectors than clusters there are as many clusters as vectors; a vector as near to
several centroids goes to the smallest number; a cluster without vectors keeps its centroid; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIM, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
RANGE = 2.0**17  # scaled components stay below 2**27, so squared distances below 2**62
CHUNK = 4096
CHUNKS = "ids array<long>, width int, sizes array<int>, dictionary binary, codes binary"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """vec_id and integer components x of the vectors that are kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr(f"size(v) = {dim} and forall(v, c -> c is not null and not isnan(c) and abs(c) < {RANGE}D)")
    return rows.filter(F.col("v").isNotNull()).filter(fine).select("vec_id", F.expr(f"transform(v, c -> cast(floor({SCALE}D * c) as int))").alias("x"))


def encoded(m: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Block width, and for each block its distinct subvectors and the rows' codes. Codes of twice the width
    come from pairs of codes."""
    n, dim = m.shape
    first, codes = [], []
    for j in range(dim):
        _, at, code = np.unique(m[:, j], return_index=True, return_inverse=True)
        first.append(at)
        codes.append(code)
    width = 1
    while len(codes) % 2 == 0:
        pairs = [np.unique(a * len(f) + b, return_index=True, return_inverse=True)[1:] for a, b, f in zip(codes[::2], codes[1::2], first[1::2], strict=True)]
        if sum(len(at) for at, _ in pairs) * width * 2 + n * len(pairs) >= sum(map(len, first)) * width + n * len(codes):
            break
        first, codes, width = [at for at, _ in pairs], [code for _, code in pairs], width * 2
    return width, [m[at, b * width : (b + 1) * width] for b, at in enumerate(first)], codes


def _chunked(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some = batch.slice(a, CHUNK)
                m = np.asarray(some.column(1).flatten()).reshape(-1, dim)
                width, subvectors, codes = encoded(m)
                row = [some.column(0).to_pylist()], [width], [[len(s) for s in subvectors]], [b"".join(s.tobytes() for s in subvectors)], [np.stack(codes).astype(np.uint16).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["ids", "width", "sizes", "dictionary", "codes"])

    return run


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """ids, the blocks' subvectors, and codes (blocks x rows) of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, width, sizes, dictionary, codes = (batch.column(c)[i] for c in range(5))
            flat = np.frombuffer(dictionary.as_py(), np.int32).reshape(-1, width.as_py()).astype(np.int64)
            parts = np.split(flat, np.cumsum(sizes.as_py())[:-1])
            yield ids.values, parts, np.frombuffer(codes.as_py(), np.uint16).reshape(len(parts), -1).astype(np.int64)


def nearest(parts: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of a chunk."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for sub, code in zip(parts, codes, strict=True):
        apart = sub[:, None, :] - centroids[None, :, at : at + sub.shape[1]]
        total += (apart * apart).sum(axis=2)[code]
        at += sub.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each cluster the number of a task's vectors and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros_like(centroids)
        for _, parts, codes in _decoded(batches):
            cluster, _ = nearest(parts, codes, centroids)
            n += np.bincount(cluster, minlength=k)
            at = 0
            for sub, code in zip(parts, codes, strict=True):
                often = np.bincount(code * k + cluster, minlength=len(sub) * k).reshape(-1, k)
                sums[:, at : at + sub.shape[1]] += often.T @ sub
                at += sub.shape[1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts, codes in _decoded(batches):
            cluster, distance = nearest(parts, codes, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept. The clusters
    start at the vectors whose ids have the smallest hashes with the seed."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, dim)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.filter("vec_id is not null").select(hashed.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = np.array([s.x for s in starts], np.int64)
    chunks = written(rows.mapInArrow(_chunked(dim), CHUNKS), "vector-chunks")
    for _ in range(rounds):
        sums = chunks.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
        sums = sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        before, centroids = centroids, centroids.copy()
        for c in sums:
            centroids[c.cluster, c.i] = int(c.s) // c.n
        if (centroids == before).all():
            break  # nothing moves any more
    out = written(chunks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, whole, digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
