"""Shared pieces of the training-data operators: table access, bounded batches, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: A written table has a file for every few shuffle partitions, but so many for each core at least, and so many that
#: none is of more of the plan's input than this.
PARTITIONS_PER_FILE, FILES_PER_CORE, INPUT_PER_FILE = 4, 12, 128 << 20

_U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all runs on
    one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def written(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Cuts lineage: the rows go to a Parquet table in the shared folder and are read from there. light: rows
    of a few numbers, for which a file for each core is enough."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cores, partitions = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(cores, partitions // 32) if light else max(FILES_PER_CORE * cores, partitions // PARTITIONS_PER_FILE)
    files = max(files, min(input_bytes(df) // (INPUT_PER_FILE * (8 if light else 1)), 1 << 20))
    df.coalesce(files).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more, such as the last round's of a loop."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """For rows that several steps read and that follow from their input alone: computed once and held on
    the executors' disks; what goes with a lost executor is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the named string or binary column of each holds about max_bytes at
    most (a single longer value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def flat_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one uint8 array and its offsets (rows + 1); null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 arrays (the public SplitMix64 constants)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False)


class RollingHash:
    """Hashes of any byte range of a flat array in O(1) from prefix sums modulo 2**64: the sum of
    table[byte] * base**position, brought back to position 0 by the inverse power of the odd base."""

    def __init__(self, seed: int):
        self.table = seeded(256, seed)
        self.base = int(seeded(1, seed + 1)[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, _U64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, _U64)
        size = 1
        while size < n:
            step = min(size, n - size)
            out[size : size + step] = out[:step] * _U64(pow(base, size, 2**64))
            size += step
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = self._powers(self.base, n + 1), self._powers(self.inverse, n + 1)
        out = np.zeros(n + 1, _U64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all windows of k bytes."""
        n = len(prefix) - k
        return mix64((prefix[k:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, _U64)


class SequenceHash(RollingHash):
    """The same over sequences of 64-bit hashes, such as of words or lines."""

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.table = mix64(data.view(np.uint64))
        return super().prefix(np.arange(len(data)))
