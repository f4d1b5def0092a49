"""Token-id output as ORC: whole texts as integer lists, stripe by stripe, in ascending doc_id order.

Rows are range-partitioned by doc_id and sorted, so each file holds one range of ids; ORC packs the ids
with its integer run-length encoding and keeps row indexes, column statistics and Bloom filters on
doc_id, by which a reader skips files, stripes and row groups. Large files are read by stripes in parallel.

Columns of a file: doc_id, shard (number of the range), row (place in the shard), tokens.

Defined cases: a null or empty text has only the end id; rows without a doc_id come first; rows that
repeat a doc_id stay, ordered by text; other columns are not read, so they cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PLAIN
from .common import shared_dir, slices, texts_of, written

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Entries of a generation of a worker's memory.
CACHED = 400_000
SLICE_BYTES = 4 << 20
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000

TOKENS = "doc_id long, shard int, row long, tokens array<int>"


#: The file's pattern for texts of PLAIN characters, which are lower-cased before it.
PIECES = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+""")


class WordCodec:
    """The tokenizers library over the pieces of its file's pattern. Pieces that the worker has not met are
    put to the library many at a time, between blanks, and told apart by the tokens that end a piece; ids of
    pieces, and of what stands between two blanks, come from a bounded memory of two generations: when the
    young one is full it becomes the old one, from which what is still in use comes back. Texts with other
    than plain characters, or with what may be a special token, are encoded by the library as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pieces(self, new: list[str]) -> None:
        for k in range(0, len(new), 500):
            some = new[k : k + 500]
            ids = self.library([" ".join(some)])[0]
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                data = ids.tobytes()
                at = [0, *(4 * stop).tolist()]
                self.known.update((w, data[a:b]) for w, a, b in zip(some, at[:-1], at[1:], strict=True))
            else:
                self.known.update((w, x.tobytes()) for w, x in zip(some, self.library(some), strict=True))

    def learn(self, new: set[str]) -> None:
        """What stands between blanks: mostly one piece of letters, or one and a mark behind it."""
        known, old = self.known, self.old
        back = new & old.keys()
        known.update((c, old[c]) for c in back)
        new = new - back
        single = {c for c in new if c.isalpha()}
        parts = [(c, [c[:-1], c[-1]] if c[-1] in ",." and c[:-1].isalpha() else PIECES.findall(c)) for c in new - single]
        want = single.union(*(p for _, p in parts)).difference(known)
        back = want & old.keys()
        known.update((c, old[c]) for c in back)
        self.learn_pieces(list(want - back))
        known.update((c, b"".join(map(known.__getitem__, p))) for c, p in parts)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, which are plain, in one array, and the number of each text's. What stands between
        blanks is told apart by Arrow, so the memory is asked once for each different word."""
        if len(self.known) > CACHED:
            self.known, self.old = {"": b""}, self.known
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        coded = parts.flatten().dictionary_encode()
        different, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(set(different).difference(self.known))
        found = list(map(self.known.__getitem__, different))
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids, begin = np.frombuffer(b"".join(found), "<i4"), np.cumsum(size) - size
        count = size[codes]
        end = np.append(0, np.cumsum(count))
        at = np.repeat((begin[codes] - end[:-1]).astype(np.int32), count) + np.arange(end[-1], dtype=np.int32)
        return ids[at], np.diff(end[parts.offsets.to_numpy()])

    def encode(self, texts: list[str], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, `end` behind each text's, and their offsets."""
        plain = np.array([not (PLAIN.search(t) or "<|" in t or "\u0130" in t) for t in texts], bool)
        count = np.zeros(len(texts), np.int64)
        own, count[plain] = self.words([t for t, p in zip(texts, plain, strict=True) if p])
        whole = self.library([t for t, p in zip(texts, plain, strict=True) if not p])
        count[~plain] = [len(x) for x in whole]
        size = count + len(end)
        stop = np.cumsum(size)
        flat = np.empty(int(size.sum()), "<i4")
        mine = np.repeat(plain, size)
        for k, e in enumerate(end):
            at = stop - len(end) + k
            flat[at], mine[at] = e, False
        flat[mine] = own
        for i, x in zip(np.flatnonzero(~plain).tolist(), whole, strict=True):
            flat[stop[i] - size[i] : stop[i] - len(end)] = x
        return flat, np.append(0, stop)


@lru_cache(2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END) -> None:
    tokenizer = tokenizer or public_tokenizers.path(VOCABULARY)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, off = codec(tokenizer).encode(texts_of(batch), [end_id])
            tokens = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + batch.num_rows)), tokens], ["doc_id", "row", "tokens"])
            row += batch.num_rows

    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = ranged.mapInArrow(run, "doc_id long, row long, tokens array<int>").select("doc_id", F.spark_partition_id().alias("shard"), "row", "tokens")
    (
        out.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        ends = np.asarray(tokens.offsets)
        flat = np.asarray(tokens.values).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' rows: sums of the shards, then running sums
    inside each shard."""
    rows = written(tokens.mapInArrow(_checksums, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long"), "token-rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    first = sums.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("first"))
    before = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("before", before).join(first, "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame) -> DataFrame:
    """Writes the token files of all documents to the shared folder and indexes what is read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return token_index(read_tokens(spark, path))
