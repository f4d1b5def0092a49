"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

One dictionary is trained on labelled good texts, one on bad ones. A text is compressed in blocks with
each; the difference of the two sizes over the text's length is the feature that tells the classes
apart, and how many times shorter the text gets without a dictionary, which is much for text that
repeats itself, is the second.
A logistic curve turns them into a score between 0 and 1 (higher: good likelier). It is fitted crosswise:
each of two folds of labelled rows gets its features from dictionaries of the other fold, so no row is
measured with a dictionary that holds it. The dictionaries in use are those of both folds together.

The labelled rows used are a bounded sample (SAMPLE of each class and fold, in hash order, texts up to
SAMPLE_BYTES); everything else reads every row and every whole text.

Defined cases: a null or empty text has the features 0 and so the curve's score there; repeated label rows
of a document count as their largest value; labels without a document or without a value are ignored;
with a class or all labels missing, the score is the share of good labels seen (0.5 with none); extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE = 2000
SAMPLE_BYTES = 1 << 16
DICTIONARY = 1 << 16
BLOCK = 1 << 12
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def features(self, texts: list[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.zeros((len(texts), 2))
        good, bad, plain = compressor(self.good), compressor(self.bad), zstandard.ZstdCompressor(level=LEVEL)
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            if t:
                blocks = [t[k : k + BLOCK] for k in range(0, len(t), BLOCK)]
                a, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
                out[i] = (b - a) / len(t), len(t) / sum(len(plain.compress(x)) for x in blocks)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.features(texts) @ np.array(self.weights[1:]), -700, 700)))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    blocks = [s[k : k + BLOCK] for s in samples for k in range(0, len(s), BLOCK)]
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" " * 8 + b"\n".join(samples)[-DICTIONARY:]


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """The two dictionaries. Lines that stand in texts of both classes, such as shared passages and notices,
    tell nothing of the class and are left out."""
    both = {x for t in good for x in t.split(b"\n")} & {x for t in bad for x in t.split(b"\n")}
    good, bad = ([b"\n".join(x for x in t.split(b"\n") if x not in both) for t in c] for c in (good, bad))
    return dictionary([t for t in good if t]), dictionary([t for t in bad if t])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method for intercept and slopes, with targets drawn in a little so that they stay finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return (float(np.log(p / (1 - p))), *(0.0 for _ in range(x.shape[1])))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.maximum(x.std(axis=0), 1e-9)
    m = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(m.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -700, 700)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(len(w)), m.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return (float(w[0]), *map(float, w[1:] / scale))


def fold(id_col: str = "doc_id") -> F.Column:
    """The labels' fold of a document: 0 and 2 fitted crosswise, 1 held out."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3).cast("int")


def sample_texts(docs: DataFrame, labels: DataFrame, want: int, quality: int, n: int) -> list[bytes]:
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = one.filter((fold() == want) & (F.col("quality") == quality)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    return [r.text.encode() for r in rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    texts = {(f, q): sample_texts(docs, labels, f, q, sample) for f in (0, 2) for q in (0, 1)}
    x, y = [np.zeros((0, 2))], [np.zeros(0)]
    for own, other in ((0, 2), (2, 0)):
        half = Model(*dictionaries(texts[own, 1], texts[own, 0]))
        for q in (0, 1):
            x.append(half.features(texts[other, q]))
            y.append(np.full(len(x[-1]), float(q)))
    model = Model(*dictionaries(texts[0, 1] + texts[2, 1], texts[0, 0] + texts[2, 0]))
    x, y = np.concatenate(x), np.concatenate(y)
    model.weights = logistic(x, y) if len(x) else model.weights
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. The texts are scored where they
    stand, so no join on ids is needed and repeated rows stay."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
