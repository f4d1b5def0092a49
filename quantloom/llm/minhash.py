"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles (64-bit hashes). Its sketch has COORDINATES
bins: in each of the first rounds every shingle falls into a hashed bin with a hashed value that is
larger the later the round, in the rounds after that all shingles fall into one given bin, so after twice
as many rounds as bins every bin is full, and mostly after few. Two sketches agree in a bin with the sets'
Jaccard similarity, with the concentration of independent samples. BANDS bands of ROWS bins are the keys
by which documents meet: at 0.85 a pair misses all of them with probability 4.3e-7, at 0.80 with 4.9e-5.

Documents with the same set are one (their smallest doc_id). In a bucket every member is compared with one
pivot, not with every other. Buckets whose members are not in one component then are compared across
components, in cells of two blocks of BLOCK members that carry their sets, so a large bucket is spread and
only links come out. There a pair is looked at if its sketches agree in AGREE coordinates, which a link
fails far less often than the bands. Every link is confirmed on the full sets.

Defined cases: words are split at ASCII white space, A-Z lower-cased; fewer than five words are one
shingle; a document without words has an empty set and is linked with nothing; a row without a doc_id is
linked with nothing and has a null component; rows that share a doc_id are one document in the links and
stay separate rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, flat_bytes, held, mix64, seeded, slices, unused, written
from .components import components

WORDS = 5
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
BLOCK = 256
CELLS, CELL_BYTES = 4096, 32 << 20  # cells that small buckets share: so many at least, and so many bytes in each
AGREE = 82  # of 125 coordinates; at 0.85 fewer agree with probability 1.9e-8, at 0.80 fewer than 75 with 8.6e-8

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD_HASH = RollingHash(11)
ROUND_SEEDS = seeded(2 * COORDINATES, 12)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all documents, flat, and their offsets (documents + 1)."""
    word = ~SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[off] = True
    begin = np.flatnonzero(word & (border[:-1] | ~np.append(False, word[:-1])))
    end = np.flatnonzero(word & (border[1:] | ~np.append(word[1:], False))) + 1
    prefix = WORD_HASH.prefix(LOWER[raw])
    hashes = WORD_HASH.ranges(prefix, begin, end) + (end - begin).astype(np.uint64)
    return hashes, np.searchsorted(begin, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and their offsets (documents + 1)."""
    n = len(off) - 1
    hashes, first = words_of(raw, off)
    count = np.diff(first)
    flat, doc = [], []
    whole = len(hashes) - WORDS + 1
    if whole > 0:
        start = np.arange(whole)
        own = np.repeat(np.arange(n), count)
        start = start[own[:whole] == own[WORDS - 1 :]]
        flat.append(_combined(hashes, start, WORDS))
        doc.append(own[start])
    for k in range(1, WORDS):
        few = np.flatnonzero(count == k)
        flat.append(_combined(hashes, first[few], k))
        doc.append(few)
    flat, doc = np.concatenate(flat), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    flat, doc = flat[order], doc[order]
    ends = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new], np.append(0, np.cumsum(new))[ends]


def _combined(hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(start), k, np.uint64)
    for j in range(k):
        out = mix64(out * STEP + hashes[start + j])
    return out


def sketches(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """documents x COORDINATES values; rows of empty sets keep the largest value everywhere."""
    n, t = len(off) - 1, COORDINATES
    out = np.full(n * t, np.iinfo(np.uint64).max)
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    for r in range(2 * t):
        open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1) & (size > 0)
        if not open_.any():
            break
        here = open_[doc]
        flat, doc = flat[here], doc[here]
        x = mix64(flat ^ ROUND_SEEDS[r])
        bins = ((x >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if r < t else r - t
        np.minimum.at(out, doc * t + bins, (np.uint64(r) << np.uint64(48)) | (mix64(x) >> np.uint64(16)))
    return out.reshape(n, t)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketch), BANDS), np.uint64)
    for j in range(ROWS):
        out = mix64(out * STEP + sketch[:, j::ROWS])
    return out.view(np.int64)


SKETCHED = "doc_id long, n_shingles long, set_key binary, bands array<long>, marks array<byte>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        flat, off = shingle_sets(*flat_bytes(batch))
        sketch = sketches(flat, off)
        n = batch.num_rows
        keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
        marks = mix64(sketch).astype(np.uint8).view(np.int8)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(off)),
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands_of(sketch).ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES), pa.array(marks.ravel())),
            ],
            ["doc_id", "n_shingles", "set_key", "bands", "marks"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        flat, off = shingle_sets(*flat_bytes(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["doc_id", "hashes"])


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets of hashes reach the similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(similar(x.as_py(), y.as_py(), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = held(texts.mapInArrow(_sketch, SKETCHED))
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "bands", "marks")).alias("first")  # by doc_id; rows that share it are equal
    reps = held(named.groupBy("set_key").agg(first).select("set_key", "first.*"))
    groups = reps.select("set_key", F.col("doc_id").alias("rep"))

    keys = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    full = keys.groupBy("band", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high")
    members = written(keys.join(full, ["band", "key"]), "bucket-members")
    sets = held(texts.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, hashes binary"))

    tested = members.filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = components(linked(tested, sets, percent))
    apart = _apart(members, labels)
    if not apart.isEmpty():
        full = apart.join(reps.drop("set_key"), "doc_id")
        weight = full.filter(F.col("size") <= BLOCK).agg(F.sum(8 * (F.col("n_shingles") + BANDS) + COORDINATES)).first()[0] or 0
        cells = _cells(full.join(sets, "doc_id"), max(CELLS, weight // CELL_BYTES))
        further = components(cells.groupBy("cell", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct())
        labels = written(further_labels(labels, further), "labels", light=True)
    for x in (apart, sets):
        x.unpersist()

    of_set = groups.join(labels, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    of_set = written(of_set, "set-components")  # so that the join below can split a set that very many documents have
    out = rows.join(of_set, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def further_labels(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels of ids after their components have been united: further has a label of united components,
    some of which are ids without a label of their own."""
    up = further.select(F.col("id").alias("component"), F.col("component").alias("upper"))
    out = labels.join(up, "component", "left").select("id", F.coalesce("upper", "component").alias("component"))
    return out.unionByName(further.join(labels, "id", "left_anti").select("id", "component"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with the size of their bucket, of the buckets that still hold more than one component."""
    known = members.join(labels, F.col("doc_id") == F.col("id"), "left").select("band", "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = known.groupBy("band", "key").agg(F.min("component").alias("first"), F.max("component").alias("other"), F.count("*").alias("size")).filter("first <> other")
    return held(known.join(mixed.select("band", "key", "size"), ["band", "key"]))


def _cells(apart: DataFrame, shared: int) -> DataFrame:
    """A row for each cell of a member: its bucket's pairs of blocks that hold it; small buckets stay whole
    and share so many cells."""
    out = apart.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    out = out.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    own = F.xxhash64("band", "key")
    cell = F.when(F.col("blocks") > 1, own).otherwise(F.pmod(own, F.lit(shared)))
    return out.select(
        cell.alias("cell"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("right"),
        "band", "key", "doc_id", "component", "n_shingles", "bands", "marks", "hashes",
    )


def _across(percent: int):
    """Components (two in a row) that are linked in a cell's buckets. A pair is looked at in the first band where
    it meets, if its sizes allow the similarity and its sketches agree often enough; pairs that links of the
    cell have joined already are left out."""
    least = int(AGREE - COORDINATES * max(0, 85 - percent) / 100)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("band", "ascending"), ("key", "ascending"), ("doc_id", "ascending")])
        band, keys, ids, size, right = (np.asarray(t.column(c)) for c in ("band", "key", "doc_id", "n_shingles", "right"))
        component, blobs = t.column("component").to_pylist(), t.column("hashes")
        bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        marks = np.asarray(t.column("marks").combine_chunks().flatten()).reshape(-1, COORDINATES)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        out = []
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (band[1:] != band[:-1])))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            two = right[a:b].any()
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                if two:
                    ok &= right[j] != right[i]
                j = j[ok]
                j = j[(marks[j] == marks[i]).sum(axis=1) >= least]
                j = j[~(bands[j, : band[i]] == bands[i, : band[i]]).any(axis=1)]
                for k in j.tolist():
                    x, y = top(component[i]), top(component[k])
                    if x != y and similar(blobs[i].as_py(), blobs[k].as_py(), percent):
                        above[max(x, y)] = min(x, y)
                        out.append((component[i], component[k]))
        first, second = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    return run


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that are not the first of their component."""
    name = unused("_gone_id", docs.columns)
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
