"""Suffix-array dedup of repeated byte strings over all texts.

A string of `length` bytes is repeated if it also starts anywhere else; every byte that a repeated string
covers is removed. The strings of a text are grouped by anchors: of the K-byte pieces of a string, the
leftmost with the smallest hash. Equal strings have equal anchors, so only strings with one anchor need be
compared, and most anchors occur once. The strings with one occurrence of an anchor follow each other; the
bytes they span are the anchor's context. Equal contexts are one, with a count.

The strings of a context are cut into ranges by their place relative to the anchor (STEPS[0] places each).
All strings of a range share a core, and equal strings have equal cores, so ranges meet by their core's
fingerprint, however often an anchor occurs: a core that comes once goes, ranges that are equal as a whole
are repeated as a whole. The rest, ranges of one core with different bytes around it, meet in buckets of
many cores; each bucket gets one suffix array (see grouping.py) in which the core is one symbol and equal
strings are neighbours. Ranges of a core that are too many for a bucket are cut into ranges of the next
step first, where the same holds; in ranges of one string the core is the whole string.

`in_passage` marks the texts that share a passage with another row, by winnowing of word sequences: a
passage of PASSAGE words is always found, one of fewer than GRAM words never.

Defined cases: lengths and strings are in UTF-8 bytes and may cut characters; a null text is empty; texts
shorter than `length` keep all bytes; copies of a text all lose their repeated strings; overlaps count;
repeated rows are texts of their own (for in_passage they are one); other columns are not read. The kept
bytes are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, SequenceHash, flat_bytes, held, slices, written
from .grouping import suffix_array
from .minhash import words_of

LENGTH = 400
K = 128
STEPS = (64, 8, 1)
BUCKET_BYTES = 1 << 17
PIECE = 1 << 24
PLACE_BITS = 25
PASSAGE, GRAM = 51, 31
PIECES = RollingHash(21)
WORDS = SequenceHash(27)
STRINGS = RollingHash(23), RollingHash(25)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each `width` values in a row, comparing their high bits."""
    n = len(values)
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    packed[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(down[:m], upto[width - 1 : width - 1 + m]) & low).astype(np.int64)


def anchors(raw: np.ndarray, off: np.ndarray, length: int, k: int = K, hashes: RollingHash = PIECES) -> tuple[np.ndarray, ...]:
    """For each anchor of each text: text number, hash, place, first and last start of its strings (places
    in the flat array)."""
    width = length - k + 1
    found = []
    last = off[1:] - length  # last start of each text
    for a in range(0, max(0, len(raw) - length + 1), PIECE):
        b = min(a + PIECE + length - 1, len(raw))
        values = hashes.windows(hashes.prefix(raw[a:b]), k)
        place = least_places(values, width)
        starts = np.arange(a, a + len(place))
        own = np.searchsorted(off, starts, side="right") - 1
        good = starts <= last[own]
        new = good.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~good[:-1] | (own[1:] != own[:-1])
        end = good.copy()
        end[:-1] &= (place[1:] != place[:-1]) | ~good[1:] | (own[1:] != own[:-1])
        s0, s1 = np.flatnonzero(new), np.flatnonzero(end)
        found.append((own[s0], values[place[s0]].view(np.int64), place[s0] + a, s0 + a, s1 + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


CONTEXTS = "doc_id long, row_key long, anchor long, context long, s0 int, s1 int, place int"


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, off = flat_bytes(batch)
            own, key, place, s0, s1 = anchors(raw, off, length)
            data = raw.tobytes()
            digest = [hashlib.blake2b(data[a : b + length], digest_size=8, salt=int(p - a).to_bytes(4, "little")).digest() for p, a, b in zip(place.tolist(), s0.tolist(), s1.tolist(), strict=True)]
            context = np.frombuffer(b"".join(digest), np.int64)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(context), pa.array((s0 - off[own]).astype(np.int32)), pa.array((s1 - off[own]).astype(np.int32)), pa.array((place - s0).astype(np.int32))],
                ["doc_id", "row_key", "anchor", "context", "s0", "s1", "place"],
            )

    return run


def _cut(length: int):
    """Rows of (text, contexts wanted of it) to rows of (anchor, context, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(0).to_pylist()
            rows = [(w["anchor"], w["context"], w["place"], t[w["s0"] : w["s1"] + length]) for t, ws in zip((x.encode() for x in texts), batch.column(1).to_pylist(), strict=True) for w in ws]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["a", "c", "place", "bytes"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return int(other.argmax()) if other.any() else n


def cores(keys: list[int], contexts: list[np.ndarray], places: list[int]) -> list[tuple[int, int]]:
    """For each context the range around its place that all contexts of its key have in common."""
    first: dict[int, int] = {}
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    for i, (k, c, p) in enumerate(zip(keys, contexts, places, strict=True)):
        j = first.setdefault(k, i)
        d, q = contexts[j], places[j]
        left[k] = min(left.get(k, p), common(c[:p][::-1], d[:q][::-1]))
        right[k] = min(right.get(k, len(c) - p), common(c[p:], d[q:]))
    return [(p - left[k], p + right[k]) for k, p in zip(keys, places, strict=True)]


def repeated_starts(keys: list[int], contexts: list[bytes], places: list[int], length: int) -> list[np.ndarray]:
    """For each context (distinct within its key, place: where the key's bytes are) whether the string at
    each of its starts is also in another context."""
    raw = [np.frombuffer(c, np.uint8) for c in contexts]
    core = cores(keys, raw, places)
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    symbols, begin, middle, n = [], [], [], 0
    for k, c, (c0, c1) in zip(keys, raw, core, strict=True):
        symbols += [c[:c0].astype(np.int64) + 1, [257 + number[k]], c[c1:].astype(np.int64) + 1, [0]]
        begin.append(n)
        middle.append(n + c0)
        n += len(c) - (c1 - c0) + 2
    order = suffix_array(np.concatenate(symbols))
    owner = np.repeat(np.arange(len(raw)), np.diff([*begin, n]))
    begin, middle = np.array(begin), np.array(middle)
    starts = np.array([len(c) - length + 1 for c in raw])
    hits = [np.zeros(s, bool) for s in starts]

    own = owner[order]
    at = order - begin[own]
    before = (order < middle[own]) & (at < starts[own])  # strings that begin before the core
    own, at = own[before], at[before]
    whole = np.frombuffer(b"".join(contexts), np.uint8)
    place = np.cumsum([0, *map(len, raw)])[own] + at
    same = np.ones(max(0, len(own) - 1), bool)
    for h in STRINGS:
        value = h.ranges(h.prefix(whole), place, place + length)
        same &= value[1:] == value[:-1]
    for i in np.flatnonzero(np.append(same, False) | np.append(False, same)):
        hits[own[i]][at[i]] = True

    inside = order[order == middle[owner[order]]]  # one suffix stands for all that begin in the core
    own = owner[inside].tolist()
    behind = [0] * len(raw)
    for i, j in zip(own[:-1], own[1:], strict=True):
        if keys[i] == keys[j]:
            more = common(raw[i][core[i][1] :], raw[j][core[j][1] :])
            behind[i], behind[j] = max(behind[i], more), max(behind[j], more)
    several = Counter(keys)
    for i, (c0, c1) in enumerate(core):
        if several[keys[i]] > 1:
            hits[i][c0 : max(c0, min(c1, c1 - length + behind[i] + 1))] = True
    return hits


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


SPANS = "anchor long, context long, r0 int, r1 int"


def _bucket(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        one = {(a, c): (p, b) for a, c, p, b in zip(*(table.column(x).to_pylist() for x in ("a", "c", "place", "bytes")), strict=True)}
        keys = sorted(one)
        hits = repeated_starts([k[0] for k in keys], [one[k][1] for k in keys], [one[k][0] for k in keys], length)
        spans = [(*k, a, b) for k, hit in zip(keys, hits, strict=True) for a, b in runs(hit)]
        cols = list(zip(*spans, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["a", "c", "r0", "r1"])

    return run


def _ranges(length: int, step: int):
    """Rows of (a, c, place, bytes) to the ranges of their strings: starts p0 to p1, fingerprints of the bytes
    that all strings of such a range share and of all its bytes."""

    def fingerprint(data: bytes, *numbers: int) -> bytes:
        return hashlib.blake2b(data, digest_size=8, salt=b"".join(n.to_bytes(4, "little") for n in numbers)).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, firsts, lasts, prints = [], [], [], []
            for i, (place, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                last = len(data) - length
                for q in range((place - last) // step, place // step + 1):
                    at = place - q * step
                    p0, p1 = max(0, at - step + 1), min(last, at)
                    own.append(i)
                    firsts.append(p0)
                    lasts.append(p1)
                    prints += fingerprint(data[at : at - step + 1 + length], q), fingerprint(data[p0 : p1 + length], q, place - p0)
            both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            rows = batch.select([0, 1, 2]).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "c", "place", "p0", "p1", "core", "kind"])

    return run


def repeated_spans(items: DataFrame, length: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """a, c, r0, r1: runs of starts whose strings are also in another of the items (a, c, place, bytes), which
    are distinct by (a, c) and hold an anchor at their place."""
    ranges = held(items.select("a", "c", "place", "bytes").mapInArrow(_ranges(length, steps[0]), "a long, c long, place int, p0 int, p1 int, core long, kind long"))
    kinds = ranges.groupBy("core", "kind").agg(F.count("*").alias("n"), F.min(F.struct("a", "c", "place", "p0", "p1")).alias("at"))
    kinds = written(kinds.select("core", "kind", "n", "at.*"), "range-kinds")
    equal = written(kinds.filter("n > 1").select("core", "kind"), "equal-ranges")
    spans = ranges.join(equal, ["core", "kind"], "left_semi").select("a", "c", F.col("p0").alias("r0"), F.col("p1").alias("r1"))
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.sum(F.col("p1") - F.col("p0") + length).alias("size")).filter("kinds > 1")
    cores = written(cores.select("core", "size"), "mixed-cores")
    mixed = kinds.join(cores, "core").join(items.select("a", "c", "bytes"), ["a", "c"])
    mixed = mixed.select(F.col("core").alias("a"), F.col("kind").alias("c"), (F.col("place") - F.col("p0")).alias("place"), F.expr(f"substring(bytes, p0 + 1, p1 - p0 + {length})").alias("bytes"), "size")
    mixed = written(mixed, "mixed-ranges")
    few = mixed.filter(F.col("size") <= BUCKET_BYTES)
    total = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    few = few.withColumn("bucket", F.pmod("a", F.lit(max(1, 2 * total // BUCKET_BYTES))))
    within = few.groupBy("bucket").applyInArrow(_bucket(length), "a long, c long, r0 int, r1 int")
    many = mixed.filter(F.col("size") > BUCKET_BYTES)
    if len(steps) > 1 and not many.isEmpty():
        within = within.unionByName(repeated_spans(many, length, steps[1:]))
    within = written(within.withColumnsRenamed({"a": "core", "c": "kind"}), "range-spans")
    return spans.unionByName(ranges.join(within, ["core", "kind"]).select("a", "c", (F.col("p0") + F.col("r0")).alias("r0"), (F.col("p0") + F.col("r1")).alias("r1")))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, off = words_of(*flat_bytes(batch))
        own, key, *_ = anchors(hashes, off, PASSAGE, GRAM, WORDS)
        order = np.lexsort([key, own])
        own, key = own[order], key[order]
        new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))[: len(own)]
        at = pa.array(own[new])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key[new])], ["doc_id", "row_key", "gram"])


def in_passages(texts: DataFrame) -> DataFrame:
    """doc_id and row_key of the texts (doc_id, row_key, text) that share a passage with another."""
    grams = held(texts.select("doc_id", "row_key", "text").mapInArrow(_grams, "doc_id long, row_key long, gram long"))
    shared = grams.groupBy("gram").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high")).filter("low <> high")
    shared = written(shared.select("gram"), "shared-grams")
    marked = written(grams.join(shared, "gram", "left_semi").select("doc_id", "row_key").distinct(), "in-passages", light=True)
    grams.unpersist()
    return marked


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, at, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                data = (text or "").encode()
                if not a:
                    rows.append((len(data), 0, 0, data))
                    continue
                gone = np.zeros(len(data) + 1, np.int32)
                size = [len(x) for x in a]
                base = np.repeat(np.array(at), size)
                np.add.at(gone, base + np.concatenate(a), 1)
                np.add.at(gone, base + np.concatenate(b) + length, -1)
                drop = np.cumsum(gone[:-1]) > 0
                keep = np.frombuffer(data, np.uint8)[~drop].tobytes()
                count = int((np.diff(np.concatenate([[0], drop.astype(np.int8)])) == 1).sum())
                rows.append((len(data), len(data) - len(keep), count, keep))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), batch.column(5)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "in_passage"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) and in_passage of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    marked = in_passages(texts)
    long = texts.filter(F.octet_length("text") >= length)
    found = held(long.mapInArrow(_scan(length), CONTEXTS))
    many = written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    places = written(found.join(many, "anchor", "left_semi"), "repeated-anchors")
    found.unpersist()

    contexts = places.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "doc_id", "s0", "s1", "place")).alias("at"))
    contexts = written(contexts.select("anchor", "context", "n", "at.*"), "contexts")
    several = written(contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "anchors")
    wanted = contexts.join(several, "anchor", "left_semi").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("anchor", "context", "s0", "s1", "place")).alias("wanted"))
    at = wanted.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "r")
    found = long.join(at, F.col("row_key").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "wanted")
    cut = written(found.mapInArrow(_cut(length), "a long, c long, place int, bytes binary"), "context-bytes")

    spans = repeated_spans(cut, length).withColumnsRenamed({"a": "anchor", "c": "context"})
    whole = contexts.filter("n > 1").select("anchor", "context", F.lit(0).alias("r0"), (F.col("s1") - F.col("s0")).alias("r1"))
    spans = spans.unionByName(whole).groupBy("anchor", "context").agg(F.collect_set(F.struct("r0", "r1")).alias("spans"))
    spans = written(spans.select("anchor", "context", F.col("spans.r0").alias("r0"), F.col("spans.r1").alias("r1")), "spans")

    gone = places.join(spans, ["anchor", "context"]).select("doc_id", "row_key", F.struct("s0", "r0", "r1").alias("span"), F.lit(False).alias("in_passage"))
    gone = gone.unionByName(marked.withColumns({"span": F.lit(None).cast(gone.schema["span"].dataType), "in_passage": F.lit(True)}))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.collect_set("span").alias("spans"), F.max("in_passage").alias("in_passage"))
    out = texts.join(gone, F.col("row_key").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    out = out.select("doc_id", "text", "spans.s0", "spans.r0", "spans.r1", F.coalesce("in_passage", F.lit(False)).alias("in_passage"))
    return out.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, in_passage boolean")
