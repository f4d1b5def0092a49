"""Line dedup by pairwise alignment.

Every line is hashed, and every shortest passage of MIN_BYTES or more that begins or ends at a line. Each
document is paired with the first holder (smallest doc_id) of each of its passages: a passage with many
holders makes a star around its first, not all pairs, and nothing is capped. Any block that a document has
in common with an earlier one is covered by such passages, so all of it is met in some pair. Each pair's
line hashes are aligned by patience diff: lines that are unique in both, in their longest common order, are
the fixed points; between them the alignment goes on, and matches grow to neighbours. Runs of aligned lines
of MIN_BYTES or more are deleted from the later document. What the alignment leaves (passages that one of
both holds twice, or that stand in another order) is looked up in the earlier document: all lines of a
common block of MIN_BYTES or more go. The first holder of a line never loses it.

Defined cases: lines end at line feeds; a passage has a line that is not of white space alone; empty lines
at the edges of a passage go only where one pair has them too; a null text has no lines; a text that loses
all lines is empty; rows that repeat a doc_id count as one document in order of their text's hash; copies
of one row do not delete from each other; rows without a doc_id keep all lines; extra columns stay, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SequenceHash, unused, written

MIN_BYTES = 64


RANGE_HASH = SequenceHash(21)


def unique_matches(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, in their longest common order."""
    na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {x: j for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
    pairs = [(i, place[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in place]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: matched places of a and b, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        fixed = unique_matches(a, b, a0, a1, b0, b1)
        for i, j in fixed:
            todo.append((a0, i, b0, j))
            out.append((i, j))
            a0, b0 = i + 1, j + 1
        if fixed:
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def passages(sizes: np.ndarray, solid: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of `least` bytes and a solid line that begin or end at each line
    of flat documents. Each line of a longer run is in one of them that lies in the run."""
    at = np.arange(len(sizes))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    size, mark = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(solid))
    end = np.maximum(np.searchsorted(size, size[:-1] + least), np.searchsorted(mark, mark[:-1] + 1))
    start = np.minimum(np.searchsorted(size, size[1:] - least, "right"), np.searchsorted(mark, mark[1:] - 1, "right")) - 1
    ahead, back = end <= off[doc + 1], start >= off[doc]
    return np.concatenate([at[ahead], start[back]]), np.concatenate([end[ahead], at[back] + 1])


def passage_hashes(lines: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return RANGE_HASH.ranges(RANGE_HASH.prefix(lines), start, end) + (end - start).astype(np.uint64)


def in_common_blocks(later: list[int], sizes: list[int], earlier: list[int], least: int) -> list[int]:
    """Places of the later document in blocks of enough bytes that stand anywhere in the earlier one."""
    known = dict(zip(later, sizes, strict=True))
    sides = []
    for lines in (later, earlier):
        size = np.array([known.get(x, 0) for x in lines], np.int64)
        start, end = passages(size, np.ones(len(size), np.int64), np.array([0, len(size)]), least)
        sides.append((start, end, passage_hashes(np.array(lines, np.int64), start, end)))
    (start, end, own), (_, _, others) = sides
    hit = np.isin(own, others)
    cover = np.zeros(len(later) + 1, np.int64)
    np.add.at(cover, start[hit], 1)
    np.add.at(cover, end[hit], -1)
    return np.flatnonzero(np.cumsum(cover)[:-1]).tolist()


def deleted(later: list[int], sizes: list[int], earlier: list[int], least: int = MIN_BYTES) -> list[int]:
    """Places of the later document in aligned runs or other common blocks of enough bytes."""
    pairs = aligned(later, earlier)
    gone, run = [], []
    for k, (i, j) in enumerate(pairs):
        run.append(i)
        if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
            if sum(sizes[x] for x in run) >= least:
                gone += run
            run = []
    found, shared = set(gone), set(earlier)
    if any(n and x in shared and i not in found for i, (x, n) in enumerate(zip(later, sizes, strict=True))):
        gone = sorted(found.union(in_common_blocks(later, sizes, earlier, least)))
    return gone


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, sizes, blank = (np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False)) for i in (2, 3, 4))
        off = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        start, end = passages(sizes.astype(np.int64), ~blank.astype(bool), off, MIN_BYTES)
        edges = (sizes[start] > 0) & (sizes[end - 1] > 0)
        start, end = start[edges], end[edges]
        doc, found = np.searchsorted(off, start, "right") - 1, passage_hashes(lines, start, end).view(np.int64)
        order = np.lexsort([found, doc])
        doc, found = doc[order], found[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]))[: len(doc)]
        at = pa.array(doc[new])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found[new])], ["doc_id", "row_key", "passage"])


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        later, sizes, earlier = (batch.column(i).to_pylist() for i in (2, 3, 4))
        gone = [deleted(*x) for x in zip(later, sizes, earlier, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "row_key", "gone"])


def lines_removed(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the deleted lines' places in the column that gone_name gives (null
    where none)."""
    key, d, k, gone_as = (unused(x, docs.columns) for x in ("_row_key", "_d", "_k", "_gone"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    split = F.split(F.col("text"), "\n")
    hashed = F.transform(split, lambda x: F.xxhash64(x))
    sizes = F.transform(split, lambda x: F.octet_length(x))
    blank = F.transform(split, lambda x: F.trim(F.translate(x, "\t\r", "  ")) == "")
    known = keyed.filter("text is not null and doc_id is not null").select("doc_id", F.col(key).alias("row_key"), hashed.alias("hashes"), sizes.alias("sizes"), blank.alias("blank"))
    rows = written(known.dropDuplicates(["doc_id", "row_key"]), "line-hashes")
    held_by = rows.mapInArrow(_passages, "doc_id long, row_key long, passage long")
    holders = held_by.groupBy("passage").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = held_by.join(holders, "passage").filter("doc_id <> first.doc_id or row_key <> first.row_key")
    pairs = pairs.select("doc_id", "row_key", F.col("first.doc_id").alias("e_id"), F.col("first.row_key").alias("e_key")).distinct()
    earlier = rows.select(F.col("doc_id").alias("e_id"), F.col("row_key").alias("e_key"), F.col("hashes").alias("earlier"))
    both = pairs.join(earlier, ["e_id", "e_key"]).drop("e_id", "e_key").join(rows.drop("blank"), ["doc_id", "row_key"])
    gone = both.select("doc_id", "row_key", "hashes", "sizes", "earlier").mapInArrow(_deleted, "doc_id long, row_key long, gone array<int>").filter("size(gone) > 0")
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("row_key").alias(k)).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias(gone_as))
    out = keyed.join(gone, (F.col(key) == F.col(k)) & (F.col("doc_id") == F.col(d)), "left")
    return out.select(*docs.columns, gone_as)


def gone_name(docs: DataFrame) -> str:
    return unused("_gone", docs.columns)


def kept_text(gone: str = "_gone"):
    """What is left of `text` beside the lines of the gone column."""
    keep = F.expr(f"transform(array(split(text, '\\n')), x -> array_join(transform(array_except(sequence(0, size(x) - 1), `{gone}`), i -> x[i]), '\\n'))[0]")
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(keep)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the deleted lines taken out of `text`, and their number in the column
    that removed_name gives."""
    out, gone = lines_removed(docs), gone_name(docs)
    return out.select(*[kept_text(gone).alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed_name(docs)))


def removed_name(docs: DataFrame) -> str:
    return unused("_n_removed", docs.columns)
