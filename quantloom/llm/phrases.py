"""Phrase collocation mining by best-first branch and bound.

Phrases grow from their prefixes, and what is counted of a prefix bounds the score of all that it grows into: a
phrase of three words that starts with x y scores no more than f(x y) / f(x), since its first cut has
f(x) on the left and at least its own number on the right. Words and pairs are counted first (a pair only
if both words are frequent). Then each language has a threshold, and its frontier, the pairs whose bound
reaches it, is expanded: all phrases of three words that start with a pair of the frontier are counted, and
so are those that end with a pair whose own score reaches the threshold, because they may cover that pair. By
then everything that survives with a score at or over the threshold is known. A language is settled when
that is TOP phrases or more, ties included; the others lower their threshold (WIDEN times as many pairs) and
expand what is new, best bounds first, until all are settled or nothing is left.

Counting: a task counts the phrases of slices of whole texts with exact word numbers; Spark adds the counts.
Which words or pairs matter is told to the tasks by a bitmap of 2**BITS hashed places, of one size whatever
the corpus; what falls on a set place by accident is counted for nothing, and counts are never wrong. Thresholds
come from histograms of scores, so no language is sorted as a whole.

Defined cases: a null language is `und`; null and empty texts have no words; words may have any length; equal
rows count as often as they stand there; languages with fewer surviving phrases return all of them; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, flat_bytes, mix64, slices, written

LEAST, COVERED, TOP = 10, 50, 2000
BITS, SLICE, FIRST, WIDEN = 25, 1 << 20, 2, 4
ONE = 1_000_000

KIND = np.zeros(256, np.uint8)  # 0: in words, 1: between words, 2: between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
TEXT_HASH = RollingHash(71)
STEP = np.uint64(0x9E3779B97F4A7C15)


def text_hashes(column: pa.Array) -> np.ndarray:
    raw, off = flat_bytes(pa.RecordBatch.from_arrays([column], ["x"]), "x")
    return TEXT_HASH.ranges(TEXT_HASH.prefix(raw), off[:-1], off[1:]) + np.diff(off).astype(np.uint64)


def word_hashes(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(lang * STEP + word)


def pair_hashes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(mix64(x * STEP) + y)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Words:
    """The words of a slice: their text, language, and whether the next one follows in the same piece. `at` says
    which of the distinct words (of a language) each is."""

    def __init__(self, batch: pa.RecordBatch):
        raw, off = flat_bytes(batch)
        langs = pc.fill_null(batch.column(batch.schema.get_field_index("lang")), "und").dictionary_encode()
        kind = KIND[raw]
        word, border = kind == 0, np.zeros(len(raw) + 1, bool)
        border[off] = True
        begin = np.flatnonzero(word & (border[:-1] | ~np.append(False, word[:-1])))
        end = np.flatnonzero(word & (border[1:] | ~np.append(word[1:], False))) + 1
        doc = np.searchsorted(off, begin, "right") - 1
        breaks = np.append(np.int32(0), np.cumsum(kind == 2, dtype=np.int32))
        self.joined = (doc[1:] == doc[:-1]) & (breaks[begin[1:]] == breaks[end[:-1]])
        texts = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, np.cumsum(end - begin))), pa.py_buffer(LOWER[raw[word]]))
        texts = texts.dictionary_encode()
        lang, text = np.asarray(langs.indices, np.int64)[doc], np.asarray(texts.indices, np.int64)
        self.codes, self.at = np.unique(lang * max(1, len(texts.dictionary)) + text, return_inverse=True)
        lang, text = np.divmod(self.codes, max(1, len(texts.dictionary)))
        self.lang, self.text = langs.dictionary.take(pa.array(lang)), texts.dictionary.take(pa.array(text))
        self.hashes = word_hashes(text_hashes(langs.dictionary)[lang], text_hashes(texts.dictionary)[text])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pairs start, which distinct pair each is, and the two words of the distinct pairs."""
        start = np.flatnonzero(self.joined)
        codes, at = np.unique(self.at[start] * len(self.codes) + self.at[start + 1], return_inverse=True)
        return start, at, *np.divmod(codes, len(self.codes))


def _counted(size: int, first: np.ndarray | None = None, second: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words (and of all words, under null), of pairs whose words are in a bitmap, or of three words
    whose first pair is in one or whose second is in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            w = Words(batch)
            if not len(w.at):
                continue
            if size == 1:
                n = np.bincount(w.at)
                every = w.lang.dictionary_encode()
                total = np.bincount(np.asarray(every.indices), n).astype(np.int64)
                lang, words = pa.concat_arrays([w.lang, every.dictionary]), [pa.concat_arrays([w.text, pa.nulls(len(total), w.text.type)])]
                n = np.append(n, total)
            else:
                start, at, x, y = w.pairs()
                if size == 2:
                    fine = _has(first, w.hashes)
                    keep = fine[x] & fine[y]
                    n = np.bincount(at, minlength=len(x))[keep]
                    lang, words = w.lang.take(pa.array(x[keep])), [w.text.take(pa.array(v[keep])) for v in (x, y)]
                else:
                    hashes = pair_hashes(w.hashes[x], w.hashes[y])
                    head, tail = _has(first, hashes), _has(second, hashes)
                    on = np.flatnonzero(start[1:] == start[:-1] + 1)
                    on = on[head[at[on]] | tail[at[on + 1]]]
                    codes, n = np.unique(at[on] * len(w.codes) + y[at[on + 1]], return_counts=True)
                    pair, z = np.divmod(codes, len(w.codes))
                    lang, words = w.lang.take(pa.array(x[pair])), [w.text.take(pa.array(v)) for v in (x[pair], y[pair], z)]
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), *[v.cast(pa.string()) for v in words], pa.array(n.astype(np.int64))], ["lang", *"xyz"[:size], "n"])

    return run


def counted(docs: DataFrame, size: int, *bitmaps: np.ndarray) -> DataFrame:
    """lang, the words (x, y, z) and n of the phrases that are frequent."""
    names = list("xyz"[:size])
    held = docs.sparkSession.sparkContext.broadcast(bitmaps)  # of one size whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(size, *held.value)(batches)

    out = docs.mapInArrow(run, ", ".join(f"{c} string" for c in ("lang", *names)) + ", n long")
    out = out.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    return out.filter((F.col("n") >= LEAST) | F.col("x").isNull())


def bitmap(rows: DataFrame) -> np.ndarray:
    """The places of words (lang, x) or pairs (lang, x, y). A task combines its places, Spark those of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        for batch in batches:
            hashes = word_hashes(text_hashes(batch.column(0)), text_hashes(batch.column(1)))
            if batch.num_columns > 2:
                hashes = pair_hashes(hashes, word_hashes(text_hashes(batch.column(0)), text_hashes(batch.column(2))))
            at = hashes >> np.uint64(64 - BITS)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], ["at", "bits"])

    out = np.zeros(1 << (BITS - 6), np.uint64)
    found = rows.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(found.column("at"))] = np.asarray(found.column("bits")).view(np.uint64)
    return out


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: the products have up to 38 digits."""
    d = [f"cast({c} as decimal(16, 0))" for c in (a, left, right)]
    return F.expr(f"cast((cast({d[0]} * {d[0]} as decimal(32, 0)) * cast({ONE} as decimal(7, 0))) div ({d[1]} * {d[2]}) as long)")


def _ranked(rows: DataFrame, at: int, column: str = "score") -> DataFrame:
    """For each language the largest score that `at` rows or more reach (0 where there are fewer). Rows are
    counted by score first."""
    bins = rows.groupBy("lang", column).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc(column)))
    reached = bins.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= at, F.col(column))).alias("theta"))
    return reached.select("lang", F.coalesce("theta", F.lit(0)).alias("theta"))


def _survivors(pairs: DataFrame, threes: DataFrame, theta: DataFrame) -> DataFrame:
    """Phrases at or over their language's threshold that no longer phrase covers."""
    over = threes.select("lang", F.explode(F.expr("array(struct(x, y), struct(y as x, z as y))")).alias("p"), F.col("n").alias("longer")).groupBy("lang", "p.x", "p.y").agg(F.max("longer").alias("longer"))
    two = pairs.join(theta, "lang").filter("score >= theta").join(over, ["lang", "x", "y"], "left").filter(f"longer is null or 100 * longer < {COVERED} * n")
    three = threes.join(theta, "lang").filter("score >= theta")
    columns = ["lang", "phrase", "n", "l", "r", "score"]
    return two.withColumn("phrase", F.concat_ws(" ", "x", "y")).select(*columns).unionByName(three.withColumn("phrase", F.concat_ws(" ", "x", "y", "z")).select(*columns))


def _scored(threes: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases of three words with their lowest-scoring cut."""
    head = pairs.select("lang", "x", "y", F.col("n").alias("xy"), F.col("l").alias("fx"))
    tail = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("yz"), F.col("r").alias("fz"))
    rows = threes.join(head, ["lang", "x", "y"]).join(tail, ["lang", "y", "z"]).withColumns({"one": score("n", "fx", "yz"), "two": score("n", "xy", "fz")})
    first = F.col("one") <= F.col("two")
    return rows.select("lang", "x", "y", "z", "n", F.when(first, F.col("fx")).otherwise(F.col("xy")).alias("l"), F.when(first, F.col("yz")).otherwise(F.col("fz")).alias("r"), F.least("one", "two").alias("score"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two and three words."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(counted(texts, 1), "phrase-words", light=True)
    words, totals = counts.filter("x is not null"), counts.filter("x is null").select("lang", F.col("n").alias("total"))
    pairs = counted(texts, 2, bitmap(words.select("lang", "x")))
    pairs = pairs.join(words.withColumnRenamed("n", "l"), ["lang", "x"]).join(words.select("lang", F.col("x").alias("y"), F.col("n").alias("r")), ["lang", "y"])
    pairs = pairs.withColumns({"score": score("n", "l", "r"), "bound": F.expr(f"cast(cast({ONE} as decimal(7, 0)) * cast(n as decimal(16, 0)) div cast(l as decimal(16, 0)) as long)")})
    pairs = written(pairs.select("lang", "x", "y", "n", "l", "r", "score", "bound"), "phrase-pairs")

    at, threes, settled = FIRST * top, None, None
    open_ = written(pairs.select("lang", F.lit(ONE + 1).alias("before")).distinct(), "phrase-languages", light=True)
    while not open_.isEmpty():
        theta = written(_ranked(pairs.join(open_, "lang", "left_semi"), at).join(open_, "lang"), "phrase-thresholds", light=True)
        new = pairs.join(theta, "lang")
        maps = [bitmap(new.filter(f"{c} >= theta and {c} < before").select("lang", "x", "y")) for c in ("bound", "score")]
        more = written(_scored(counted(texts, 3, *maps), pairs, words), "phrase-threes")
        threes = more if threes is None else threes.unionByName(more).dropDuplicates(["lang", "x", "y", "z"])
        enough = _survivors(pairs, threes, theta.select("lang", "theta")).groupBy("lang").agg(F.count("*").alias("k"))
        known = written(theta.join(enough, "lang", "left").select("lang", "theta", (F.coalesce("k", F.lit(0)) >= top).alias("done")), "phrase-settled", light=True)
        done = known.filter("done or theta = 0").select("lang", "theta")
        settled = done if settled is None else settled.unionByName(done)
        open_ = known.filter("not done and theta > 0").select("lang", F.col("theta").alias("before"))
        at *= WIDEN
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if settled is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = written(_survivors(pairs, threes, settled), "phrase-survivors")
    best = best.join(_ranked(best, top), "lang").filter("score >= theta").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))
    best = best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
