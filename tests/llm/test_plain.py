"""Tokenizers on random odd texts, the mixture and the classifier's scores against plain versions."""

import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import bpe, mixing, quality, sharding, tokenout

PIECES = [
    "the", "The", "ING", "don't", "we'LL", " ", "  ", "\t", "\n", "\r\n", " ", " ", "　", "​", "\x00", "\x1c", "é", "é", "̧́", "ß", "ǅ", "日本",
    "한글", "\U0001f642", "\U0001f469‍\U0001f4bb", "0", "12", "3456", "²", "Ⅷ", "_", "-", "...", "!?", "'", "''s", "<|endoftext|>", "</s>", "<unk>", "[CLS]", "�", "\U0010ffff", "a" * 300,
    "xyzzy" * 40,
]


@pytest.fixture(scope="module")
def fuzz(spark):
    rng = np.random.default_rng(17)
    texts = ["".join(rng.choice(PIECES, rng.integers(0, 25))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.integers(32, 0x250, rng.integers(1, 60)))) for _ in range(2000)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_byte_bpe_on_odd_texts(fuzz):
    texts, table = fuzz
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(table).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), repr(t)


def test_word_bpe_on_odd_texts(fuzz):
    texts, table = fuzz
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, got = 0, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenout.tokens_round_trip(table).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)


# ------------------------------------------------------------------ mixing


def hashed(*values):
    """Spark's xxhash64 of an int (as the pair of its kind), longs and strings, as an unsigned number."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack(*v) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h


def plain_mixture(rows, entropy, repeats, budget=None):
    """Uses (doc_id, source, epoch, position) of rows (doc_id, text, source), by bisection and whole sorts."""
    size = {k: len((t or "").split()) for k, (_, t, _) in enumerate(rows)}
    sources = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in {r[2] for r in rows}}
    used = {s: n for s, n in sources.items() if n}
    total = sum(used.values())
    amount = budget or total

    def weights(x):
        w = {s: (n / total) ** x for s, n in used.items()}
        return {s: v / sum(w.values()) for s, v in w.items()}

    def bisected(good):
        low, high = 0.0, 1.0
        if good(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    spread = bisected(lambda x: -sum(v * math.log(v) for v in weights(x).values()) >= entropy * math.log(len(used)))
    often = 1 - bisected(lambda y: max(v * amount / used[s] for s, v in weights(1 - y).items()) <= repeats)
    w = weights(max(spread, often))
    out = set()
    for s, n in sources.items():
        times = round(w[s] * amount / n, 9) if n else 1.0
        place = {k: hashed(("<i", 0), r[0], r[1]) >> 1 for k, r in enumerate(rows) if r[2] == s}
        for epoch in range(int(times) + 1):
            order = {k: ((hashed(epoch, p >> 51) >> 33) << 32) + (hashed(p, epoch) >> 32) for k, p in place.items()}
            before, rest = 0, round((times - int(times)) * n)
            for position, k in enumerate(sorted(place, key=lambda k: (order[k], rows[k][0]))):
                if epoch == int(times) and before >= rest:
                    break
                out.add((rows[k][0], s, epoch, position))
                before += size[k]
    return out


@pytest.mark.parametrize("entropy,repeats", [(0.9, 4.0), (0.99, 2.5), (0.3, 100.0)])
def test_mixture_equals_a_plain_one(spark, entropy, repeats):
    rng = np.random.default_rng(23)
    words = ["alpha", "beta\n", "g\tamma", "délta", "  eps"]
    rows = [(i, None if i % 41 == 0 else "" if i % 37 == 0 else " ".join(rng.choice(words, rng.integers(1, 30))), ("hot", "hot", "hot", "hot", "b", "c", None)[int(rng.integers(0, 7))] if i % 9 else "hot") for i in range(700)]
    rows += [(1000, "", "hollow"), (1001, None, "hollow")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, r.source, r.epoch, r.position) for r in mixing.permuted(table, entropy=entropy, repeats=repeats).collect()]
    want = plain_mixture(rows, entropy, repeats)
    assert len(got) == len(set(got)) and set(got) == want and (entropy < 0.5 or {e for _, _, e, _ in want} != {0})


# ------------------------------------------------------------------ shards


def held_to_the_tree(rows, first, leaves, ranges, slack):
    """Each node of rows (size, source, lang, crc, place, shard) is cut along its widest dimension, ties by content and then
    id, where its left leaves get their part of the bytes to within `slack` or a half of the copies at the border."""
    if leaves == 1:
        return 1
    widths = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / max(1, ranges[d]) for d in range(4)]
    dim, border = widths.index(max(widths)), first + leaves // 2
    key = lambda r: (r[dim], r[3], r[4])
    sides = [r for r in rows if r[5] < border], [r for r in rows if r[5] >= border]
    left, right = max(map(key, sides[0])), min(map(key, sides[1]))
    assert left < right
    copies = max(sum(r[0] for r in rows if (r[dim], r[3]) == k[:2]) for k in (left, right))
    off = abs(sum(r[0] for r in sides[0]) - sum(r[0] for r in rows) / leaves * (leaves // 2))
    assert off <= max(slack, copies / 2) + 1, (dim, off, slack, copies)
    return held_to_the_tree(sides[0], first, leaves // 2, ranges, slack) + held_to_the_tree(sides[1], border, leaves - leaves // 2, ranges, slack)


@pytest.mark.parametrize("shards", [8, 5])
def test_shards_follow_the_tree(spark, shards):
    rng = np.random.default_rng(31)
    rows = []
    for i in range(3000):
        n = int(rng.integers(0, 40)) if i % 3 else int(rng.exponential(300))
        text = None if i % 97 == 0 else "same text" if i % 50 == 0 else f"{i} " + "é" * n
        rows.append((i * 7 % 3000, text, *(("s0", "en") if i % 50 == 0 or i % 97 == 0 else (("s0", "s0", "s1", None)[int(rng.integers(0, 4))], ("en", "fr", None)[i % 3]))))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got = {r.doc_id: r.shard for r in sharding.sharded(table, shards).collect()}
    code = lambda v: -1 if v is None else zlib.crc32(v.encode())
    plain = [(len((t or "").encode()) + 1, code(s), code(l), zlib.crc32((t or "").encode()), i, got[i]) for i, t, s, l in rows]
    ranges = [max(r[d] for r in plain) - min(r[d] for r in plain) for d in range(4)]
    total = sum(r[0] for r in plain)
    assert len(got) == len(rows) and held_to_the_tree(plain, 0, shards, ranges, max(1, total // (shards * sharding.SLACK)) + max(r[0] for r in plain)) == shards


# ------------------------------------------------------------------ classifier


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(29)
    good, bad = (["".join(rng.choice(list(a), rng.integers(2, 9))) for _ in range(300)] for a in ("abcdefghij", "klmnopqrst"))
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 80)), "en", f"s{i % 4}") for i in range(600)]
    rows += [(600, None, "en", "s0"), (601, "", "en", "s0"), (602, rows[1][1], None, None), (603, "long " * 3000, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return rows, docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")


def test_scores_equal_a_plain_version(labelled):
    rows, docs, labels = labelled
    model = quality.fit(docs, labels)
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        raw, z = (text or "").encode(), model.weights[0]
        if raw:
            blocks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
            a, b, c = (sum(len(p.compress(x)) for x in blocks) for p in (*packers, zstandard.ZstdCompressor(level=3)))
            z += model.weights[1] * (b - a) / len(raw) + model.weights[2] * len(raw) / c
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.5)
    assert got[602].score == got[1].score and got[600].score == got[601].score
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)


def test_only_learning_rows_and_texts_count(labelled):
    """Neither held-out labels nor language or source change a model."""
    _, docs, labels = labelled
    model = quality.fit(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.concat(F.lit("z"), "source")}).repartition(7)
    again = quality.fit(other, turned)
    assert (again.good, again.bad) == (model.good, model.bad) and again.weights == pytest.approx(model.weights)
