"""Centroid clusters, license scans and collocations against plain versions, over odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import clusters, licenses, phrases

ODD = [None, "", " \n\t ", "All rights reserved. ALL RIGHTS RESERVED", "x" * 5000, "Licensed under CC BY-NC 4.0.\nCC BY\ncc-by", "été ÉTÉ, cc by", "a.b;c:d!e?f", "released under\nthe MIT License"]


def texts_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, words string, l int, theta string")


def plain_clusters(rows: list[tuple[int | None, list | None]], k: int, rounds: int, dim: int, seed: int = 3) -> list[tuple]:
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, near(v)) for i, v in kept]
    total = Counter()
    for _, (d, j) in out:
        total[j] += d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, (d, j) in out), key=str)


@pytest.mark.parametrize(("n", "copies"), [(400, 0.5), (60, 0.0), (5, 0.0), (0, 0.0)])
def test_clusters(spark, n, copies):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(n)]
    for i in range(int(n * copies)):
        rows[i] = (i, rows[-1 - i % 3][1])
    rows += [(-1, None), (-2, []), (-3, [0.5] * 63), (-4, [None] + [0.1] * 63), (-5, [float("nan")] * 64), (-6, [float("inf")] + [0.0] * 63)]
    if n:
        rows += [(None, [0.3] * 64), (3, [-0.25] * 64), (3, [-0.25] * 64), (-7, [-0.0001] * 64), (-8, [float("-inf")] * 64)]
    df = spark.createDataFrame([(i, v, 1, "s", 7) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string, x int").repartition(3)
    assert sorted(map(tuple, clusters.clustered(df).collect()), key=str) == plain_clusters(rows, 8, 10, 64)


def test_cluster_ranges(spark):
    """Vectors too large for 64-bit distances are left out, the largest others are exact."""
    big = 131071.0
    rows = [(1, [big] * 64), (2, [-big] * 64), (3, [1e300] * 64), (4, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, clusters.clustered(df, clusters=1).collect()), key=str)
    assert got == plain_clusters([r for r in rows if r[0] != 3], 1, 10, 64)


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(5)
    for m in (rng.integers(-3, 3, (500, 64)), np.repeat(rng.integers(-900, 900, (7, 64)), 90, axis=0), rng.integers(-(2**27), 2**27, (50, 64))):
        width, subvectors, codes = clusters.encoded(m.astype(np.int32))
        assert width * len(subvectors) == 64
        assert (np.concatenate([s[c] for s, c in zip(subvectors, codes, strict=True)], axis=1) == m).all()
    assert clusters.encoded(np.repeat(rng.integers(-900, 900, (7, 64)), 900, axis=0))[0] == 64


def plain_licenses(text: str | None) -> tuple:
    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))

    text = text or ""
    all_, base, more, best = words(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(all_)) if all_[i : i + len(p)] == p]
    for line in text.split("\n"):
        w = words(line)
        for s in range(0, max(1, len(w) - licenses.BLOCK // 2), licenses.BLOCK // 2):
            for label, template in licenses.TEMPLATES:
                want = set(words(template))
                both = len(want & set(w[s : s + licenses.BLOCK]))
                if 100 * both >= licenses.PERCENT * len(want):
                    more.add(label)
                    best = max(best, both / len(want))
    own = {x for _, x in base}
    at = [i for i, _ in base]
    return len(all_), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if base else best


def test_licenses(spark):
    rng = np.random.default_rng(8)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)}) + ["été", "x1", "The", "CC", "By"]
    texts = list(ODD)
    for label, template in licenses.TEMPLATES:
        w = template.split()
        texts += [template, " ".join(w[1:]), " ".join(w[::-1]), template.upper() + " " + "word " * 200 + template, "\n".join(w), "pad " * 31 + template]
    texts += [" ".join(rng.choice(vocabulary, int(rng.integers(1, 150)))).replace(" been ", "\n") for _ in range(300)]
    rows = [(i if i % 11 else None, t, "en", i, "w", 1, "t") for i, t in enumerate([*texts, texts[9], texts[9]])]
    got = licenses.license_scan(texts_table(spark, rows).repartition(5)).collect()
    want = [(r[0], *plain_licenses(r[1])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(g.labels and not g.base_labels for g in got)
    assert licenses.license_scan(texts_table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="template"):
        licenses.license_scan(texts_table(spark, rows), (("x", "word " * 40),))


def test_license_plan_is_native(spark):
    out = licenses.license_scan(texts_table(spark, [(1, "cc by", "en", 1, "", 1, "")]))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def plain_phrases(rows: list[tuple[str | None, str | None]], top: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        c = counts.setdefault(lang or "und" if lang is not None else "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cover: Counter = Counter()
        for g, v in c.items():
            if len(g) == 3 and v >= 10:
                for p in (g[:2], g[1:]):
                    cover[p] = max(cover[p], v)
        rows_ = []
        for g, a in c.items():
            if len(g) > 1 and a >= 10 and not 100 * cover[g] >= 50 * a:
                s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                rows_.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        rows_.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(rows_[:top])]
    return sorted(out)


@pytest.mark.parametrize("top", [3, 40, 2000])
def test_phrases(spark, top):
    rng = np.random.default_rng(top)
    vocabulary = np.array(["the", "of", "New", "york", "CITY", "é", "ß", "x y", "a.", "b", "c,", "d\t", "e", "f", "g", "\x0b", "long" * 30])
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=weights / weights.sum())) for _ in range(150)]
    rows = [(("en", "fr", None, "und", "")[i % 5], t) for i, t in enumerate(texts)] + [("en", x) for x in ODD] + [("de", "only one phrase here")] + [("es", "red red red red " * 9)] * 3
    table = texts_table(spark, [(i, t, lang, 1, "w", 2, "t") for i, (lang, t) in enumerate(rows)]).repartition(4)
    got = sorted(map(tuple, phrases.collocations(table, top).collect()))
    want = plain_phrases([("" if lang == "" else lang, t) for lang, t in rows if lang != ""], top) + [x for x in plain_phrases([("e", t) for lang, t in rows if lang == ""], top)]
    assert got == sorted([("" if x[0] == "e" else x[0], *x[1:]) for x in want])
    assert phrases.collocations(texts_table(spark, [])).count() == 0
    assert phrases.collocations(texts_table(spark, [(1, None, "en", 1, "", 1, "")])).count() == 0


def test_scores_beyond_64_bits(spark):
    cases = [(9_000_000_000_123, 9_000_000_000_124, 9_000_000_000_125), (10, 10, 10), (12, 13, 97), (10**15, 10**15 + 1, 10**15 + 3)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s"), "a", "l", "r")
    assert [r.s for r in df.collect()] == [1000000 * a * a // (left * right) for a, left, right in cases]
    assert df.select(F.sum("s")).count() == 1
