"""Canonical JSON against json.dumps, SQL names and subsets, merges by coverage in place."""

import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import canonical, sql
from quantloom.operators import coverage

NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 9.99e-5, 1e-5, 1.25e-7, 123456.789, 1e15, 123456789012345.6, 1e16, 1.2e17, -3e22, 1e100, 1e-100, 5e-10, 1 / 3, 2.5e-3, 9007199254740993.0, 711.56]
TEXTS = ["", "plain", 'quote " and \\', "a\nb\tc\rd\be\ff", "\x00\x1f", "é ñ", "日本", "𝄞 clef", "\x7f", "mixed é\n𝄞\"", "[]!#~"]


def test_numbers_and_texts(spark):
    rng = np.random.default_rng(1)
    numbers = NUMBERS + [float(x) for x in rng.normal(size=200) * 10.0 ** rng.integers(-12, 20, 200)]
    df = spark.createDataFrame([(float(x),) for x in numbers], "x double")
    got = [r for r in df.select("x", canonical.number(F.col("x")).alias("s")).collect()]
    assert all(float(r.s) == r.x for r in got)
    wrong = [(r.x, r.s) for r in got if r.s != json.dumps(r.x) and len(r.s) <= len(json.dumps(r.x))]
    assert not wrong
    assert all(r.s == json.dumps(r.x) for r in got[: len(NUMBERS)])
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    assert [r.s for r in df.select(canonical.text(F.col("x")).alias("s")).collect()] == [json.dumps(x) for x in TEXTS]


def test_nested_documents(spark):
    schema = 'z long, `B"` string, a struct<y: array<double>, x: boolean, w: map<string, array<string>>>, n int'
    rows = [(i, TEXTS[i % len(TEXTS)], None if i == 3 else ([NUMBERS[i], None] if i % 2 else [], i % 3 == 0, {TEXTS[i % 7]: ["v", None], "b": [], "A": TEXTS[:2]} if i != 5 else None), None if i % 4 else i) for i in range(len(NUMBERS))]
    df = spark.createDataFrame(rows, schema).select("z", F.struct("*").alias("doc"))
    got = {r.z: r.s for r in df.select("z", canonical.document(F.col("doc"), df.schema["doc"].dataType).alias("s")).collect()}
    for z, b, a, n in rows:
        want = {"z": z, 'B"': b, "n": n, "a": None if a is None else dict(zip("yxw", a))}
        assert got[z] == json.dumps(want, sort_keys=True, separators=(",", ":"), allow_nan=False)


def test_refused_values(spark):
    for x in (math.nan, math.inf, -math.inf):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(x,)], "x double").select(canonical.number(F.col("x"))).collect()
    with pytest.raises(TypeError, match="canonical"):
        canonical.document(F.lit(b"x"), spark.createDataFrame([(b"x",)], "x binary").schema["x"].dataType)


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql("select clipped(7D, 0D, 5D) c, ratio(1D, 0D) r, annual_return(0.1D, 252) a, rsi_of(1D, 1D) i, regime_of(1.9D, 0D) g, is_valid_id('a b') v, is_valid_id(null) w").first()
    assert tuple(row) == (5.0, None, pytest.approx(0.1), 50.0, "crisis", False, False)
    rows = spark.sql("select n, k, s.place, s.members from values (4, 2), (3, 3), (2, 3), (5, 0) t(n, k), lateral combinations(n, k) s").collect()
    for n, k in ((4, 2), (3, 3), (2, 3), (5, 0)):
        assert [tuple(r.members) for r in sorted(rows, key=lambda r: r.place) if (r.n, r.k) == (n, k)] == list(combinations(range(1, n + 1), k))


def test_untouched_phases_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "gold")
    days = [(p, f"2024-01-{d:02d}", float(d), None) for p, span in (("train", range(1, 11)), ("test", range(11, 21))) for d in span]
    saved = spark.createDataFrame(days, "phase string, d string, px double, other double").withColumn("d", F.to_date("d"))
    saved.repartition("phase").write.partitionBy("phase").parquet(path)
    files = lambda phase: {x.name for x in (tmp_path / "gold" / f"phase={phase}").glob("*.parquet")}
    before = {p: files(p) for p in ("train", "test")}
    new = spark.createDataFrame([("2023-12-30", 1.0, None), ("2024-01-20", None, 5.0), ("2024-01-24", 24.0, None)], "d string, px double, other double").withColumn("d", F.to_date("d"))
    said = {r.phase: r for r in coverage.update(spark, path, new, {"train": False, "test": True}, ["px", "other"]).collect()}
    assert (said["train"].status, said["train"].n_refused, said["train"].n_before) == ("skipped", 2, 1)
    assert (said["test"].status, said["test"].n_taken, said["test"].gap_days) == ("extended", 2, 0)
    assert files("train") == before["train"] and not files("test") & before["test"]
    spark.catalog.refreshByPath(path)
    rows = {str(r.d): (r.px, r.other) for r in spark.read.parquet(path).filter("phase = 'test'").collect()}
    assert len(rows) == 11 and rows["2024-01-20"] == (20.0, 5.0) and rows["2024-01-24"] == (24.0, 5.0)  # a null never wipes a price
    again = coverage.update(spark, path, new.filter("d > date '2024-01-23'").withColumn("d", F.date_add("d", 10)), {"test": True}, ["px", "other"]).first()
    assert (again.status, again.gap_days) == ("extended", 9)
