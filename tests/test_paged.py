"""The paged source against the rows its pages were written from."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quantloom.sources import paged


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    rows = []
    for k, symbol in enumerate(["AAA", "BBB", "C C", "DDD", "EEE"]):
        for i in range(23 if symbol != "DDD" else 0):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            page = root / f"symbol={symbol}" / f"page={i // 10}"
            page.mkdir(parents=True, exist_ok=True)
            row = (symbol, day, 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + k, None if i == 3 else 100.0 * i)
            with open(page / "part-0.json", "a") as f:
                f.write(json.dumps(dict(zip(("d", "open", "high", "low", "close", "volume"), (str(day), *row[2:])))) + "\n")
            rows.append(row)
    (root / "symbol=DDD").mkdir()
    paged.register(spark)
    return str(root), sorted(rows)


def read(spark, root, **options):
    return spark.read.format("paged_bars").options(path=root, wait="0.01", **options).load()


def test_all_pages_of_all_symbols(spark, pages):
    root, rows = pages
    out = read(spark, root, batch="2")
    assert sorted(map(tuple, out.collect())) == rows
    assert out.rdd.getNumPartitions() == 3
    assert out.columns == ["symbol", "d", "open", "high", "low", "close", "volume"]


def test_filters_drop_partitions_and_days(spark, pages):
    root, rows = pages
    out = read(spark, root, batch="1")
    one = out.filter("symbol = 'BBB' and d >= date '2024-01-05' and d < date '2024-01-09' and volume > 500")
    assert sorted(map(tuple, one.collect())) == [r for r in rows if r[0] == "BBB" and dt.date(2024, 1, 5) <= r[1] < dt.date(2024, 1, 9) and r[6] and r[6] > 500]
    assert one.rdd.getNumPartitions() == 1
    two = out.filter(F.col("symbol").isin("AAA", "EEE", "none") & (F.col("d") == dt.date(2024, 1, 20)))
    assert [r.symbol for r in two.orderBy("symbol").collect()] == ["AAA", "EEE"] and two.rdd.getNumPartitions() == 2
    assert out.filter("symbol = 'none'").count() == 0


def flaky(root, symbol, first, last, page):
    """Each page fails twice before it comes; the count is kept beside the pages."""
    from pathlib import Path

    mark = Path(root) / f"tries-{symbol}-{page}"
    n = int(mark.read_text()) if mark.exists() else 0
    mark.write_text(str(n + 1))
    if n < 2:
        raise OSError("not now")
    return paged.json_pages(root, symbol, first, last, page)


def test_a_page_that_fails_twice_is_asked_for_again(spark, pages, monkeypatch):
    root, rows = pages
    reader = paged.PagedReader({"path": root, "wait": "0", "symbols": "AAA", "tries": "3"})
    reader.fetch = flaky
    assert [r for p in reader.partitions() for r in reader.read(p)] == [r for r in rows if r[0] == "AAA"]
    reader = paged.PagedReader({"path": root, "wait": "0", "symbols": "BBB", "tries": "2"})
    reader.fetch = flaky
    with pytest.raises(OSError):
        [r for p in reader.partitions() for r in reader.read(p)]
    with pytest.raises(ValueError):
        paged.PagedReader({"path": root, "tries": "0"})
