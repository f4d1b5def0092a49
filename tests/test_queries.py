"""Every query with an oracle against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quantloom import queries as Q
from quantloom.plans import derived

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = Q.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    out = duck.execute(Q.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in out.fetchall()]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and x == pytest.approx(y, rel=1e-9, abs=2e-6)), (a, b)


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_views_of_all_assets_at_each_rebalance(spark):
    panel = derived.panel(spark, str(SF)).select("asset", "rn", "px").toPandas().pivot(index="rn", columns="asset", values="px")
    mom = (panel / panel.shift(20) - 1).round(9)
    want = {}
    for t in range(25, len(panel) + 1, 5):
        x = mom.loc[t].to_numpy()
        n = int((abs(x[:, None] - x[None, :]) >= 0.01).sum()) // 2
        if n:
            want[t] = (n, panel.shape[1])
    got = {r.t: (len(r.p), len(r.p[0])) for r in Q.view_matrices(spark, str(SF)).collect()}
    assert got == want
    rows = Q.queries()["defensive_views"](spark, str(SF)).collect()
    assert rows and all(r.legs == panel.shape[1] for r in rows)
