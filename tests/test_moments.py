"""Mergeable moments against plain statistics of the same rows."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import stats


def rows_of(spark, frame):
    long = [(a, int(rn), None if pd.isna(r) else float(r)) for a in frame for rn, r in frame[a].items()]
    return spark.createDataFrame(long, "asset string, rn long, r double").repartition(4)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    out = pd.DataFrame(rng.normal(0.5, 0.01, (83, 5)), columns=list("ABCDE"), index=range(1, 84))
    out["C"] = 0.3  # constant
    out.loc[20:41, "D"] = 0.7  # constant in some windows, but not at first
    out.loc[1] = np.nan
    out.loc[50, "B"] = np.nan
    return out


@pytest.mark.parametrize(("every", "first", "back"), [(20, 0, None), (5, 2, 4), (7, 2, 1)])
def test_merged_moments(spark, frame, every, first, back):
    got = {(r.block, r.a, r.b): r for r in stats.merged_moments(stats.block_moments(rows_of(spark, frame), every, first), back).collect()}
    whole = frame.dropna()
    blocks = sorted({(rn - first) // every for rn in whole.index if rn >= first})
    assert {k[0] for k in got} == set(blocks) and len(got) == len(blocks) * 25
    for block in blocks:
        low = first if back is None else first + every * (block - back + 1)
        part = whole[(whole.index >= max(low, first)) & (whole.index < first + every * (block + 1))]
        cov = part.cov()
        for (k, a, b), r in got.items():
            if k != block:
                continue
            assert r.n == len(part)
            assert r.mean == pytest.approx(part[a].mean(), rel=1e-12)
            if len(part) > 1:
                assert r.cov == pytest.approx(cov.loc[a, b], abs=1e-12)
                flat = part[a].nunique() == 1 or part[b].nunique() == 1
                assert r.corr is None if flat else r.corr == pytest.approx(cov.loc[a, b] / np.sqrt(cov.loc[a, a] * cov.loc[b, b]), abs=1e-7)


def test_a_row_of_an_incomplete_day_is_left_out(spark, frame):
    some = rows_of(spark, frame)
    assert {r.n for r in stats.block_moments(some, 100).collect()} == {81}


def test_no_look_ahead(spark, frame):
    """Later rows never change what was known before."""
    early = stats.merged_moments(stats.block_moments(rows_of(spark, frame.loc[:39]), 20)).filter("block <= 1")
    late = frame.copy()
    late.loc[40:] *= 3
    again = stats.merged_moments(stats.block_moments(rows_of(spark, late), 20)).filter("block <= 1")
    one, two = ({(r.block, r.a, r.b, r.n): (r.mean, r.cov) for r in x.collect()} for x in (early, again))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)
