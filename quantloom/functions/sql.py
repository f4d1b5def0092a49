"""Functions under SQL names: scalar ones defined in SQL, so that Catalyst inlines them, and the table function of
subsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .scalar import DAYS, daily_risk_free

#: name, arguments, result, body. A function may call those before it.
SCALARS = [
    ("daily_risk_free", "", "DOUBLE", f"{daily_risk_free()!r}D"),
    ("ratio", "x DOUBLE, y DOUBLE", "DOUBLE", "IF(y = 0, NULL, x / y)"),
    ("simple_return", "now DOUBLE, before DOUBLE", "DOUBLE", "ratio(now, before) - 1"),
    ("annual_return", "total DOUBLE, n BIGINT", "DOUBLE", f"IF(n > 0, POW(1 + total, {float(DAYS)}D / n) - 1, NULL)"),
    ("clipped", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "LEAST(GREATEST(x, low), high)"),
    ("rsi_of", "gain DOUBLE, loss DOUBLE", "DOUBLE", "100 - 100 / (1 + ratio(gain, loss))"),
    ("regime_of", "vol_ratio DOUBLE, drawdown DOUBLE", "STRING", "CASE WHEN vol_ratio >= 1.8 OR drawdown <= -0.2 THEN 'crisis' WHEN vol_ratio >= 1.3 OR drawdown <= -0.1 THEN 'stress' ELSE 'normal' END"),
    ("is_valid_id", "id STRING", "BOOLEAN", "COALESCE(id RLIKE '^[A-Z0-9_-]{1,64}$', FALSE)"),
]


@udtf(returnType="place bigint, members array<int>")
class Combinations:
    """combinations(n, k): the subsets of k of the numbers 1 to n, one row each, in order. They are made one by one, so
    a task holds one of them, whatever their number."""

    def eval(self, n: int, k: int):
        if n is None or k is None or k < 0:
            return
        for place, members in enumerate(combinations(range(1, n + 1), k)):
            yield place, list(members)


def register(spark: SparkSession) -> None:
    """The names of this session: SCALARS and the table function `combinations`."""
    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("combinations", Combinations)
