"""Column builders. Division never raises: a zero divisor gives null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DAYS = 252
RISK_FREE = 0.06


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def clip(x, low: float, high: float) -> Column:
    """Null stays null (greatest and least skip nulls)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def daily_risk_free(annual: float = RISK_FREE) -> float:
    return (1 + annual) ** (1 / DAYS) - 1


def annualised(total, periods) -> Column:
    """Compound annual return of a total return over a number of periods; null without periods."""
    n = col(periods)
    return F.when(n > 0, F.pow(1 + col(total), F.lit(float(DAYS)) / n) - 1)


def scaled_view(prediction, volatility, observations, horizon: int = 5, cap: float = 0.5) -> Column:
    """A forecast over `horizon` days as an annual view: bounded by tanh where the volatility is known
    from five observations or more, else annualised and capped."""
    known = (col(volatility) > 1e-8) & (col(observations) >= 5)
    bounded = cap * F.tanh(col(prediction) / (col(volatility) * F.sqrt(F.lit(float(horizon)))))
    return F.when(known, bounded).otherwise(clip(col(prediction) * DAYS / horizon, -cap, cap))


def regime(volatility_ratio, drawdown) -> Column:
    v, d = col(volatility_ratio), col(drawdown)
    return F.when((v >= 1.8) | (d <= -0.20), "crisis").when((v >= 1.3) | (d <= -0.10), "stress").otherwise("normal")


def parsed_date(x, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)).cast("date") for f in formats])


def grouped_integer(x) -> Column:
    """Integer of a text with `.` between thousands; null if it is none."""
    return F.regexp_replace(col(x), r"\.", "").try_cast("bigint")


def normalised_price(price, unit) -> Column:
    """Prices in thousands times 1000, to six places, half to even."""
    factor = F.when(F.startswith(col(unit), F.lit("thousand_")), F.lit(1000)).otherwise(F.lit(1))
    return F.bround(col(price).cast("decimal(24,9)") * factor, 6).cast("decimal(24,6)")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted names; every value is a string or null."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def risk_profile(horizon, liquidity, loss, experience) -> tuple[Column, Column]:
    """Profile name and risk aversion of the lowest of four scores from 1 to 3."""
    score = F.least(col(horizon), col(liquidity), col(loss), col(experience))
    name = F.when(score <= 1, "conservative").when(score == 2, "balanced").otherwise("growth")
    return name, F.when(score <= 1, 6.0).when(score == 2, 3.0).otherwise(1.5)


def valid_id(x) -> Column:
    return F.coalesce(F.rlike(col(x), F.lit(r"^[A-Z0-9_-]{1,64}$")), F.lit(False))


def finite_positive(x) -> Column:
    x = col(x)
    return F.coalesce(~F.isnan(x) & (x > 0) & (x < F.lit(float("inf"))), F.lit(False))


def percentage_points(change) -> Column:
    """A change of weight in points, to one place."""
    return F.round(col(change) * 1000) / 10


def target_capital(capital, weight, group: str) -> tuple[Column, Column]:
    """Capital by weight, and its total over the group."""
    target = col(weight) * col(capital)
    return target, F.sum(target).over(Window.partitionBy(group))


def as_text(values) -> Column:
    """Numbers of an array as text, as they are kept without loss."""
    return F.transform(col(values), lambda x: x.cast("string"))
