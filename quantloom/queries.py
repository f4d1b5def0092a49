"""Named queries over the driver's tables, each with its DuckDB equivalent where SQL can say it. Values are
rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import indicators as I
from .operators import ml, optimize, selection, stats, store, views
from .operators import panel as P
from .operators import portfolio as N
from .oracle import LEDGER, MARKET, PANEL, RET, ema, w
from .plans import derived as D
from .streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def rounded(panel: DataFrame) -> DataFrame:
    return panel.withColumn("px", F.round("px", 6))


# ---------------------------------------------------------------- panels


@query(f"with {PANEL} select asset, d, round(px, 6) as px, rn from panel")
def panel_weekly(spark, sf):
    return rounded(D.panel(spark, sf))


@query(
    """with raw as (select p_brand as asset, cast(l_shipdate as date) as d, 100 * pow(sum(l_extendedprice) / sum(l_quantity), 0.1::double) as px from lineitem join part on l_partkey = p_partkey group by 1, 2),
cal as (select cast(x as date) as d from (select unnest(generate_series(timestamp '1996-01-01', timestamp '1997-12-31', interval 1 day)) as x) where isodow(x) < 6),
grid as (select asset, d from (select distinct asset from raw) cross join cal),
f as (select g.asset, g.d, last_value(r.px ignore nulls) over (partition by g.asset order by g.d rows between unbounded preceding and current row) as px from grid g left join raw r on r.asset = g.asset and r.d = g.d)
select asset, d, round(px, 6) as px, row_number() over (partition by asset order by d) as rn from f where d in (select d from f group by d having count(px) = count(*))"""
)
def panel_business_days(spark, sf):
    return rounded(P.price_panel(D.prices(spark, sf, "day"), P.business_days(spark, "1996-01-01", "1997-12-31"), "legacy"))


@query(
    """with raw as (select p_brand as asset, cast(l_shipdate as date) as d, 100 * pow(sum(l_extendedprice) / sum(l_quantity), 0.1::double) as px from lineitem join part on l_partkey = p_partkey group by 1, 2),
cal as (select distinct cast(date_trunc('week', l_shipdate) as date) as d from lineitem),
u as (select d from cal union select d from raw),
f as (select a.asset, u.d, last_value(r.px ignore nulls) over (partition by a.asset order by u.d rows between unbounded preceding and current row) as px from (select distinct asset from raw) a cross join u left join raw r on r.asset = a.asset and r.d = u.d),
g as (select * from f where d in (select d from cal))
select asset, d, round(px, 6) as px, row_number() over (partition by asset order by d) as rn from g where d in (select d from g group by d having count(px) = count(*))"""
)
def panel_union_asof(spark, sf):
    return rounded(P.price_panel(D.prices(spark, sf, "day"), P.session_days(D.market(spark, sf)), "audited"))


@query("select cast(x as date) as d from (select unnest(generate_series(timestamp '2020-01-01', timestamp '2026-07-01', interval 1 day)) as x) where isodow(x) < 6")
def business_calendar(spark, sf):
    return P.business_days(spark, "2020-01-01", "2026-07-01")


@query(
    """select asset, d, round(px, 6) as px from (select p_brand as asset, cast(l_shipdate as date) as d, 100 * pow(l_extendedprice / l_quantity, 0.1::double) as px,
row_number() over (partition by p_brand, cast(l_shipdate as date) order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as n
from lineitem join part on l_partkey = p_partkey where cast(l_shipdate as date) between date '1996-01-01' and date '1999-12-31') where n = 1"""
)
def dedup_keep_last(spark, sf):
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = D.trades(spark, sf).select("asset", F.col("l_shipdate").cast("date").alias("d"), D.price(F.col("l_extendedprice"), F.col("l_quantity")).alias("px"), order.alias("ordinal"))
    return rounded(P.series(rows, "1996-01-01", "1999-12-31").drop("ordinal"))


@query(
    f"""with {MARKET}, old as (select d, px as a, case when extract(month from d) % 2 = 0 then px end as b from mkt where d < date '1999-01-01'),
new as (select d, case when extract(month from d) % 3 = 0 then px + 1 end as a, px * 2 as b from mkt where d >= date '1998-01-01'),
m as (select coalesce(o.d, n.d) as d, coalesce(n.a, o.a) as a, coalesce(n.b, o.b) as b from old o full outer join new n on o.d = n.d)
select d, round(last_value(a ignore nulls) over (order by d rows between unbounded preceding and current row), 6) as a, round(last_value(b ignore nulls) over (order by d rows between unbounded preceding and current row), 6) as b from m"""
)
def merged_upsert(spark, sf):
    mkt = D.market(spark, sf)
    old = mkt.filter("d < date '1999-01-01'").select("d", F.col("px").alias("a"), F.when(F.month("d") % 2 == 0, F.col("px")).alias("b"))
    new = mkt.filter("d >= date '1998-01-01'").select("d", F.when(F.month("d") % 3 == 0, F.col("px") + 1).alias("a"), (F.col("px") * 2).alias("b"))
    return P.merged(old, new, "d", ["a", "b"]).select("d", *r6("a", "b"))


@query(
    f"""with {LEDGER}, facts as (select asset, cast(observation_date as timestamp) as observed_at, available_at + interval 1 day * (event_id % 4) as available_at, price as px from ledger),
m as (select distinct asset, cast(observation_date as timestamp) + interval 18 hour as decision_at from ledger),
j as (select m.asset, m.decision_at, f.observed_at, f.available_at, f.px, row_number() over (partition by m.asset, m.decision_at order by f.observed_at desc nulls last, f.available_at desc, f.px desc) as n
from m left join facts f on f.asset = m.asset and f.available_at <= m.decision_at)
select asset, decision_at, observed_at, available_at, px from j where n = 1"""
)
def asof_available(spark, sf):
    rows = D.ledger(spark, sf)
    facts = rows.select("asset", F.col("observation_date").cast("timestamp").alias("observed_at"), (F.col("available_at") + F.make_dt_interval(F.col("event_id") % 4)).alias("available_at"), F.col("price").alias("px"))
    moments = rows.select("asset", (F.col("observation_date").cast("timestamp") + F.expr("interval 18 hours")).alias("decision_at")).distinct()
    facts, moments = (x.withColumns({c: F.col(c).cast("timestamp") for c, t in x.dtypes if t.startswith("timestamp")}) for x in (facts, moments))
    return P.asof(facts, moments)


@query(
    """select user_id, cast(ts as date) as d, max_by(value, (ts, event_id)) filter (where cast(ts as time) <= time '15:00:00') as last_quote, min_by(value, (ts, event_id)) as first_quote, count(*) filter (where cast(ts as time) > time '15:00:00') as n_late
from events group by 1, 2"""
)
def latest_quote_at_cutoff(spark, sf):
    order = F.struct("ts", "event_id")
    early = F.date_format("ts", "HH:mm:ss.SSSSSS") <= "15:00:00.000000"
    return D.table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(
        F.max_by("value", F.when(early, order)).alias("last_quote"), F.min_by("value", order).alias("first_quote"), F.count_if(~early).alias("n_late"),
    )


BRANDS = [f"Brand#{k}" for k in range(1, 26)]


@query(f"with {PANEL} select d, " + ", ".join(f"round(max(case when asset = '{b}' then px end), 6) as {b.replace('Brand#', 'b')}" for b in BRANDS) + " from panel group by d")
def pivot_panel(spark, sf):
    out = P.wide(D.panel(spark, sf), BRANDS)
    return out.select("d", *[F.round(F.col(f"`{n}`"), 6).alias("b" + n.split("#")[1]) for n in BRANDS])


@query(f"with {PANEL} select d, asset, round(px, 6) as px from panel")
def unpivot_panel(spark, sf):
    return rounded(P.long(P.wide(D.panel(spark, sf), BRANDS), BRANDS))


@query("select d from (select cast(l_shipdate as date) as d from lineitem join part on l_partkey = p_partkey where p_brand = 'Brand#11' intersect select cast(o_orderdate as date) from orders where o_orderpriority like '1%')")
def intersect_dates(spark, sf):
    a = D.trades(spark, sf).filter("asset = 'Brand#11'").select(F.col("l_shipdate").cast("date").alias("d"))
    b = D.table(spark, sf, "orders").filter(F.startswith("o_orderpriority", F.lit("1"))).select(F.col("o_orderdate").cast("date").alias("d"))
    return a.intersect(b)


@query("select distinct p_brand as asset from part where p_brand not in (select p_brand from part where p_size > 49)")
def except_assets(spark, sf):
    part = D.table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("asset")).exceptAll(part.filter("p_size > 49").select("p_brand")).distinct().join(part.filter("p_size > 49").select(F.col("p_brand").alias("asset")), "asset", "left_anti")


# ---------------------------------------------------------------- indicators


@query(f"with {RET} select asset, d, round(r, 6) as r from ret")
def returns(spark, sf):
    return D.panel_returns(spark, sf).select("asset", "d", *r6("r"))


@query(f"with {PANEL} select asset, d, " + ", ".join(f"round(px / lag(px, {n}) over (partition by asset order by d) - 1, 6) as momentum_{n}" for n in (5, 10, 20, 60)) + " from panel")
def momentum(spark, sf):
    return D.panel(spark, sf).select("asset", "d", *[F.round(I.momentum(n), 6).alias(f"momentum_{n}") for n in (5, 10, 20, 60)])


@query(f"with {PANEL} select asset, d, round(avg(px) {w(10)}, 6) as sma_lenient, case when count(px) {w(30)} = 30 then round(avg(px) {w(30)}, 6) end as sma_strict from panel")
def sma(spark, sf):
    return D.panel(spark, sf).select("asset", "d", F.round(I.sma(10), 6).alias("sma_lenient"), F.round(I.sma(30, full=True), 6).alias("sma_strict"))


@query(f"with {PANEL}, {ema(10, name='e10')}, {ema(30, name='e30')} select p.asset, p.d, round(e10.v, 6) as ema_10, round(e10.v / e30.v - 1, 6) as ema_ratio from panel p join e10 on p.asset = e10.asset and p.rn = e10.rn join e30 on p.asset = e30.asset and p.rn = e30.rn")
def ema_ratio(spark, sf):
    rows = I.recursive_averages(D.panel(spark, sf))
    return rows.select("asset", "d", F.round("ema_10", 6).alias("ema_10"), F.round(S.div("ema_10", "ema_30") - 1, 6).alias("ema_ratio"))


@query(
    f"""with {PANEL}, {ema(12, name='e12')}, {ema(26, name='e26')}, line as (select e12.asset, e12.rn, e12.v - e26.v as v from e12 join e26 on e12.asset = e26.asset and e12.rn = e26.rn), {ema(9, 'line', 'v', 'sig')}
select p.asset, p.d, round(l.v, 6) as macd, round(s.v, 6) as macd_signal, round(l.v - s.v, 6) as macd_hist from panel p join line l on p.asset = l.asset and p.rn = l.rn join sig s on p.asset = s.asset and p.rn = s.rn"""
)
def macd(spark, sf):
    return I.recursive_averages(D.panel(spark, sf)).select("asset", "d", *r6("macd", "macd_signal", "macd_hist"))


_RSI = f"""with {PANEL}, s as (select *, coalesce(px - lag(px) over (partition by asset order by d), 0) as x from panel),
g as (select asset, d, avg(greatest(x, 0)) {w(14)} as g, avg(greatest(-x, 0)) {w(14)} as l, count(*) {w(14)} as n from s)"""


@query(f"{_RSI} select asset, d, case when n = 14 then round(100 - 100 / (1 + g / nullif(l, 0)), 6) end as rsi from g")
def rsi_strict(spark, sf):
    return I.rsi(D.panel(spark, sf)).select("asset", "d", *r6("rsi"))


@query(f"{_RSI} select asset, d, round(coalesce(case when n = 14 then 100 - 100 / (1 + g / nullif(l, 0)) end, 50), 6) as rsi from g")
def rsi_lenient(spark, sf):
    return I.rsi(D.panel(spark, sf), full=False).select("asset", "d", *r6("rsi"))


_BARS = """bars as (select asset, d, min_by(p, o) as open, max(p) as high, min(p) as low, max_by(p, o) as close from
(select p_brand as asset, cast(date_trunc('week', l_shipdate) as date) as d, 100 * pow(l_extendedprice / l_quantity, 0.1::double) as p, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o from lineitem join part on l_partkey = p_partkey) group by 1, 2)"""


@query(f"with {_BARS}, t as (select *, lag(close) over (partition by asset order by d) as c from bars) select asset, d, round(avg(greatest(high - low, abs(high - c), abs(low - c))) {w(14)}, 6) as atr from t")
def atr(spark, sf):
    return I.atr(D.bars(spark, sf)).select("asset", "d", *r6("atr"))


@query(f"with {PANEL} select asset, d, round(avg(px) {w(20)} - 2 * stddev_samp(px) {w(20)}, 6) as low, round(avg(px) {w(20)}, 6) as mid, round(avg(px) {w(20)} + 2 * stddev_samp(px) {w(20)}, 6) as high from panel")
def bollinger_bands(spark, sf):
    low, mid, high = I.bollinger()
    return D.panel(spark, sf).select("asset", "d", F.round(low, 6).alias("low"), F.round(mid, 6).alias("mid"), F.round(high, 6).alias("high"))


@query(f"with {PANEL}, b as (select *, avg(px) {w(20)} as m, stddev_samp(px) {w(20)} as s, count(px) {w(20)} as n from panel) select asset, d, case when n = 20 then round((px - (m - 2 * s)) / nullif(4 * s, 0), 6) end as pct_b from b")
def bollinger_percent_b(spark, sf):
    return D.panel(spark, sf).select("asset", "d", F.round(I.percent_b(), 6).alias("pct_b"))


@query(f"with {RET} select asset, d, case when count(r) {w(20)} = 20 then round(stddev_samp(r) {w(20)}, 6) end as vol_strict, round(stddev_samp(r) {w(20)}, 6) as vol_lenient, case when count(px) {w(20)} = 20 then round(stddev_samp(px) {w(20)} / nullif(avg(px) {w(20)}, 0), 6) end as price_std from ret")
def rolling_volatility(spark, sf):
    return D.panel_returns(spark, sf).select("asset", "d", F.round(I.volatility(20), 6).alias("vol_strict"), F.round(I.volatility(20, full=False), 6).alias("vol_lenient"), F.round(I.price_dispersion(20), 6).alias("price_std"))


@query(f"with {PANEL} select asset, d, round(px / max(px) over (partition by asset order by d rows unbounded preceding) - 1, 6) as drawdown, round(px / first_value(px) over (partition by asset order by d), 6) as growth from panel")
def drawdown_series(spark, sf):
    return D.panel(spark, sf).select("asset", "d", F.round(I.drawdown(), 6).alias("drawdown"), F.round(I.cumulative_return(), 6).alias("growth"))


@query(f"with {PANEL} select asset, d, round(lead(px, 5) over (partition by asset order by d) / px - 1, 6) as y, lead(d, 5) over (partition by asset order by d) as label_end from panel")
def forward_return_5(spark, sf):
    return D.panel(spark, sf).select("asset", "d", F.round(I.forward_return(5), 6).alias("y"), F.lead("d", 5).over(I.by_asset()).alias("label_end"))


@query(
    f"""with {PANEL}, m as (select asset, d, round(px / lag(px, 20) over (partition by asset order by d) - 1, 6) as m from panel)
select asset, d, case when m is not null then round((rank() over (partition by d, m is null order by m) + (count(*) over (partition by d, m) - 1) / 2.0::double) / count(*) over (partition by d), 6) end as rank_pct,
row_number() over (partition by d order by m nulls first, asset) - 1 as grade from m"""
)
def cross_sectional_rank(spark, sf):
    rows = D.panel(spark, sf).select("asset", "d", F.round(I.momentum(20), 6).alias("m"))
    return rows.select("asset", "d", F.round(I.percentile_rank("m"), 6).alias("rank_pct"), I.relevance("m").alias("grade"))


_MKT = f"""{MARKET}, mr as (select *, px / lag(px) over (order by d) - 1 as r from mkt), mf as (select d, {', '.join(f'px / lag(px, {n}) over (order by d) - 1 as market_ret_{n}' for n in (5, 20, 60))},
case when count(r) over (order by d rows 19 preceding) = 20 then stddev_samp(r) over (order by d rows 19 preceding) end as market_vol_20 from mr)"""


@query(f"with {_MKT} select d, round(market_ret_5, 6) as market_ret_5, round(market_ret_20, 6) as market_ret_20, round(market_ret_60, 6) as market_ret_60, round(market_vol_20, 6) as market_vol_20 from mf")
def market_features(spark, sf):
    return I.market_features(D.market(spark, sf)).select("d", *r6("market_ret_5", "market_ret_20", "market_ret_60", "market_vol_20"))


@query(f"with {RET} select asset, d, rn, round(r, 6) as return_1, round(px / lag(px, 5) over (partition by asset order by d) - 1, 6) as momentum_5, round(px / lag(px, 20) over (partition by asset order by d) - 1, 6) as momentum_20, case when count(r) {w(20)} = 20 then round(stddev_samp(r) {w(20)}, 6) end as volatility_20 from ret")
def serving_features(spark, sf):
    return I.serving_features(D.panel(spark, sf)).select("asset", "d", "rn", *r6("return_1", "momentum_5", "momentum_20", "volatility_20"))


# ---------------------------------------------------------------- statistics

_RF = "(pow(1.06::double, 1.0::double / 252) - 1)"


@query(
    f"""with {RET}, a as (select asset, max_by(px, d) / min_by(px, d) - 1 as t, count(r) as n, stddev_samp(r) * sqrt(252) as v from ret group by 1)
select asset, round(t, 6) as total_return, n, round(v, 6) as ann_vol, round(pow(1 + t, 252.0::double / n) - 1, 6) as ann_return from a"""
)
def asset_summary(spark, sf):
    return stats.asset_summary(D.panel_returns(spark, sf)).select("asset", "n", *r6("total_return", "ann_vol", "ann_return"))


_EW = f"""{RET}, ew as (select rn, d, avg(r) as r from ret where rn > 20 group by 1, 2), nav as (select rn, d, exp(sum(ln(1 + r)) over (order by rn rows unbounded preceding)) as nav from ew)"""


@query(
    f"""with {_EW}, x as (select d, nav, nav / lag(nav) over (order by d) - 1 as r, nav / max(nav) over (order by d rows unbounded preceding) - 1 as dd from nav),
y as (select max_by(nav, d) as f, max_by(nav, d) / min_by(nav, d) - 1 as t, count(r) as n, stddev_samp(r) as s, avg(r - {_RF}) as m, sqrt(avg(case when r - {_RF} < 0 then pow(r - {_RF}, 2) end)) as q, min(dd) as dd from x)
select 'EW' as strategy, round(f, 6) as final_nav, round(t, 6) as total_return, n, round(s * sqrt(252), 6) as ann_vol, round(sqrt(252) * m / s, 6) as sharpe, round(sqrt(252) * m / q, 6) as sortino, round(dd, 6) as max_drawdown,
round(pow(1 + t, 252.0::double / n) - 1, 6) as ann_return, round((pow(1 + t, 252.0::double / n) - 1) / abs(dd), 6) as calmar from y"""
)
def metric_summary_ew(spark, sf):
    rows = D.panel_returns(spark, sf)
    weights = N.equal_weights(N.rebalance_rows(rows), rows.select("asset").distinct())
    out = stats.metric_summary(N.nav_constant(rows, weights))
    return out.select("strategy", "n", *r6("final_nav", "total_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "ann_return", "calmar"))


_WIN = f"""{RET}, t as (select distinct rn as t from panel where rn >= 20 and (rn - 20) % 5 = 0),
wr as (select t.t, r.asset, r.rn, r.r from t join ret r on r.rn between t.t - 18 and t.t + 1 and r.r is not null)"""


def _trailing(spark, sf):
    """Moments of the 20 returns up to each decision: four blocks of five rows."""
    blocks = stats.block_moments(D.panel_returns(spark, sf), 5, first=2)
    return stats.merged_moments(blocks, 4).filter("n = 20").withColumn("t", 5 * F.col("block") + 5)


@query(f"with {_WIN}, c as (select x.t, x.asset as a, y.asset as b, covar_samp(x.r, y.r) as cov, count(*) as n from wr x join wr y on x.t = y.t and x.rn = y.rn group by 1, 2, 3) select t, a, b, round(cov, 8) as cov, n from c where n = 20")
def covariance_20(spark, sf):
    return _trailing(spark, sf).select("t", "a", "b", F.round("cov", 8).alias("cov"), "n")


_DIST = f"""{RET}, whole as (select x.asset as a, y.asset as b, covar_samp(x.r, y.r) / nullif(stddev_samp(x.r) * stddev_samp(y.r), 0) as corr from ret x join ret y on x.rn = y.rn and x.r is not null and y.r is not null group by 1, 2),
dist as (select a, b, round(case when a = b then 0 else least(greatest(1 - coalesce(corr, 0), 0), 2) end, 9) as dist from whole)"""


def _distances(spark, sf):
    rows = D.panel_returns(spark, sf).filter("r is not null").select(F.lit(0).cast("bigint").alias("t"), "asset", "rn", "r")
    return stats.distance(stats.covariance(rows)).withColumn("dist", F.round("dist", 9))


@query(f"with {_DIST} select a, b, round(dist, 6) as dist from dist")
def correlation_distance(spark, sf):
    return _distances(spark, sf).select("a", "b", *r6("dist"))


@query(
    f"""with {_DIST}, pairs as (select x.a as m1, y.a as m2 from (select distinct a from dist) x join (select distinct a from dist) y on x.a < y.a),
cost as (select m1, m2, sum(least(p.dist, q.dist)) as c from pairs join dist p on p.b = m1 join dist q on q.b = m2 and q.a = p.a group by 1, 2), best as (select m1, m2, c from cost order by round(c, 9), m1, m2 limit 1)
select m1 as asset, round(c, 6) as objective from best union all select m2, round(c, 6) from best"""
)
def medoids_k2(spark, sf):
    return selection.medoids(_distances(spark, sf), 2).select("asset", *r6("objective"))


def _best_five(source: str) -> str:
    """The five medoids of each t from source (t, a, b, dist), by all subsets of five."""
    return f"""ids as (select t, a, list(dist order by b) as l from {source} group by 1, 2), r as (select unnest(range(1, (select count(distinct a) from {source}) + 1)) as x),
five as (select a.x as i1, b.x as i2, c.x as i3, d.x as i4, e.x as i5 from r a join r b on a.x < b.x join r c on b.x < c.x join r d on c.x < d.x join r e on d.x < e.x),
cost as (select t, i1, i2, i3, i4, i5, sum(least(l[i1], l[i2], l[i3], l[i4], l[i5])) as c from ids cross join five group by all),
first as (select * from cost qualify row_number() over (partition by t order by round(c, 11), i1, i2, i3, i4, i5) = 1),
medoid as (select t, (select list(a order by a) from (select distinct a from {source}))[i] as asset, c as objective from (select t, c, unnest([i1, i2, i3, i4, i5]) as i from first))"""


@query(f"with {_DIST}, one as (select 0 as t, a, b, dist from dist), {_best_five('one')} select asset, round(objective, 6) as objective from medoid")
def medoids_k5(spark, sf):
    return selection.medoids(_distances(spark, sf), 5).select("asset", *r6("objective"))


_PREFIX = """dec as (select distinct rn as t from panel where rn >= 30 and rn % 20 = 0),
pc as (select t, x.asset as a, y.asset as b, coalesce(covar_samp(x.r, y.r) / nullif(stddev_samp(x.r) * stddev_samp(y.r), 0), 0) as corr, count(*) as n from dec join ret x on x.rn < t and x.r is not null join ret y on y.rn = x.rn and y.r is not null group by 1, 2, 3),
pd as (select t, a, b, round(case when a = b then 0 else least(greatest(1 - corr, 0), 2) end, 9) as dist from pc)"""


def _prefix(spark, sf):
    """Moments of all returns before each reselection (each 20 rows from 30 on): running sums of blocks of 20."""
    rows = D.panel_returns(spark, sf)
    moments = stats.merged_moments(stats.block_moments(rows, 20)).withColumn("t", 20 * F.col("block") + 20)
    due = rows.filter("rn >= 30 and rn % 20 = 0").select(F.col("rn").alias("t")).distinct()
    return moments.join(due, "t", "left_semi").withColumn("corr", F.coalesce("corr", F.lit(0.0)))


def _prefix_distances(spark, sf):
    return stats.distance(_prefix(spark, sf)).withColumn("dist", F.round("dist", 9))


@query(f"with {RET}, {_PREFIX} select t, a, b, round(corr, 6) as corr, n from pc")
def prefix_correlations(spark, sf):
    """Correlation of all pairs over the rows before each reselection."""
    return _prefix(spark, sf).select("t", "a", "b", *r6("corr"), "n")


def _representatives(spark, sf):
    return selection.medoids(_prefix_distances(spark, sf), 5)


_MEDOIDS = f"{RET}, {_PREFIX}, {_best_five('pd')}"


@query(f"with {_MEDOIDS} select t, asset, round(objective, 6) as objective from medoid")
def medoids_by_decision(spark, sf):
    """Five representatives at each reselection, from what was known before it."""
    return _representatives(spark, sf).select("t", "asset", *r6("objective"))


@query(f"with {_MEDOIDS}, n as (select pd.t, a, b, dist, row_number() over (partition by pd.t, a order by dist, b) as k from pd join medoid on medoid.t = pd.t and medoid.asset = pd.b) select t, a as asset, b as representative, round(dist, 6) as dist from n where k = 1")
def nearest_medoid(spark, sf):
    """Each asset's nearest representative at each reselection."""
    distances = D.held(_prefix_distances(spark, sf))
    return selection.nearest(distances, selection.medoids(distances, 5)).select("t", "asset", "representative", *r6("dist"))


_VOLAT = f"""{RET}, v as (select rn as t, asset, round(stddev_samp(r) over (partition by asset order by d rows between 20 preceding and 1 preceding), 9) as vol from ret),
pick as (select t, asset, vol, row_number() over (partition by t order by vol, asset) as rank from v where vol is not null and t >= 30 and t % 20 = 0)"""


def _selected(spark, sf):
    vol = F.round(F.stddev_samp("r").over(I.by_asset().rowsBetween(-20, -1)), 9)
    rows = D.panel_returns(spark, sf).select(F.col("rn").alias("t"), "asset", vol.alias("vol")).filter("t >= 30 and t % 20 = 0")
    return selection.steadiest(rows, 5)


@query(f"with {_VOLAT} select t, asset, round(vol, 6) as vol, rank from pick where rank <= 5")
def simple_selection(spark, sf):
    return _selected(spark, sf).select("t", "asset", "rank", *r6("vol"))


@query(
    f"""with {_VOLAT}, s as (select t, list_sort(list(asset)) as m from pick where rank <= 5 group by 1), l as (select t, m, lag(m) over (order by t) as b from s)
select t, case when b is not null then round(len(list_intersect(m, b)) / len(list_distinct(list_concat(m, b)))::double, 6) end as jaccard, case when b is not null then len(list_filter(m, lambda x: not list_contains(b, x))) end as switched from l"""
)
def selection_changes(spark, sf):
    return selection.changes(_selected(spark, sf)).select("t", F.round("jaccard", 6).alias("jaccard"), "switched")


_RATIO = f"""{RET}, sd as (select asset, d, stddev_samp(r) {w(20)} as s, stddev_samp(r) {w(120)} as l from ret), ratio as (select d, avg(s) / nullif(avg(l), 0) as vol_ratio from sd group by 1)"""


@query(
    f"""with {_RATIO}, m as (select d, avg(r) as m from ret where r is not null group by 1), n as (select d, m, row_number() over (order by d) as k from m),
path as (select x.d, x.k, y.k as j, exp(sum(ln(1 + y.m)) over (partition by x.d order by y.k rows unbounded preceding)) as nav, avg(y.m) over (partition by x.d) as mom from n x join n y on y.k between x.k - 59 and x.k),
dd as (select d, max_by(nav, j) / max(nav) - 1 as dd, max(mom) as mom from path group by 1)
select d, round(vol_ratio, 6) as vol_ratio, round(dd, 6) as drawdown, round(mom, 6) as equity_momentum, case when round(vol_ratio, 9) >= 1.8 or round(dd, 9) <= -0.2 then 'crisis' when round(vol_ratio, 9) >= 1.3 or round(dd, 9) <= -0.1 then 'stress' else 'normal' end as regime
from dd join ratio using (d)"""
)
def regime(spark, sf):
    rows = D.panel_returns(spark, sf)
    out = views.regimes(rows, stats.volatility_ratio(rows))
    return out.select("d", *r6("vol_ratio", "drawdown", "equity_momentum"), "regime")


# ---------------------------------------------------------------- views

_MOM = f"{PANEL}, m as (select rn as t, asset, round(px / lag(px, 20) over (partition by asset order by d) - 1, 9) as mom from panel), mt as (select * from m where mom is not null and t >= 25 and t % 5 = 0)"


def _momenta(spark, sf):
    return D.panel(spark, sf).select(F.col("rn").alias("t"), "asset", F.round(I.momentum(20), 9).alias("mom_20")).filter("mom_20 is not null and t >= 25 and t % 5 = 0")


@query(
    f"""with {_MOM}, p as (select x.t, x.asset as a, y.asset as b, x.mom - y.mom as diff from mt x join mt y on x.t = y.t and x.asset < y.asset)
select t, case when diff > 0 then a else b end || '_over_' || case when diff > 0 then b else a end as name, round(least(0.3, abs(diff) * 252 / 20), 10) as q_annual, round(least(0.8, 0.4 + 10 * abs(diff)), 10) as confidence from p where abs(diff) >= 0.01"""
)
def relative_views(spark, sf):
    return views.relative_views(_momenta(spark, sf)).select("t", "name", *[F.round(c, 10).alias(c) for c in ("q_annual", "confidence")])


@query(
    f"""with {_MOM}, r as (select t, asset, mom, row_number() over (partition by t order by mom desc, asset) - 1 as i, count(*) over (partition by t) as k from mt)
select a.t, a.asset || '_over_' || b.asset as name, round(0.2 / 252 * (b.i - a.i) / a.k, 12) as q_daily, round(least(greatest(0.5 + 2 * (a.mom - b.mom) - 0.5, 0.25), 0.75), 10) as confidence
from r a join r b on a.t = b.t and a.i < greatest(a.k // 2, 1) and b.i >= a.k // 2 + a.i and b.i > a.i"""
)
def ranking_views(spark, sf):
    scores = _momenta(spark, sf).select("t", "asset", F.col("mom_20").alias("score"), F.lit(0.1).alias("std"))
    return views.ranking_views(scores).select("t", "name", F.round("q_daily", 12).alias("q_daily"), F.round("confidence", 10).alias("confidence"))


_FEAT = f"""{PANEL}, {ema(10, name='e10')}, {ema(30, name='e30')}, s as (select *, coalesce(px - lag(px) over (partition by asset order by d), 0) as x from panel),
g as (select asset, d, rn, px, avg(greatest(x, 0)) {w(14)} as g, avg(greatest(-x, 0)) {w(14)} as l, round(px / lag(px, 20) over (partition by asset order by d) - 1, 9) as mom from s),
f as (select g.rn as t, g.asset, round(e10.v / e30.v - 1, 9) as ma, round(coalesce(100 - 100 / (1 + g.g / nullif(g.l, 0)), 50), 9) as rsi, mom from g join e10 on g.asset = e10.asset and g.rn = e10.rn join e30 on g.asset = e30.asset and g.rn = e30.rn where g.rn >= 35 and g.rn % 5 = 0)"""


@query(
    f"""with {_FEAT} select t, case when ma > 0.02 then 'bullish_' else 'bearish_' end || asset as name, round(case when ma > 0.02 then 0.05 + 0.5 * abs(mom) else -0.03 - 0.3 * abs(mom) end, 10) as q_annual,
round(least(greatest(case when ma > 0.02 then 0.6 else 0.5 end * case when rsi > 70 then case when ma > 0.02 then 0.7 else 1.2 end when rsi < 30 then case when ma > 0.02 then 1.2 else 0.7 end else 1 end, 0.3), 0.9), 10) as confidence from f where abs(ma) > 0.02"""
)
def rule_views(spark, sf):
    rows = I.rsi(I.recursive_averages(D.panel(spark, sf)), full=False)
    rows = rows.select(F.col("rn").alias("t"), "asset", F.col("rn").alias("n"), F.round(S.div("ema_10", "ema_30") - 1, 9).alias("ma_ratio"), F.round("rsi", 9).alias("rsi"), F.round(I.momentum(20), 9).alias("mom_20"))
    return views.rule_views(rows.filter("t >= 35 and t % 5 = 0")).select("t", "name", *[F.round(c, 10).alias(c) for c in ("q_annual", "confidence")])


@query(
    f"""with {RET}, v as (select rn as t, asset, round(px / lag(px, 5) over (partition by asset order by d) - 1, 9) as pred, stddev_samp(r) {w(20)} as s, count(r) {w(20)} as n from ret)
select t, 'ml_' || asset as name, round(case when s > 1e-8 and n >= 5 then 0.5 * tanh(pred / (s * sqrt(5))) else least(greatest(pred * 252 / 5, -0.5), 0.5) end, 6) as q_annual from v where abs(pred) >= 0.001"""
)
def model_views(spark, sf):
    rows = D.panel_returns(spark, sf).select(F.col("rn").alias("t"), "asset", F.round(I.momentum(5), 9).alias("pred"), F.lit(0.5).alias("conf"), I.volatility(20, full=False).alias("vol_20"), F.count("r").over(I.trailing(20)).alias("n_obs"))
    return views.model_views(rows).select("t", "name", *r6("q_annual"))


@query(
    f"""with {_RATIO} select d, round(case when vol_ratio > 1.3 then 0.6 * 1.3 / vol_ratio else 0.6 end, 6) as confidence from ratio"""
)
def dampened_confidence(spark, sf):
    rows = stats.volatility_ratio(D.panel_returns(spark, sf)).withColumn("c", F.lit(0.6))
    return rows.select("d", F.round(views.dampened("c", "vol_ratio"), 6).alias("confidence"))


def _assets(panel: DataFrame) -> list[str]:
    return [x.asset for x in panel.select("asset").distinct().orderBy("asset").collect()]


@query()
def view_matrices(spark, sf):
    panel = D.panel(spark, sf)
    momenta = panel.select(F.col("rn").alias("t"), "asset", F.round(I.momentum(20), 9).alias("mom_20")).filter("mom_20 is not null")
    due = momenta.join(N.rebalance_rows(panel).select(F.col("rn").alias("t")), "t")
    return views.matrices(views.combined(views.relative_views(due)), _assets(panel))


# ---------------------------------------------------------------- portfolios

_IV = f"""{RET}, vol as (select asset, rn, stddev_samp(r) {w(20)} as vol from ret), dec as (select distinct rn from panel where rn >= 25 and (rn - 25) % 5 = 0),
iv as (select v.rn, v.asset, (1 / vol) / sum(1 / vol) over (partition by v.rn) as w from vol v join dec using (rn) where vol > 0)"""


def _iv_weights(spark, sf):
    rows = D.panel_returns(spark, sf)
    vol = rows.select("asset", "rn", F.stddev_samp("r").over(I.trailing(20)).alias("vol"))
    return rows, N.inverse_volatility_weights(N.rebalance_rows(rows, 25), vol)


@query(f"with {_IV} select rn, asset, round(w, 6) as w from iv")
def inverse_volatility_weights(spark, sf):
    return _iv_weights(spark, sf)[1].select("rn", "asset", *r6("w"))


@query(f"with {_IV}, day as (select r.rn, r.d, sum(iv.w * r.r) as r from ret r join iv on iv.asset = r.asset and iv.rn = 25 + 5 * ((r.rn - 26) // 5) where r.rn > 25 group by 1, 2) select rn, d, round(r, 6) as r, round(exp(sum(ln(1 + r)) over (order by rn rows unbounded preceding)), 6) as nav from day")
def nav_legacy(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    return N.nav_constant(rows, weights).select("rn", "d", *r6("r", "nav"))


_DRIFT = f"""{_IV}, lastrow as (select max(rn) as last from panel), h as (select iv.rn + 1 as e, least(iv.rn + 6, last) as n, p.asset, p.rn, p.d, iv.w, iv.w * p.px / q.px as value from iv join lastrow on iv.rn + 1 <= last
join panel p on p.asset = iv.asset and p.rn between iv.rn + 1 and iv.rn + 6 join panel q on q.asset = iv.asset and q.rn = iv.rn + 1),
g as (select e, n, rn, d, sum(value) + 1 - sum(w) as g from h group by 1, 2, 3, 4), base as (select n as e, exp(sum(ln(g)) over (order by n rows unbounded preceding)) as base from g where rn = n and n > e)"""


@query(f"with {_DRIFT} select g.rn, g.d, round(coalesce(base, 1) * g, 6) as nav from g left join base on g.e = base.e where g.rn > g.e or g.n = g.e")
def nav_drift(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    return N.nav_drifting(rows, weights).select("rn", "d", *r6("nav"))


_TURN = f"""{_DRIFT}, pre as (select n as e, asset, value / (sum(value) over (partition by h.e, n) + 1 - sum(w) over (partition by h.e, n)) as pre from h where rn = n and n > e),
turn as (select h.e, h.d, sum(abs(h.w - coalesce(pre, 0))) as notional, sum(h.w - coalesce(pre, 0)) as net from h left join pre on pre.e = h.e and pre.asset = h.asset where h.rn = h.e group by 1, 2)"""


@query(f"with {_TURN} select e, d, round(notional, 6) as notional, round((notional + abs(net)) / 2, 6) as turnover, e = (select min(e) from turn) as initial from turn")
def turnover(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    return N.turnover(rows, weights).select("e", "d", *r6("notional", "turnover"), "initial")


@query(
    f"""with {_TURN}, nav as (select g.rn, g.d, coalesce(base, 1) * g as nav from g left join base on g.e = base.e where g.rn > g.e or g.n = g.e), day as (select rn, d, nav / lag(nav, 1, 1) over (order by rn) - 1 as g from nav)
select b.bps::double as bps, count(*) as n, round(sum(ln((1 + day.g) * (1 - b.bps / 1e4 * coalesce(t.notional, 0)))), 6) as log_growth from day left join turn t on t.d = day.d cross join (select unnest([0, 10, 25, 50]) as bps) b group by 1"""
)
def cost_grid(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    held = D.held(N.holdings(rows, weights))
    daily = N.path(held).select("strategy", "d", (F.col("nav") / F.lag("nav", 1, 1.0).over(Window.partitionBy("strategy").orderBy("rn")) - 1).alias("g"))
    out = N.costs(daily, N.traded(held), 0, 10, 25, 50)
    return out.groupBy("bps").agg(F.count("*").alias("n"), F.round(F.sum(F.log1p("net")), 6).alias("log_growth"))


@query(f"with {_IV}, k as (select rn, asset, case when w >= 0.04 then w else 0 end as k from iv) select rn, asset, round(case when sum(k) over (partition by rn) > 0 then k / sum(k) over (partition by rn) else 1.0 / count(*) over (partition by rn) end, 6) as w from k")
def prune_small_weights(spark, sf):
    return N.pruned(_iv_weights(spark, sf)[1], 0.04).select("rn", "asset", *r6("w"))


@query(
    f"""with {_IV} select rn, round(abs(sum(w) - 1), 6) as budget, round(greatest(-min(w), 0), 6) as negative, round(greatest(max(w) - 0.05, 0), 6) as cap,
round(greatest(sum(case when asset not in ('Brand#11', 'Brand#12') then w else 0 end) - 0.7, 0), 6) as group_cap, round(greatest(0.15 - sum(case when asset in ('Brand#11', 'Brand#12') then w else 0 end), 0), 6) as floor from iv group by 1"""
)
def constraint_residuals(spark, sf):
    out = N.residuals(_iv_weights(spark, sf)[1], ["Brand#11", "Brand#12"], cap=0.05)
    return out.select("rn", *r6("budget", "negative", "cap", "group_cap", "floor"))


@query(f"with {_IV}, h as (select rn, sum(w * w) as h from iv group by 1) select 'IV' as strategy, round(avg(h), 6) as hhi, round(avg(1 / h), 6) as effective from h")
def concentration(spark, sf):
    return N.concentration(_iv_weights(spark, sf)[1]).select("strategy", *r6("hhi", "effective"))


def _moments(spark, sf):
    return _trailing(spark, sf).select(F.col("t").alias("rn"), "a", "b", "mean", "cov")


POLICY = optimize.Policy(1.5, 0.5, ("Brand#11", "Brand#12"), 0.15, 0.70)


@query()
def mean_variance_weights(spark, sf):
    return optimize.solved(_moments(spark, sf), POLICY)


@query()
def paired_bootstrap(spark, sf):
    """Moving-block bootstrap of the Sharpe difference of two paths; the same blocks for both."""
    rows, weights = _iv_weights(spark, sf)
    ew = N.equal_weights(N.rebalance_rows(rows, 25), rows.select("asset").distinct())
    daily = N.nav_constant(rows, weights.unionByName(ew)).groupBy("rn").pivot("strategy", ["IV", "EW"]).agg(F.first("r")).agg(F.array_sort(F.collect_list(F.struct("rn", "IV", "EW"))).alias("x"))
    reps = spark.range(1000).join(F.broadcast(daily))

    def run(batches):
        for pdf in batches:
            out = []
            for rep, x in zip(pdf["id"], pdf["x"], strict=True):
                r = np.array([[v["IV"], v["EW"]] for v in x])
                rng = np.random.default_rng([20261014, int(rep)])
                starts = rng.integers(0, len(r) - 9, -(-len(r) // 10))
                s = r[(starts[:, None] + np.arange(10)).ravel()[: len(r)]]
                sharpe = np.sqrt(252) * s.mean(axis=0) / s.std(axis=0, ddof=1)
                out.append(sharpe[0] - sharpe[1])
            yield pd.DataFrame({"effect": out})

    return reps.mapInPandas(run, "effect double").agg(F.count("*").alias("reps"), F.avg("effect").alias("mean"), F.percentile("effect", F.array(F.lit(0.025), F.lit(0.975))).alias("interval"))


# ---------------------------------------------------------------- forecasting


def _ml_rows(spark, sf):
    return ml.temporal_split(ml.labelled(I.ml_features(D.panel(spark, sf))))


@query(
    f"""with {PANEL}, l as (select asset, rn, lead(rn, 5) over (partition by asset order by rn) as e from panel where rn >= 30), k as (select *, row_number() over (partition by asset order by rn) as i, floor(count(*) over (partition by asset) * 0.8::double) as n from l where e is not null),
v as (select asset, min(rn) as v from k where i > n group by 1) select asset, count(*) filter (where i <= n and e < v) as n_train, count(*) filter (where i <= n and e >= v) as n_purged, count(*) filter (where i > n) as n_validation from k join v using (asset) group by 1"""
)
def embargo_split(spark, sf):
    return _ml_rows(spark, sf).groupBy("asset").agg(F.count_if(F.col("fold") == "train").alias("n_train"), F.count_if(F.col("fold") == "purged").alias("n_purged"), F.count_if(F.col("fold") == "validation").alias("n_validation"))


@query(f"with {RET}, f as (select asset, r, px / lag(px, 5) over (partition by asset order by d) - 1 as m from ret) select asset, round(avg(r), 6) as r_mean, round(coalesce(nullif(stddev_pop(r), 0), 1), 6) as r_sd, round(avg(m), 6) as m_mean, round(coalesce(nullif(stddev_pop(m), 0), 1), 6) as m_sd from f group by 1")
def scaler_fit(spark, sf):
    rows = D.panel_returns(spark, sf).select("asset", "r", I.momentum(5).alias("m"))
    return ml.scaler(rows, ["r", "m"]).select("asset", *r6("r_mean", "r_sd", "m_mean", "m_sd"))


@query()
def ensemble_forecasts(spark, sf):
    rows = _ml_rows(spark, sf)
    latest = I.ml_features(D.panel(spark, sf)).withColumn("_l", F.max("rn").over(Window.partitionBy("asset"))).filter("rn = _l").drop("_l")
    latest = latest.withColumn("y", F.lit(None).cast("double")).withColumn("label_rn", F.lit(None).cast("bigint")).withColumn("fold", F.lit("latest"))
    out = ml.ensemble_forecasts(rows.unionByName(latest), ml.ML_FEATURES)
    return out.withColumn("confidence", ml.ensemble_confidence())


@query()
def ranker_scores(spark, sf):
    """Pairwise ranker trained anew each 60 rows, on the 100 rows before whose labels are known, and scored then."""
    columns = ["momentum_5", "momentum_20", "momentum_60", "vol_20", "rank_momentum_5", "rank_overall"]
    feats = I.ranking_features(D.panel(spark, sf), D.market(spark, sf))
    y = D.panel(spark, sf).select("asset", "d", I.forward_return(5).alias("y"))
    rows = feats.join(y, ["asset", "d"]).withColumn("grade", I.relevance("y").cast("double"))
    turns = F.expr("filter(sequence(rn - rn % 60, rn + 180, 60), t -> t >= 180 and (t = rn or rn between t - 104 and t - 5))")
    rows = rows.withColumn("t", F.explode(turns)).withColumn("grade", F.when(F.col("rn") < F.col("t"), F.col("grade")))
    return ml.ranker_scores(rows.select("t", "d", "asset", "grade", *columns), columns)


@query(
    f"""with {RET}, g as (select asset, rn, case when lead(px, 5) over (partition by asset order by d) is not null then sign(r) = sign(lead(px, 5) over (partition by asset order by d) - px) end as correct, case when rn % 2 = 0 then 'rule' else 'ml' end as kind, case when rn < 200 then 'IS' else 'OOS' end as phase from ret where r is not null)
select kind, phase, coalesce(asset, 'Overall') as asset, count(*) as n_issued, count(correct) as n_scored, count(*) - count(correct) as n_unmatured, sum(correct::int)::bigint as n_correct, round(avg(correct::int), 6) as rate from g group by grouping sets ((kind, phase), (kind, phase, asset))"""
)
def hit_rate_grouping_sets(spark, sf):
    later = F.lead("px", 5).over(I.by_asset())
    rows = D.panel_returns(spark, sf).withColumn("change", later - F.col("px")).withColumn("correct", stats.same_sign("r", "change")).filter("r is not null")
    rows = rows.withColumn("kind", F.when(F.col("rn") % 2 == 0, "rule").otherwise("ml")).withColumn("phase", F.when(F.col("rn") < 200, "IS").otherwise("OOS"))
    return stats.hit_rate(rows).withColumn("rate", F.round("rate", 6))


# ---------------------------------------------------------------- price store


def _batch(spark, sf, batch=None):
    e = D.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 40 if batch is None else batch).alias("batch"), F.col("event_id").alias("row_number"), F.when(F.col("event_id") % 97 == 0, "bad id!").otherwise(F.concat(F.lit("A"), F.col("user_id").cast("string"))).alias("asset"),
        F.col("ts").cast("date").alias("observation_date"), F.col("event_type").alias("provider"), F.lit("close").alias("price_type"), F.lit("stock").alias("kind"),
        F.when(F.col("event_id") % 89 == 0, "usd").otherwise("vnd").alias("source_unit"), F.when(F.col("event_id") % 3 == 0, "raw_close").alias("price_basis"), F.when(F.col("event_id") % 83 == 0, -1.0).otherwise(F.col("value") + 1).alias("price"),
    )


_BATCH = """batch as (select user_id % 40 as batch, event_id as row_number, case when event_id % 97 = 0 then 'bad id!' else 'A' || user_id end as asset, cast(ts as date) as od, event_type as provider, case when event_id % 89 = 0 then 'usd' else 'vnd' end as unit, case when event_id % 3 = 0 then 'raw_close' end as basis, case when event_id % 83 = 0 then -1 else value + 1 end as price from events),
q as (select *, row_number() over (partition by batch, asset, od, provider order by row_number) as k from batch),
f as (select batch, row_number, 'INVALID_ID' as code, 'error' as severity from q where not regexp_matches(asset, '^[A-Z0-9_-]{1,64}$') union all select batch, row_number, 'INVALID_PRICE', 'error' from q where price is null or price <= 0 union all select batch, row_number, 'FUTURE_DATE', 'error' from q where od > date '2024-01-28'
union all select batch, row_number, 'UNIT_MISMATCH', 'error' from q where unit <> 'vnd' union all select batch, row_number, 'DUPLICATE_KEY', 'error' from q where k > 1 union all select batch, row_number, 'UNKNOWN_BASIS', 'warning' from q where basis is null)"""


@query(f"with {_BATCH} select * from f")
def quality_findings(spark, sf):
    return store.quality_findings(_batch(spark, sf), "2024-01-28")


_DAILY = _BATCH.replace("select user_id % 40 as batch", "select user_id || '/' || strftime(ts, '%Y-%m-%d') as batch")


@query(f"with {_DAILY} select batch, row_number, asset from batch where batch not in (select batch from f where severity = 'error')")
def quarantine_batches(spark, sf):
    """One batch for each user and day: any error keeps the whole batch out."""
    rows = _batch(spark, sf, F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    return store.accepted(rows, store.quality_findings(rows, "2024-01-28")).select("batch", "row_number", "asset")


_REV = f"""{LEDGER}, b as (select asset, observation_date, available_at, event_id, floor(price / 50) as price, lag(floor(price / 50)) over (partition by asset, observation_date order by available_at, event_id) as before, row_number() over (partition by asset, observation_date order by available_at, event_id) as k from ledger),
rev as (select asset, observation_date, available_at, event_id, price, row_number() over (partition by asset, observation_date order by available_at, event_id) as revision from b where k = 1 or before is distinct from price)"""


def _revised(spark, sf):
    rows = D.ledger(spark, sf).withColumn("price", F.floor(F.col("price") / 50).cast("double"))
    return store.revisions(rows, ["asset", "observation_date"], ["price"], ["available_at", "event_id"])


@query(f"with {_REV} select asset, observation_date, event_id, price::double as price, revision from rev")
def change_detection_revisions(spark, sf):
    return _revised(spark, sf).select("asset", "observation_date", "event_id", "price", "revision")


_SNAP = f"""{_REV}, snap as (select * from (select *, row_number() over (partition by asset, observation_date order by available_at desc, revision desc) as n from rev where available_at <= timestamp '2024-01-20 12:00:00') where n = 1)"""


def _snapshot(spark, sf):
    return store.snapshot(_revised(spark, sf), "2024-01-20 12:00:00", ["asset", "observation_date"])


@query(f"with {_SNAP} select asset, observation_date, price::double as price, revision from snap")
def snapshot_asof(spark, sf):
    return _snapshot(spark, sf).select("asset", "observation_date", "price", "revision")


@query(f"with {_SNAP}, g as (select asset, observation_date, date_diff('day', lag(observation_date) over (partition by asset order by observation_date), observation_date) as gap from snap) select asset, count(*) as n, min(observation_date) as first_day, max(observation_date) as last_day, max(gap) as max_gap, date_diff('day', max(observation_date), date '2024-01-20') > 3 as stale, coalesce(max(gap) > 3, false) as gapped from g group by 1")
def snapshot_checks(spark, sf):
    return store.snapshot_checks(_snapshot(spark, sf), "2024-01-20", 3)


@query("with h as (select user_id, cast(ts as date) as d from events group by 1, 2), a as (select distinct d from h) select 'A' || u.user_id as asset, a.d, 'MISSING' as code from (select distinct user_id from h) u cross join a left join h on h.user_id = u.user_id and h.d = a.d where h.d is null")
def missing_sessions(spark, sf):
    have = D.ledger(spark, sf).select("asset", F.col("observation_date").alias("d"))
    return store.missing_sessions(have, have.select("d").distinct())


@query("select o_custkey as universe, o_orderkey as entry_id, case when o_orderdate + interval 90 day >= timestamp '2001-06-01' then 'READY' else 'EXPIRED' end as status from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_per_group(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("universe"), F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("decision_at"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_until"))
    return store.readiness(o, "2001-06-01 00:00:00").select("universe", "entry_id", "status")


# ---------------------------------------------------------------- relational pieces


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderdate >= timestamp '2001-01-01') and c_acctbal > 0")
def not_exists_due(spark, sf):
    live = D.table(spark, sf, "orders").filter("o_orderdate >= timestamp '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey").join(live, "c_custkey", "left_anti")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def page_offset_limit(spark, sf):
    return D.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").offset(100).limit(50)


@query("select coalesce(a.k, b.k) as nation, coalesce(a.w, 0) as first_w, coalesce(b.w, 0) as second_w from (select c_nationkey as k, count(*) as w from customer where c_mktsegment = 'BUILDING' group by 1) a full outer join (select s_nationkey as k, count(*) as w from supplier group by 1) b on a.k = b.k")
def allocation_compare(spark, sf):
    a = D.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("first_w"))
    b = D.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("second_w"))
    return a.join(b, "nation", "full_outer").select("nation", F.coalesce("first_w", F.lit(0)).alias("first_w"), F.coalesce("second_w", F.lit(0)).alias("second_w"))


@query("select event_id, user_id, json_extract(props, '$.k')::bigint as k from events where json_extract(props, '$.k')::bigint = 42")
def json_path_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return D.table(spark, sf, "events").select("event_id", "user_id", k.alias("k")).filter("k = 42")


@query("select p_partkey, p_name from part where contains(lower(p_name), lower('A')) and starts_with(p_brand, 'Brand#1') and p_size in (1, 5, 9)")
def text_predicates(spark, sf):
    rows = D.table(spark, sf, "part").filter(F.contains(F.lower("p_name"), F.lit("a")) & F.startswith("p_brand", F.lit("Brand#1")) & F.col("p_size").isin(1, 5, 9))
    return rows.select("p_partkey", "p_name")


@query("select p_brand as asset, median(p_retailprice) as median, min(p_retailprice) as low, round(quantile_cont(p_retailprice, 0.25), 6) as q25, round(quantile_cont(p_retailprice, 0.75), 6) as q75, max(p_retailprice) as high from part group by 1")
def seed_distribution(spark, sf):
    p = "p_retailprice"
    return D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.median(p).alias("median"), F.min(p).alias("low"), F.round(F.percentile(p, F.lit(0.25)), 6).alias("q25"), F.round(F.percentile(p, F.lit(0.75)), 6).alias("q75"), F.max(p).alias("high"))


@query(
    """with e as (select *, max(ts) over () as now from events) select user_id, count(*) filter (where event_type = 'error') as pending, count(*) filter (where ts > now - interval 1 hour) as recent, count(*) filter (where ts >= date_trunc('day', now)) as today, max(n) as most_in_a_day
from e join (select user_id, max(n) as n from (select user_id, count(*) as n from events group by user_id, cast(ts as date)) group by 1) using (user_id) group by 1"""
)
def quota_counts(spark, sf):
    """Per user what is open, what was asked in the hour and on the day before the newest event, and the most of a day."""
    e = D.table(spark, sf, "events")
    each = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    daily = each.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(
        F.count_if(F.col("event_type") == "error").alias("pending"), F.count_if(F.col("ts") > F.col("now") - F.expr("interval 1 hour")).alias("recent"), F.count_if(F.col("ts") >= F.date_trunc("day", "now")).alias("today"), F.count("*").alias("n"),
    )
    return daily.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("pending", "recent", "today")], F.max("n").alias("most_in_a_day"))


@query("with l as (select cast(l_shipdate as date) as d, sum(l_extendedprice) as s from lineitem group by 1), o as (select cast(o_orderdate as date) as d, sum(o_totalprice) as t from orders group by 1) select count(*) as n_common, round(corr(s, t), 6) as corr, round(max(abs(s / t - 1)), 4) as max_gap from l join o using (d)")
def common_dates_compare(spark, sf):
    a = D.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_extendedprice").alias("s"))
    b = D.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("t"))
    corr = S.div(F.covar_samp("s", "t"), F.stddev_samp("s") * F.stddev_samp("t"))
    return a.join(b, "d").agg(F.count("*").alias("n_common"), F.round(corr, 6).alias("corr"), F.round(F.max(F.abs(S.div("s", "t") - 1)), 4).alias("max_gap"))


@query(
    """with a as (select p_brand as asset, cast(date_trunc('week', l_shipdate) as date) as d, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2), b as (select asset, d, case when isodow(d) = 1 and extract(month from d) = 2 then n + 1 else n end as n from a where extract(year from d) < 2001)
select (select count(*) from (select * from a except all select * from b)) as only_first, (select count(*) from (select * from b except all select * from a)) as only_second"""
)
def two_run_equality(spark, sf):
    """Two runs of which the second lacks the last year and differs in each February."""
    a = D.trades(spark, sf).groupBy("asset", F.date_trunc("week", "l_shipdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    b = a.filter(F.year("d") < 2001).withColumn("n", F.when(F.month("d") == 2, F.col("n") + 1).otherwise(F.col("n")))
    return stats.only_in_one(a, b)


@query("select * from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as back from (select distinct conv_id, turn, role from conversations)) where back <= 4")
def last_n_context(spark, sf):
    rows = D.table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    return rows.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("bigint")).filter("back <= 4")


@query("select user_id, row_number() over (partition by user_id order by ts, event_id) as sequence, event_id from events qualify sequence > 3")
def cursor_tail(spark, sf):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return D.table(spark, sf, "events").select("user_id", seq.alias("sequence"), "event_id").filter("sequence > 3")


@query("select event_id % 2000 as event_id, min(ts) as ts from events group by 1")
def inbox_dedup(spark, sf):
    rows = D.table(spark, sf, "events").select((F.col("event_id") % 2000).alias("event_id"), "ts")
    return jobs.inbox_batch(rows)


@query("with k as (select user_id, props, event_type, row_number() over (partition by user_id, props order by ts, event_id) as n, first_value(event_type) over (partition by user_id, props order by ts, event_id) as f from events) select user_id, count(*) filter (where n = 1) as created, count(*) filter (where n > 1 and event_type = f) as replayed, count(*) filter (where n > 1 and event_type <> f) as conflicts from k group by 1")
def idempotent_submission(spark, sf):
    by = Window.partitionBy("user_id", "props").orderBy("ts", "event_id")
    rows = D.table(spark, sf, "events").withColumn("n", F.row_number().over(by)).withColumn("f", F.first("event_type").over(by))
    same = F.col("event_type") == F.col("f")
    return rows.groupBy("user_id").agg(F.count_if(F.col("n") == 1).alias("created"), F.count_if((F.col("n") > 1) & same).alias("replayed"), F.count_if((F.col("n") > 1) & ~same).alias("conflicts"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_counts(spark, sf):
    out = jobs.windowed(D.table(spark, sf, "events"), "1 hour")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def job_state_machine(spark, sf):
    names = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").otherwise("tick")
    return jobs.job_states_batch(D.table(spark, sf, "events").select((F.col("event_id") % 500).alias("job_id"), names.alias("event"), "ts"))


@query("select c_custkey, case when s <= 1 then 'conservative' when s = 2 then 'balanced' else 'growth' end as profile, case when s <= 1 then 6.0 when s = 2 then 3.0 else 1.5 end::double as aversion from (select c_custkey, least(1 + c_custkey % 3, 1 + c_nationkey % 3, 2 + c_custkey % 2, 3) as s from customer)")
def risk_profiles(spark, sf):
    c = D.table(spark, sf, "customer").withColumns({"h": 1 + F.col("c_custkey") % 3, "l": 1 + F.col("c_nationkey") % 3, "o": 2 + F.col("c_custkey") % 2, "x": F.lit(3)})
    name, aversion = S.risk_profile("h", "l", "o", "x")
    return c.select("c_custkey", name.alias("profile"), aversion.alias("aversion"))


@query("select s_suppkey, c_custkey, c_acctbal from (select s_suppkey, c_custkey, c_acctbal, row_number() over (partition by s_suppkey order by c_acctbal desc, c_custkey) as n from supplier join customer on s_nationkey = c_nationkey) where n <= 3")
def top_k_per_group(spark, sf):
    s, c = D.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), D.table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("k"))
    top = c.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("c_acctbal"), "c_custkey"))).filter("n <= 3")
    return s.join(top, "k").select("s_suppkey", "c_custkey", "c_acctbal")


def _all() -> None:
    from . import queries_paths, queries_store, queries_tables  # noqa: F401  they add theirs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_ORACLES)
