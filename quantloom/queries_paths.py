"""Named queries of portfolios, experiments, views and learning beyond the first set, each with its DuckDB
equivalent where SQL can say it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import experiments as X
from .operators import indicators as I
from .operators import learning, ml, optimize, runs, selection, serving, stats, views, walkforward
from .operators import portfolio as N
from .oracle import PANEL, RET, ema, w
from .plans import derived as D
from .queries import _DRIFT, _EW, _IV, _MKT, _MOM, _RATIO, _TURN, _VOLAT, _MEDOIDS, _PREFIX, POLICY, _assets, _prefix, _prefix_distances, _representatives, _iv_weights, _momenta, _moments, _selected, query, r6
from .session import shared_folder
from .sources import files, market

# ---------------------------------------------------------------- features

_RANK = "case when {m} is not null then round((rank() over (partition by d, {m} is null order by {m}) + (count(*) over (partition by d, {m}) - 1) / 2.0::double) / count(*) over (partition by d), 6) end as {n}"
_LINES = f"{ema(12, name='e12')}, {ema(26, name='e26')}, line as (select e12.asset, e12.rn, e12.v - e26.v as v from e12 join e26 on e12.asset = e26.asset and e12.rn = e26.rn), {ema(9, 'line', 'v', 'sig')}, hist as (select line.asset, line.rn, line.v - sig.v as h from line join sig on line.asset = sig.asset and line.rn = sig.rn)"
_STEP = f"st as (select *, coalesce(px - lag(px) over (partition by asset order by d), 0) as x from ret), gl as (select *, avg(greatest(x, 0)) {w(14)} as g, avg(greatest(-x, 0)) {w(14)} as l, count(*) {w(14)} as n14, avg(px) {w(20)} as m20, stddev_samp(px) {w(20)} as s20, count(px) {w(20)} as n20 from st)"


@query(
    f"""with {RET.replace('round(px / lag(px) over (partition by asset order by d) - 1, 10)', 'px / lag(px) over (partition by asset order by d) - 1')}, {_MKT}, {_LINES}, {_STEP},
f as (select gl.asset, gl.d, gl.rn, {', '.join(f'round(px / lag(px, {n}) over (partition by gl.asset order by gl.d) - 1, 9) as momentum_{n}' for n in (5, 20, 60))}, {', '.join(f'case when count(r) over (partition by gl.asset order by gl.d rows {n - 1} preceding) = {n} then round(stddev_samp(r) over (partition by gl.asset order by gl.d rows {n - 1} preceding), 9) end as vol_{n}' for n in (20, 60))},
case when n14 = 14 then 100 - 100 / (1 + g / nullif(l, 0)) end as rsi, h as macd_hist, case when n20 = 20 then (px - (m20 - 2 * s20)) / nullif(4 * s20, 0) end as pct_b from gl join hist on hist.asset = gl.asset and hist.rn = gl.rn),
k as (select *, {_RANK.format(m='momentum_5', n='rank_momentum_5')}, {_RANK.format(m='momentum_20', n='rank_momentum_20')}, {_RANK.format(m='momentum_60', n='rank_momentum_60')}, {_RANK.format(m='vol_20', n='rank_vol')} from f)
select asset, k.d, rn, momentum_5, momentum_20, momentum_60, vol_20, vol_60, round(rsi, 4) as rsi, round(macd_hist, 5) as macd_hist, round(pct_b, 5) as pct_b,
round(market_ret_5, 6) as market_ret_5, round(market_ret_20, 6) as market_ret_20, round(market_ret_60, 6) as market_ret_60, round(market_vol_20, 6) as market_vol_20, rank_momentum_5, rank_momentum_20, rank_momentum_60, rank_vol, round((rank_momentum_5 + rank_momentum_20 + rank_momentum_60) / 3, 5) as rank_overall from k left join mf on mf.d = k.d"""
)
def ranking_features(spark, sf):
    rows = I.ranking_features(D.panel(spark, sf), D.market(spark, sf), digits=9)
    nine = ["momentum_5", "momentum_20", "momentum_60", "vol_20", "vol_60"]
    six = [c for c in rows.columns if c not in ("asset", "d", "rn", "rsi", "macd_hist", "pct_b", "rank_overall", *nine)]
    return rows.select("asset", "d", "rn", *nine, *r6(*six), F.round("rsi", 4).alias("rsi"), F.round("macd_hist", 5).alias("macd_hist"), F.round("pct_b", 5).alias("pct_b"), F.round("rank_overall", 5).alias("rank_overall"))


@query(
    f"""with {RET.replace('round(px / lag(px) over (partition by asset order by d) - 1, 10)', 'px / lag(px) over (partition by asset order by d) - 1')}, {_LINES}, {_STEP}, {ema(10, name='e10')}, {ema(30, name='e30')},
f as (select gl.*, {', '.join(f'coalesce(px / lag(px, {n}) over (partition by asset order by d) - 1, 0) as momentum_{n}' for n in (5, 10, 20))}, stddev_samp(r) {w(20)} as vol from gl)
select f.asset, f.d, f.rn, round(f.px, 6) as px, round(momentum_5, 6) as momentum_5, round(momentum_10, 6) as momentum_10, round(momentum_20, 6) as momentum_20, round(coalesce(case when n14 = 14 then 100 - 100 / (1 + g / nullif(l, 0)) end, 50), 4) as rsi,
round(e10.v / e30.v - 1, 6) as ma_ratio, round(vol, 6) as vol_20, round(h, 5) as macd_hist, case when n20 = 20 then round(s20 / nullif(m20, 0), 6) end as price_std_20
from f join hist on hist.asset = f.asset and hist.rn = f.rn join e10 on e10.asset = f.asset and e10.rn = f.rn join e30 on e30.asset = f.asset and e30.rn = f.rn where f.rn >= 30"""
)
def ml_features(spark, sf):
    rows = I.ml_features(D.panel(spark, sf))
    return rows.select("asset", "d", "rn", *r6("px", "momentum_5", "momentum_10", "momentum_20", "ma_ratio", "vol_20", "price_std_20"), F.round("rsi", 4).alias("rsi"), F.round("macd_hist", 5).alias("macd_hist"))


@query(f"with {PANEL}, f as (select *, px / lag(px, 20) over (partition by asset order by d) - 1 as m, lead(px, 5) over (partition by asset order by d) / px - 1 as y from panel), g as (select *, count(case when m is not null and y is not null then 1 end) over (partition by d) as known, count(*) over (partition by d) as k from f) select d, asset, rn, round(m, 6) as m, round(y, 6) as y, row_number() over (partition by d order by asset) as place from g where known = k")
def training_pairs(spark, sf):
    """Features with labels on the days that have both for every asset, in a fixed order."""
    panel = D.panel(spark, sf)
    feats = panel.select("asset", "d", "rn", I.momentum(20).alias("m")).filter("m is not null")
    labels = panel.select("asset", "d", I.forward_return(5).alias("y")).filter("y is not null")
    return learning.complete_days(feats.join(labels, ["asset", "d"]), panel.select("asset")).select("d", "asset", "rn", *r6("m", "y"), "place")


# ---------------------------------------------------------------- paths

_RF = "(pow(1.06::double, 1.0::double / 252) - 1)"


def _stats_sql(source: str, key: str) -> str:
    """Statistics of returns (key, o, r), o in order."""
    return f"""nv as (select *, exp(sum(ln(1 + r)) over (partition by {key} order by o rows unbounded preceding)) as nav from {source}), dd as (select *, nav / greatest(max(nav) over (partition by {key} order by o rows unbounded preceding), 1) - 1 as dd from nv),
st as (select {key}, max_by(nav, o) as final_nav, count(*) as n_returns, stddev_samp(r) * sqrt(252) as ann_volatility, (avg(r) - {_RF}) * 252 / (stddev_samp(r) * sqrt(252)) as sharpe, least(min(dd), 0) as max_drawdown from dd group by 1)"""


@query(
    f"""with {_EW}, x as (select case when rn <= 200 then 'IS' else 'OOS' end as phase, rn as o, r from ew), {_stats_sql('x', 'phase')}
select phase, n_returns, round(final_nav, 6) as final_nav, round(ann_volatility, 6) as ann_volatility, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(pow(final_nav, 252.0::double / n_returns) - 1, 6) as ann_return from st"""
)
def return_statistics(spark, sf):
    rows = D.panel_returns(spark, sf)
    nav = N.nav_constant(rows, N.equal_weights(N.rebalance_rows(rows), rows.select("asset").distinct()))
    parts = nav.select(F.when(F.col("rn") <= 200, "IS").otherwise("OOS").alias("phase"), "d", "r")
    return X.return_stats(parts, ["phase"]).select("phase", "n_returns", *r6(*X.METRICS))


@query(f"with {_EW}, a as (select nav as n0 from nav where rn = 200), p as (select d, rn, nav, 'IS' as phase from nav where rn <= 200 union all select d, rn, nav, 'OOS' from nav where rn >= 200) select phase, d, round(nav / first_value(nav) over (partition by phase order by d), 6) as nav from p")
def phase_paths(spark, sf):
    """In and out of sample; the anchor day ends one part and begins the other."""
    rows = D.panel_returns(spark, sf)
    nav = N.nav_constant(rows, N.equal_weights(N.rebalance_rows(rows), rows.select("asset").distinct()))
    cut = nav.filter("rn = 200").select(F.col("d").alias("anchor"))
    return X.phases(nav.join(F.broadcast(cut)), F.col("anchor")).select("phase", "d", *r6("nav"))


@query(f"with {_DRIFT} select g.rn, g.d, round(coalesce(base, 1) * g, 6) as nav from g left join base on g.e = base.e where g.rn > g.e or g.n = g.e")
def units_replay(spark, sf):
    """Cash and shares times prices: the same path as nav_drift's closed form."""
    rows, weights = _iv_weights(spark, sf)
    return N.units_replay(rows, weights).select("rn", "d", *r6("nav"))


@query(f"with {_TURN} select h.e, h.d, h.asset, round(coalesce(pre, 0), 6) as pre, round(h.w, 6) as target, round(h.w - coalesce(pre, 0), 6) as change from h left join pre on pre.e = h.e and pre.asset = h.asset where h.rn = h.e")
def turnover_ledger(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    return N.ledger(N.holdings(rows, weights)).select("e", "d", "asset", *r6("pre", "target", "change"))


@query(f"with {_TURN}, n as (select count(*) as n from g where rn > e or n = e) select 'IV' as strategy, round(sum((notional + abs(net)) / 2) * 252 / (select n from n), 6) as turnover_year from turn where e <> (select min(e) from turn)")
def turnover_summary(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    held = D.held(N.holdings(rows, weights))
    n = N.path(held).groupBy("strategy").agg(F.count("*").alias("n"))
    return N.turnover_per_year(N.traded(held), n).select("strategy", *r6("turnover_year"))


@query(f"with {PANEL}, k as (select distinct rn, d from panel), x as (select rn, d as decision, lead(d, 1) over (order by rn) as execution, lead(d, 2) over (order by rn) as first_return from k) select rn, decision, execution, first_return from x where rn >= 20 and (rn - 20) % 5 = 0")
def execution_dates(spark, sf):
    return N.execution_dates(D.panel(spark, sf))


_REG = f"""{_RATIO}, mm as (select d, avg(r) as m from ret where r is not null group by 1), nn as (select d, m, row_number() over (order by d) as k from mm),
ph as (select x.d, y.k as j, exp(sum(ln(1 + y.m)) over (partition by x.d order by y.k rows unbounded preceding)) as nav from nn x join nn y on y.k between x.k - 59 and x.k), dr as (select d, max_by(nav, j) / max(nav) - 1 as dd from ph group by 1),
reg as (select d, case when round(vol_ratio, 9) >= 1.8 or round(dd, 9) <= -0.2 then 'crisis' when round(vol_ratio, 9) >= 1.3 or round(dd, 9) <= -0.1 then 'stress' else 'normal' end as regime, vol_ratio from dr join ratio using (d))"""


#: The same after a loss of 0.8 % in each row, which brings stress and crisis about.
_LOSS = 0.008
_BAD = _REG.replace("select d, avg(r) as m from ret", f"select d, avg(r) - {_LOSS} as m from ret")


def _regimes(spark, sf, loss=0.0):
    """Regime and volatility ratio of each row."""
    rows = D.panel_returns(spark, sf)
    rows = rows.withColumn("r", F.col("r") - loss) if loss else rows
    return D.held(views.regimes(rows, stats.volatility_ratio(rows)).join(rows.select("d", "rn").distinct(), "d"))


_MIX = f"""{_REG}, vol as (select asset, rn, stddev_samp(r) {w(20)} as vol from ret), dec as (select distinct rn, d from panel where rn >= 25 and (rn - 25) % 5 = 0),
iv as (select v.rn, dec.d, v.asset, (1 / vol) / sum(1 / vol) over (partition by v.rn) as w, 1.0 / count(*) over (partition by v.rn) as e from vol v join dec using (rn) where vol > 0)"""


def _blend_sql(alpha: str, extra: str = "") -> str:
    return f"""mix as (select iv.rn, iv.asset{extra}, greatest({alpha} * w + (1 - {alpha}) * e, 0) as m from iv join reg on reg.d = iv.d), nrm as (select *, m / sum(m) over (partition by rn{extra}) as w from mix), kk as (select *, case when w >= 0.01 then w else 0 end as k from nrm)"""


@query(f"with {_MIX}, {_blend_sql('''case regime when 'normal' then 0.6 when 'stress' then 0.3 else 0.1 end''')} select rn, asset, round(k / sum(k) over (partition by rn), 6) as w from kk")
def hybrid_blend(spark, sf):
    """Inverse-volatility and equal weights by the regime of the decision's day."""
    _, weights = _iv_weights(spark, sf)
    other = weights.select("rn", "asset", (1.0 / F.count("*").over(Window.partitionBy("rn"))).alias("w"))
    return N.blended(weights, other, _regimes(spark, sf)).select("rn", "asset", *r6("w"))


@query(
    f"""with {_MIX}, grid as (select unnest([0.2, 0.4, 0.6, 0.8, 1.0])::double as c), iv2 as (select iv.*, c from iv cross join grid),
{_blend_sql('''case regime when 'normal' then c when 'stress' then 0.3 else 0.1 end''', ', c').replace('from iv join', 'from iv2 iv join')}, wt as (select rn, asset, c, k / sum(k) over (partition by rn, c) as w from kk),
day as (select c, r.rn as o, sum(wt.w * r.r) as r from ret r join wt on wt.asset = r.asset and wt.rn = 25 + 5 * ((r.rn - 26) // 5) where r.rn > 25 group by 1, 2), {_stats_sql('day', 'c')}
select 'alpha_' || c as strategy, n_returns, round(final_nav, 6) as final_nav, round(sharpe, 6) as sharpe from st"""
)
def alpha_grid(spark, sf):
    rows, weights = _iv_weights(spark, sf)
    other = weights.select("rn", "asset", (1.0 / F.count("*").over(Window.partitionBy("rn"))).alias("w"))
    blends = N.alpha_grid(weights, other, _regimes(spark, sf), [0.2, 0.4, 0.6, 0.8, 1.0])
    return X.return_stats(N.nav_constant(rows, blends), ["strategy"]).select("strategy", "n_returns", *r6("final_nav", "sharpe"))


_SCEN = f"""{RET}, vol as (select asset, rn, stddev_samp(r) {w(20)} as vol from ret), freq as (select unnest([5, 10, 20]) as f), dec as (select distinct f, rn from panel cross join freq where rn >= 25 and (rn - 25) % f = 0),
iv as (select f, v.rn, v.asset, (1 / vol) / sum(1 / vol) over (partition by f, v.rn) as w from vol v join dec on dec.rn = v.rn where vol > 0), day as (select f, r.rn as o, sum(iv.w * r.r) as r from ret r join iv on iv.asset = r.asset and iv.rn = 25 + f * ((r.rn - 26) // f) where r.rn > 25 group by 1, 2), {_stats_sql('day', 'f')}"""


@query(f"with {_SCEN} select 'every_' || f as scenario, 'IV' as strategy, round(final_nav, 6) as final_nav, round(sharpe, 6) as sharpe, round(final_nav - (select final_nav from st where f = 5), 6) as final_nav_delta, round(sharpe - (select sharpe from st where f = 5), 6) as sharpe_delta, row_number() over (order by sharpe desc, f) as place from st")
def scenario_compare(spark, sf):
    """Rebalancing each 5, 10 and 20 rows against the first, ranked by Sharpe ratio."""
    rows = D.panel_returns(spark, sf)
    vol = rows.select("asset", "rn", F.stddev_samp("r").over(I.trailing(20)).alias("vol"))
    out = None
    for every in (5, 10, 20):
        nav = N.nav_constant(rows, N.inverse_volatility_weights(N.rebalance_rows(rows, 25, every), vol))
        one = X.return_stats(nav, ["strategy"]).withColumn("scenario", F.lit(f"every_{every}"))
        out = one if out is None else out.unionByName(one)
    delta = X.head_to_head(out, "every_5", ["final_nav", "sharpe"])
    return X.by_sharpe(delta).select("scenario", "strategy", *r6("final_nav", "sharpe", "final_nav_delta", "sharpe_delta"), "place")


@query(f"with {RET} select d, round(median(r), 6) as r, count(*) as arms from ret where r is not null group by 1")
def cross_arm_median(spark, sf):
    return X.median_path(D.panel_returns(spark, sf).filter("r is not null").withColumnRenamed("asset", "arm")).select("d", *r6("r"), "arms")


@query(f"with {RET}, x as (select asset, rn as o, r from ret where r is not null), {_stats_sql('x', 'asset')}, long as (select asset, 'final_nav' as metric, final_nav as v from st union all select asset, 'sharpe', sharpe from st union all select asset, 'max_drawdown', max_drawdown from st)\n"
       "select a.asset as \"left\", b.asset as \"right\", a.metric, round(a.v - b.v, 6) as effect from long a join long b on a.asset < b.asset and b.metric = a.metric")  # fmt: skip
def effect_sizes(spark, sf):
    rows = X.return_stats(D.panel_returns(spark, sf).filter("r is not null").withColumnRenamed("asset", "experiment"), ["experiment"])
    return X.effect_sizes(rows, ["final_nav", "sharpe", "max_drawdown"]).select("left", "right", "metric", *r6("effect"))


# ---------------------------------------------------------------- selection

_CORR = f"{_VOLAT}, {_PREFIX}, sel as (select t, asset from pick where rank <= 5)"


@query(f"with {_CORR} select 'simple' as arm, x.t, round(avg(corr), 6) as mean_pair, round(median(corr), 6) as median_pair, count(*) as pairs from sel x join sel y on x.t = y.t and x.asset < y.asset join pc on pc.t = x.t and a = x.asset and b = y.asset group by 2")
def pair_correlations(spark, sf):
    chosen = _selected(spark, sf).select(F.lit("simple").alias("arm"), "t", "asset")
    return X.pair_correlation(chosen, _prefix(spark, sf)).select("arm", "t", *r6("mean_pair", "median_pair"), "pairs")


@query(
    f"""with {_CORR}, obj as (select t, sum(m) as objective from (select sel.t, pd.a, min(dist) as m from sel join pd on pd.t = sel.t and b = sel.asset group by 1, 2) group by 1),
s as (select t, list_sort(list(asset)) as m from sel group by 1), l as (select t, m, lag(m) over (order by t) as b from s), j as (select t, case when b is not null then len(list_intersect(m, b)) / len(list_distinct(list_concat(m, b)))::double end as jaccard, case when b is not null then len(list_filter(m, lambda x: not list_contains(b, x))) end as switched from l)
select 'simple' as experiment, case when t < 200 then 'IS' else 'OOS' end as phase, count(*) as events, round(avg(objective), 6) as coverage, round(avg(jaccard), 6) as mean_jaccard, sum(coalesce(switched, 0))::bigint as changes from j join obj using (t) group by 2"""
)
def selection_structure(spark, sf):
    chosen = D.held(_selected(spark, sf).select("t", "asset"))
    objective = selection.objective(_prefix_distances(spark, sf), chosen)
    rows = selection.changes(chosen).join(objective, "t").select(F.lit("simple").alias("experiment"), F.when(F.col("t") < 200, "IS").otherwise("OOS").alias("phase"), "objective", "jaccard", "switched")
    return X.selection_structure(rows).select("experiment", "phase", "events", *r6("coverage", "mean_jaccard"), "changes")


@query(f"with {PANEL}, t as (select distinct rn as t from panel where rn >= 30 and rn % 20 = 0) select 'full' as arm, t, asset from t cross join (select distinct asset from panel)")
def full_arm(spark, sf):
    panel = D.panel(spark, sf)
    return X.full_arm(panel.filter("rn >= 30 and rn % 20 = 0").select(F.col("rn").alias("t")).distinct(), panel.select("asset"))


@query()
def random_arms(spark, sf):
    panel = D.panel(spark, sf)
    last = panel.agg(F.max("rn")).first()[0] or 0
    return X.random_arms(spark, list(range(40, last + 1, 20)), _assets(panel), 5, list(range(10)))


@query(f"with recursive {PANEL}, dec as (select max(rn) as rn from panel where rn >= 25 group by date_trunc('month', d)), s as (select min(rn) as rn from dec union all select (select min(rn) from dec where dec.rn >= s.rn + 20) from s where s.rn is not null) select 'IV' as strategy, rn from s where rn is not null")
def reselect_schedule(spark, sf):
    """What is due each 20 rows, looked at on the last row of each month, so not evenly spaced."""
    rows = D.panel(spark, sf).filter("rn >= 25").groupBy(F.date_trunc("month", "d")).agg(F.max("rn").alias("rn")).select(F.lit("IV").alias("strategy"), "rn")
    return X.due(rows, 20)


_FORCE = f"""{_MEDOIDS}, sel as (select t, list_sort(list(asset)) as m from medoid group by 1), turn as (select distinct rn from panel where rn >= 25 and (rn - 25) % 5 = 0), fc as (select rn, max(t) as t from turn left join sel on t <= rn group by 1)"""


def _in_force(spark, sf):
    chosen = _representatives(spark, sf).groupBy("t").agg(F.array_sort(F.collect_set("asset")).alias("members"))
    return X.in_force(N.rebalance_rows(D.panel(spark, sf), 25).select("rn"), chosen)


@query(f"with {_FORCE} select rn, fc.t as selected_at, array_to_string(m, ',') as members from fc left join sel on sel.t = fc.t")
def selection_in_force(spark, sf):
    return _in_force(spark, sf).select("rn", "selected_at", F.array_join("members", ",").alias("members"))


@query(
    f"""with {_FORCE}, lists as (select rn, case when m is null then (select list_sort(list(distinct asset)) from panel) else list_concat(m, ['GOLD', 'Brand#11', 'Brand#12']) end as l from fc left join sel on sel.t = fc.t), u as (select rn, unnest(l) as asset, generate_subscripts(l, 1) as i from lists),
f as (select rn, asset, min(i) as i from u where asset in (select asset from panel) group by 1, 2) select rn, (row_number() over (partition by rn order by i) - 1)::int as place, asset from f"""
)
def active_assets(spark, sf):
    panel = D.panel(spark, sf)
    return X.active_assets(_in_force(spark, sf), _assets(panel), ["GOLD", "Brand#11", "Brand#12"])


# ---------------------------------------------------------------- views

_COMB = f"""{_MOM}, p as (select x.t, x.asset as a, y.asset as b, x.mom - y.mom as diff from mt x join mt y on x.t = y.t and x.asset < y.asset), rel as (select t, case when diff > 0 then a else b end || '_over_' || case when diff > 0 then b else a end as name, case when diff > 0 then a else b end as l, case when diff > 0 then b else a end as s, least(0.3, abs(diff) * 252 / 20) as q, least(0.8, 0.4 + 10 * abs(diff)) as c from p where abs(diff) >= 0.01)"""
STATIC = [("Brand#1_over_Brand#2", {"Brand#1": 1.0, "Brand#2": -1.0}, 0.05, 0.6), ("up_Brand#3", {"Brand#3": 1.0}, 0.08, 0.5)]
WEIGHTS = {"rule": 0.3, "relative": 0.3, "ml": 0.4, "static": 0.1}


def _absolute(spark, sf):
    """Views of a momentum model."""
    rows = _momenta(spark, sf).select("t", "asset", F.round(F.col("mom_20") / 4, 9).alias("pred"), F.lit(0.5).alias("conf"), F.lit(None).cast("double").alias("vol_20"), F.lit(0).alias("n_obs"))
    return views.model_views(rows)


@query(
    f"""with {_COMB}, ml as (select t, 'ml_' || asset as name, least(greatest(round(mom / 4, 9) * 252 / 5, -0.5), 0.5) as q, 0.5 as c from mt where abs(round(mom / 4, 9)) >= 0.001), st as (select distinct t from mt)
select t, name, 'relative' as source, round(q, 10) as q_annual, round(c * 0.3, 10) as confidence from rel union all select t, name, 'ml', round(q, 10), round(c * 0.4, 10) from ml union all select t, 'Brand#1_over_Brand#2', 'static', 0.05, 0.06 from st union all select t, 'up_Brand#3', 'static', 0.08, 0.05 from st"""
)
def combined_views(spark, sf):
    momenta = _momenta(spark, sf)
    sources = {"relative": views.relative_views(momenta), "ml": _absolute(spark, sf), "static": views.static_views(momenta, STATIC)}
    return views.dispatched("combined", sources, WEIGHTS).select("t", "name", "source", *[F.round(c, 10).alias(c) for c in ("q_annual", "confidence")])


@query(f"with {_COMB} select (select count(distinct t) from mt) as rebalances, (select count(*) from rel)::bigint as views")
def view_counts(spark, sf):
    momenta = _momenta(spark, sf)
    return views.view_counts(views.relative_views(momenta), momenta)


@query(
    f"""with {PANEL}, c as (select rn as t, asset, px as last, lag(px, 19) over (partition by asset order by d) as first from panel), m as (select t, asset, round(last / first - 1, 9) as mom from c where first is not null and t >= 25 and t % 5 = 0), r as (select *, row_number() over (partition by t order by mom desc, asset) - 1 as i, count(*) over (partition by t) as k from m)
select a.t, a.asset || '_over_' || b.asset as name, round(0.2 / 252 * (b.i - a.i) / a.k, 9) as q_daily, round(least(least(greatest(0.5 + 2 * (a.mom - b.mom) - 0.5, 0.25), 0.75), 0.45), 10) as confidence from r a join r b on a.t = b.t and a.i < greatest(a.k // 2, 1) and b.i >= a.k // 2 + a.i and b.i > a.i"""
)
def cold_start_views(spark, sf):
    rows = D.panel(spark, sf).select(F.col("rn").alias("t"), "asset", F.col("px").alias("last"), F.lag("px", 19).over(I.by_asset()).alias("first")).filter("first is not null and t >= 25 and t % 5 = 0")
    return views.cold_start_views(rows, digits=9).select("t", "name", F.round("q_daily", 9).alias("q_daily"), F.round("confidence", 10).alias("confidence"))


def _defensive(spark, sf, loss=0.0):
    return views.defensive_views(_regimes(spark, sf, loss).drop("rn"), _assets(D.panel(spark, sf)), "Brand#3")


@query(f"with {_BAD} select d, 'defensive_' || regime as name, round(case regime when 'crisis' then 0.1 else 0.05 end / 252, 9) as q_daily, case regime when 'crisis' then 0.8 else 0.68 end as confidence, (select count(distinct asset) from panel)::int as legs, 0.0::double as total from reg where regime <> 'normal'")
def defensive_views(spark, sf):
    legs = F.aggregate(F.map_values("legs"), F.lit(0.0), lambda s, x: s + x)
    return _defensive(spark, sf, _LOSS).select("d", "name", F.round("q_daily", 9).alias("q_daily"), *r6("confidence"), F.size("legs").alias("legs"), F.abs(F.round(legs, 6)).alias("total"))


@query(
    f"""with {_COMB}, {_BAD.removeprefix(PANEL + ', ')}, k as (select distinct rn as t, d from panel), mv as (select rel.t, name, q / 252 as q, case when vol_ratio > 1.3 then c * 1.3 / vol_ratio else c end as c from rel join k using (t) join reg using (d)),
df as (select t, 'defensive_' || regime as name, case regime when 'crisis' then 0.1 else 0.05 end / 252 as q, case regime when 'crisis' then 0.8 else 0.68 end as c from reg join k using (d) where regime <> 'normal' and t >= 25 and t % 5 = 0)
select t, name, round(q, 11) as q_daily, round(c, 8) as confidence from mv union all select t, name, round(q, 11), round(c, 8) from df"""
)
def views_with_defensive(spark, sf):
    own, model = _managed(spark, sf, _LOSS)
    return views.with_defensive(model, own, _regimes(spark, sf, _LOSS).withColumnRenamed("rn", "t")).select("t", "name", F.round("q_daily", 11).alias("q_daily"), F.round("confidence", 8).alias("confidence"))


def _managed(spark, sf, loss=0.0):
    """Defensive and relative views, daily, at each rebalance."""
    day = _regimes(spark, sf, loss).select("d", F.col("rn").alias("t"))
    own = _defensive(spark, sf, loss).join(day, "d").filter("t >= 25 and t % 5 = 0")
    return own, views.relative_views(_momenta(spark, sf)).withColumn("q_daily", F.col("q_annual") / 252)


@query(f"with {_COMB}, legs as (select t, l as asset, 1 as x, q, c * 0.3 as c from rel union all select t, s, -1, q, c * 0.3 from rel), g as (select t, asset, count(*) as n, sum(x)::double as net, sum(x * q / 252) as weighted, sum(c) as c from legs group by 1, 2) select t, asset, n, net, round(weighted, 6) as weighted, round(c, 5) as confidence from g")
def view_matrix_columns(spark, sf):
    """P, Q and confidences of all relative views at each rebalance, summed by asset."""
    panel = D.panel(spark, sf)
    packed = views.matrices(views.combined(views.relative_views(_momenta(spark, sf))), _assets(panel))
    row = packed.select("t", "assets", F.explode(F.arrays_zip("p", "q", "conf")).alias("v"))
    cell = row.select("t", F.col("v.q").alias("q"), F.col("v.conf").alias("c"), F.explode(F.arrays_zip("assets", F.col("v.p").alias("p"))).alias("x")).select("t", "q", "c", F.col("x.assets").alias("asset"), F.col("x.p").alias("p")).filter("p <> 0")
    out = cell.groupBy("t", "asset").agg(F.count("*").alias("n"), F.sum("p").alias("net"), F.sum(F.col("p") * F.col("q")).alias("weighted"), F.sum("c").alias("confidence"))
    return out.select("t", "asset", "n", "net", F.round("weighted", 6).alias("weighted"), F.round("confidence", 5).alias("confidence"))


# ---------------------------------------------------------------- optimisation


_COV = f"""{RET}, dect as (select distinct rn as t from panel where rn >= 20 and (rn - 20) % 5 = 0), wr as (select dect.t, r.asset, r.rn, r.r from dect join ret r on r.rn between dect.t - 18 and dect.t + 1 and r.r is not null), cv as (select x.t, x.asset as a, y.asset as b, covar_samp(x.r, y.r) as cov, count(*) as n from wr x join wr y on x.t = y.t and x.rn = y.rn group by 1, 2, 3)"""


@query(
    f"""with {_COV}, c as (select * from cv where n = 20), pi as (select t, a, 2.5 * avg(cov) as pi from c group by 1, 2), sp as (select x.t, x.a, 0.05 * (x.cov - y.cov) as s from c x join c y on x.t = y.t and x.a = y.a where x.b = 'Brand#1' and y.b = 'Brand#2'),
iv as (select x.t, x.s - y.s as inner_, p.pi - r.pi as ppi from sp x join sp y on x.t = y.t join pi p on p.t = x.t and p.a = 'Brand#1' join pi r on r.t = x.t and r.a = 'Brand#2' where x.a = 'Brand#1' and y.a = 'Brand#2')
select pi.t as rn, pi.a as asset, round(pi.pi, 8) as prior, round(pi.pi + sp.s * (0.0008 - ppi) / (inner_ + greatest(inner_, 1e-10) / 0.5), 8) as posterior, round(0.05 * v.cov, 12) as prior_var, round(0.05 * v.cov - sp.s * sp.s / (inner_ + greatest(inner_, 1e-10) / 0.5), 12) as posterior_var from pi join c v on v.t = pi.t and v.a = pi.a and v.b = pi.a join sp on sp.t = pi.t and sp.a = pi.a join iv on iv.t = pi.t"""
)
def one_view_posterior(spark, sf):
    """Equilibrium prior of equal weights, updated by one relative view with a confidence of one half."""
    moments = _moments(spark, sf)
    one = views.static_views(moments.select(F.col("rn").alias("t")), [("a_over_b", {"Brand#1": 1.0, "Brand#2": -1.0}, 0.0008 * 252, 0.5)])
    out = optimize.posteriors(moments, views.matrices(one, _assets(D.panel(spark, sf))))
    return out.select("rn", "asset", F.round("prior", 8).alias("prior"), F.round("posterior", 8).alias("posterior"), F.round("prior_var", 12).alias("prior_var"), F.round("posterior_var", 12).alias("posterior_var"))


@query(f"with {_COV}, n as (select t, a, count(*) as k, min(n) as n from cv group by 1, 2), ok as (select t, a, k from n where n = 20) select t as rn, a as asset, case when t % 3 = 0 and (t // 5) % 2 = 0 then 'NOT_FINITE' else 'OK' end as outcome, case when t % 3 = 0 and (t // 5) % 2 = 0 then null else round(1.0 / k, 6) end as w from ok")
def served_equal_weights(spark, sf):
    """Requests for equal weights, some of them with a mean that is not finite; each fails alone."""
    broken = (F.col("rn") % 3 == 0) & (F.expr("rn div 5") % 2 == 0)
    rows = _moments(spark, sf).withColumn("mean", F.when(broken, F.lit(float("inf"))).otherwise(F.col("mean")))
    out = optimize.served(rows, optimize.Policy(cap=0.5), "EW")
    each = out.select("rn", "error", "weights", F.posexplode("assets").alias("i", "asset"))
    return each.select("rn", "asset", F.coalesce("error", F.lit("OK")).alias("outcome"), F.round(F.get("weights", F.col("i")), 6).alias("w"))


@query()
def served_allocations(spark, sf):
    """Mean-variance requests with limits, checked for feasibility and optimality."""
    return optimize.served(_moments(spark, sf), POLICY)


@query(f"with {_IV} select 'IV' as strategy, rn, case when max(w) > 0.0501 + 1e-7 then 'INVALID_WEIGHT' when sum(case when asset in ('Brand#11', 'Brand#12') then w else 0 end) + 1e-7 < 0.08 then 'GROUP_LIMIT' else 'OK' end as code from iv group by 2")
def result_checks(spark, sf):
    return serving.result_violations(_iv_weights(spark, sf)[1], ["Brand#11", "Brand#12"], 0.0501, 0.08, 0.92)


@query(f"with {_IV}, x as (select rn, greatest(abs(sum(w) - 1), greatest(-min(w), 0), greatest(max(w) - 0.05, 0)) as m from iv group by 1) select rn, round(m, 6) as most from x")
def max_residuals(spark, sf):
    out = N.residuals(_iv_weights(spark, sf)[1], [], cap=0.05, floor=0.0, group_cap=1.0)
    return out.select("rn", F.round(F.greatest("budget", "negative", "cap"), 6).alias("most"))


@query(f"with {_IV} select 'IV' as strategy, rn, asset, round(w, 6) as w from iv where w >= 1e-6")
def weights_log(spark, sf):
    """Weights as JSON, largest first, and read back."""
    logged = files.weights_log(_iv_weights(spark, sf)[1])
    return logged.select("strategy", "rn", F.explode(F.from_json("weights", "map<string,double>")).alias("asset", "w"))


@query(f"with {RET}, k as (select *, row_number() over (partition by asset order by rn desc) as k from ret where r is not null), l as (select * from k where k <= 252), m as (select asset as a, avg(r) as mean from l group by 1) select x.asset as a, y.asset as b, round(mean, 8) as mean, round(covar_samp(x.r, y.r), 8) as cov, count(*) as n from l x join l y on x.rn = y.rn join m on m.a = x.asset group by 1, 2, mean")
def serving_moments(spark, sf):
    return serving.moments(D.panel_returns(spark, sf)).select("a", "b", F.round("mean", 8).alias("mean"), F.round("cov", 8).alias("cov"), "n")


_KNOWN = f"{RET.replace('round(px / lag(px) over (partition by asset order by d) - 1, 10)', 'px / lag(px) over (partition by asset order by d) - 1')}, kn as (select *, cast(d as timestamp) + interval 18 hour + interval 1 day * (case when rn % 11 = 0 then 40 else 0 end) as known_at from ret), fk as (select *, max(known_at) over (partition by asset order by rn rows unbounded preceding) as fka from kn)"
_TRAIN = f"""{_KNOWN}, tr as (select asset, rn, d, r as return_1, px / lag(px, 5) over wa - 1 as momentum_5, px / lag(px, 20) over wa - 1 as momentum_20, case when count(r) {w(20)} = 20 then stddev_samp(r) {w(20)} end as volatility_20, fka as feature_known_at, lead(px) over wa / px - 1 as target, lead(d) over wa as label_d, lead(fka) over wa as label_known_at from fk window wa as (partition by asset order by rn)), tm as (select * from tr where rn >= 21 and label_d <= date '2001-01-01')"""


def _training(spark, sf):
    known = F.col("d").cast("timestamp") + F.expr("interval 18 hours") + F.when(F.col("rn") % 11 == 0, F.expr("interval 40 days")).otherwise(F.expr("interval 0 days"))
    return serving.training_rows(D.panel(spark, sf).withColumn("known_at", known), F.lit("2001-01-01").cast("date"))


@query(f"with {_TRAIN} select asset, rn, d, {', '.join(f'round({c}, 6) as {c}' for c in ('return_1', 'momentum_5', 'momentum_20', 'volatility_20', 'target'))}, feature_known_at, label_d, label_known_at from tm")
def training_matrix(spark, sf):
    return _training(spark, sf).select("asset", "rn", "d", *r6("return_1", "momentum_5", "momentum_20", "volatility_20", "target"), "feature_known_at", "label_d", "label_known_at")


@query(f"with {_TRAIN} select count(*) as n_rows, 0::bigint as label_before_feature, count(*) filter (where label_d > date '2000-06-01') as label_after_cutoff, count(*) filter (where label_known_at < feature_known_at) as label_known_first, count(*) filter (where label_known_at > timestamp '2000-07-01 00:00:00') as known_after_cutoff, 0::bigint as feature_known_before_its_day, 0::bigint as label_known_before_its_day, count(*) filter (where volatility_20 is null) as missing_feature from tm")
def temporal_contract(spark, sf):
    return serving.contract_violations(_training(spark, sf), F.lit("2000-06-01").cast("date"), F.lit("2000-07-01").cast("timestamp"))


# ---------------------------------------------------------------- learning

_ERR = f"{PANEL}, f as (select asset, rn, px / lag(px, 5) over (partition by asset order by d) - 1 as p, lead(px, 5) over (partition by asset order by d) / px - 1 as y from panel), e as (select * from f where p is not null and y is not null)"


@query(f"with {_ERR} select asset, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg(pow(y - p, 2))), 6) as rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) as r2 from e group by 1")
def validation_errors(spark, sf):
    rows = D.panel(spark, sf).select("asset", I.momentum(5).alias("pred"), I.forward_return(5).alias("y")).filter("pred is not null and y is not null")
    return ml.errors(rows).select("asset", *r6("mae", "rmse", "r2"))


@query(f"with {PANEL}, f as (select asset, rn, px / lag(px, 5) over (partition by asset order by d) - 1 as a, px / lag(px, 20) over (partition by asset order by d) - 1 as b from panel) select asset, rn, round(least(greatest(0.6 - 5 * (pow(a - (a + b) / 2, 2) + pow(b - (a + b) / 2, 2)) / 2, 0.3), 0.9), 6) as confidence, round(least(greatest(0.70 - abs(a - b) / 2 / 0.005, 0.25), 0.70), 6) as of_members from f where a is not null and b is not null")
def confidences(spark, sf):
    """From the variance of a row's features, and from the spread of two members."""
    rows = D.panel(spark, sf).select("asset", "rn", I.momentum(5).alias("a"), I.momentum(20).alias("b")).filter("a is not null and b is not null").withColumn("std", F.abs(F.col("a") - F.col("b")) / 2)
    return rows.select("asset", "rn", F.round(ml.feature_confidence(["a", "b"]), 6).alias("confidence"), F.round(ml.ensemble_confidence(), 6).alias("of_members"))


@query(f"with {_ERR}, c as (select asset, rn, (p > 0) = (y > 0) as correct from e), h as (select *, avg(correct::int) over (partition by asset order by rn rows between 20 preceding and 1 preceding) as a, count(correct) over (partition by asset order by rn rows between 20 preceding and 1 preceding) as n from c) select asset, rn, correct, case when n >= 10 then round(a, 6) end as accuracy, case when n >= 10 and a < 0.4 then round(a / 0.4, 6) else 1.0 end as factor from h")
def accuracy_penalties(spark, sf):
    rows = D.panel(spark, sf).select("asset", "rn", I.momentum(5).alias("p"), I.forward_return(5).alias("y")).filter("p is not null and y is not null")
    return ml.accuracy_penalty(rows.select("asset", "rn", ((F.col("p") > 0) == (F.col("y") > 0)).alias("correct"))).select("asset", "rn", "correct", *r6("accuracy", "factor"))


@query(
    f"""with {_ERR.replace('select asset, rn, px', 'select asset, rn, d, lead(d, 5) over (partition by asset order by d) as ld, px')}, k as (select *, row_number() over (partition by asset order by rn) as i, floor(count(*) over (partition by asset) * 0.8::double) as n from e), v as (select asset, min(rn) as v, min(d) as vd from k where i > n group by 1)
select asset, count(*) filter (where i <= n and rn + 5 < v) as n_train, min(d) filter (where i <= n and rn + 5 < v) as train_from, max(d) filter (where i <= n and rn + 5 < v) as train_to, max(ld) filter (where i <= n and rn + 5 < v) as last_label, min(vd) as validation_from from k join v using (asset) group by 1"""
)
def training_audit(spark, sf):
    """Rows and cut-offs of each asset's fit."""
    panel = D.panel(spark, sf).select("asset", "d", "rn", "px", I.momentum(5).alias("p"), F.lead("d", 5).over(I.by_asset()).alias("label_d"))
    return learning.audit(ml.temporal_split(ml.labelled(panel.filter("p is not null"))))


@query()
def single_forecasts(spark, sf):
    """One regressor for each asset: 200 trees of depth 4."""
    rows = ml.labelled(I.ml_features(D.panel(spark, sf)))
    return learning.single_forecasts(rows, ml.ML_FEATURES)


@query()
def serving_model_errors(spark, sf):
    """A pooled gradient-boosted model of the served features, and its errors on the last fifth of the days."""
    rows = _training(spark, sf).dropna(subset=[*serving.FEATURES, "target"])
    _, scored = learning.pooled_model(rows, serving.FEATURES)
    return learning.pooled_errors(scored)


@query()
def serving_predictions(spark, sf):
    """Served views: identity legs, predictions as Q, fixed confidence."""
    rows = _training(spark, sf).dropna(subset=[*serving.FEATURES, "target"])
    model, _ = learning.pooled_model(rows, serving.FEATURES)
    newest = serving.serving_features(D.panel(spark, sf)).withColumn("_l", F.max("rn").over(Window.partitionBy("asset"))).filter("rn = _l").drop("_l")
    return learning.served_views(model, newest, serving.FEATURES)


# ---------------------------------------------------------------- walk-forward


def _view_matrices(spark, sf):
    """Relative views at the combination's weights, dampened, with the defensive ones behind them."""
    model = views.combined(views.relative_views(_momenta(spark, sf))).withColumn("q_daily", F.col("q_annual") / 252)
    return _with_defensive(spark, sf, model)


def _with_defensive(spark, sf, model, regimes=None):
    own, _ = _managed(spark, sf)
    regimes = _regimes(spark, sf) if regimes is None else regimes
    all_ = views.with_defensive(model, own, regimes.withColumnRenamed("rn", "t"))
    return views.matrices(all_, _assets(D.panel(spark, sf)), daily=True)


@query()
def black_litterman_weights(spark, sf):
    """Weights from the equilibrium prior and the views of each rebalance."""
    return optimize.solved(_moments(spark, sf), POLICY, "BL_ML", views=_view_matrices(spark, sf))


@query()
def next_period_weights(spark, sf):
    """Both strategies at the last decision alone."""
    moments = D.held(_moments(spark, sf))
    last = moments.agg(F.max("rn").alias("rn"))
    now = moments.join(last, "rn", "left_semi")
    return optimize.solved(now, POLICY).unionByName(optimize.solved(now, POLICY, "BL_ML", views=_view_matrices(spark, sf)))


def _active_weights(spark, sf, moments, matrices, force=None, regimes=None):
    """Optimised with and without views over the active assets of each decision, more averse in a crisis, 0 for all
    others."""
    force, regimes = _force(spark, sf) if force is None else force, _regimes(spark, sf) if regimes is None else regimes
    active = D.settled(X.active_assets(force, _assets(D.panel(spark, sf)), ["Brand#11", "Brand#12"]).select("rn", "asset"))
    some = moments.join(active.withColumnRenamed("asset", "a"), ["rn", "a"], "left_semi").join(active.withColumnRenamed("asset", "b"), ["rn", "b"], "left_semi")
    tight = regimes.filter("regime = 'crisis'").select("rn")
    every = moments.select("rn", F.col("a").alias("asset")).distinct()

    def whole(solved, name):
        return every.join(solved.drop("strategy"), ["rn", "asset"], "left").select(F.lit(name).alias("strategy"), "rn", "asset", F.coalesce("w", F.lit(0.0)).alias("w"))

    return whole(optimize.solved(some, POLICY, "BL_ML", views=matrices, tight=tight), "BL_ML"), whole(optimize.solved(some, POLICY, tight=tight), "MVO_ACTIVE")


@query()
def active_subset_weights(spark, sf):
    with_views, without = _active_weights(spark, sf, D.settled(_moments(spark, sf)), _view_matrices(spark, sf))
    return with_views.unionByName(without)


# ---------------------------------------------------------------- walk-forward with retraining

RANKING_FEATURES = [
    *[f"momentum_{n}" for n in (5, 20, 60)], "vol_20", "vol_60", "rsi", "macd_hist", "pct_b", *[f"market_ret_{n}" for n in (5, 20, 60)], "market_vol_20",
    *[f"rank_momentum_{n}" for n in (5, 20, 60)], "rank_vol", "rank_overall",
]


def _force(spark, sf):
    return D.settled(_in_force(spark, sf).select("rn", "members"))


def _with_labels(rows):
    """Forward return over five rows and the row where it ends; unknown ones stay null."""
    return rows.withColumn("y", I.forward_return(5)).withColumn("label_rn", F.lead("rn", 5).over(I.by_asset())).withColumn("label_d", F.lead("d", 5).over(I.by_asset()))


def _ranking_rows(spark, sf):
    panel = D.panel(spark, sf)
    return _with_labels(I.ranking_features(panel, D.market(spark, sf)).join(panel.select("asset", "d", "px"), ["asset", "d"]))


def _absolute_rows(spark, sf):
    return _with_labels(I.ml_features(D.panel(spark, sf)))


_TURNS = """ready as (select distinct rn from panel where rn >= 25 and (rn - 25) % 5 = 0 and rn - 6 > 135 and rn >= (select min(t) from sel)), turn as (select min(rn) as u from ready union all select (select min(rn) from ready where rn >= turn.u + 10) from turn where turn.u is not null),
fitted as (select u, unnest(m) as asset from (select u, max(t) as t from turn join sel on t <= u where u is not null group by 1) x join sel on sel.t = x.t),
lab as (select * from (select asset, rn, lead(rn, 5) over (partition by asset order by rn) as label_rn from panel) where rn >= 30 and label_rn is not null),
tr as (select fitted.u, lab.*, row_number() over (partition by u, asset order by rn) as i, floor(count(*) over (partition by u, asset) * 0.8::double) as n from fitted join lab using (asset) where label_rn <= u - 6), val as (select u, asset, min(rn) as v from tr where i > n group by 1, 2)"""


@query(
    f"""with recursive {_FORCE.replace(', fc as (select rn, max(t) as t from turn left join sel on t <= rn group by 1)', '').replace(', turn as (select distinct rn from panel where rn >= 25 and (rn - 25) % 5 = 0)', '')}, {_TURNS}
select u, asset, count(*) filter (where i <= n and label_rn < v) as n_train, count(*) filter (where i <= n and label_rn >= v) as n_purged, count(*) filter (where i > n) as n_validation, max(label_rn) as last_label, max(label_rn) filter (where i <= n and label_rn < v) as last_fitted, min(v) as validation_from from tr join val using (u, asset) group by 1, 2"""
)
def fit_audits(spark, sf):
    """Every fit of the walk-forward: rows that train, are purged and validate, and the last labels they use."""
    return walkforward.audits(_absolute_rows(spark, sf), walkforward.fit_turns(_force(spark, sf), "absolute"))


def _learned_ranking_views(spark, sf, force):
    rows = D.settled(_ranking_rows(spark, sf))
    turns = D.settled(walkforward.fit_turns(force))
    scores = D.settled(walkforward.ranking_scores(rows, force, turns, RANKING_FEATURES))
    return views.ranking_views(scores).unionByName(views.cold_start_views(walkforward.cold_starts(D.panel(spark, sf), force, turns))), scores


@query()
def learned_ranking_views(spark, sf):
    """Views from the pairwise ranker, fitted anew each 10 rows; momenta before its first fit."""
    return _learned_ranking_views(spark, sf, _force(spark, sf))[0]


def _learned_model_views(spark, sf, force):
    rows = D.settled(_absolute_rows(spark, sf))
    turns = D.settled(walkforward.fit_turns(force, "absolute"))
    scores = D.settled(walkforward.absolute_forecasts(rows, force, turns, ml.ML_FEATURES))
    spread = D.panel_returns(spark, sf).select((F.col("rn") + 1).alias("t"), "asset", I.volatility(20, full=False).alias("vol_20"), F.count("r").over(I.trailing(20)).alias("n_obs"))
    out = scores.withColumn("conf", ml.ensemble_confidence()).join(spread, ["t", "asset"])
    return views.model_views(out).withColumn("q_daily", F.col("q_annual") / 252), scores


@query()
def learned_model_views(spark, sf):
    """Views from each member's ensemble, fitted anew each 10 rows; none before its first fit."""
    return _learned_model_views(spark, sf, _force(spark, sf))[0]


def _walked(spark, sf, learned):
    """Holdings of equal weights, mean-variance over all assets, learned views over the selection in force (each 20 rows), and
    their blend by regime with the mean-variance weights of the same selection: decided at each rebalance, traded at the
    next close, drifting between; with the prices, the weights, and the models' predictions."""
    rows, force = D.settled(D.panel_returns(spark, sf)), _force(spark, sf)
    moments, regimes = D.settled(_moments(spark, sf).filter("rn >= 25")), D.settled(_regimes(spark, sf))
    model, scores = learned(spark, sf, force)
    matrices = D.settled(_with_defensive(spark, sf, D.settled(model), regimes))
    bl, active = (D.settled(x) for x in _active_weights(spark, sf, moments, matrices, force, regimes))
    ew = N.equal_weights(moments.select("rn").distinct(), rows.select("asset").distinct())
    weights = D.settled(ew.unionByName(optimize.solved(moments, POLICY)).unionByName(bl).unionByName(N.blended(active, bl, regimes)))
    return rows, weights, N.holdings(rows, weights), scores


@query()
def walk_forward(spark, sf):
    """The walk-forward with views of the retrained ranker."""
    return N.path(_walked(spark, sf, _learned_ranking_views)[2])


@query()
def walk_forward_absolute(spark, sf):
    """The walk-forward with views of the retrained ensembles."""
    return N.path(_walked(spark, sf, _learned_model_views)[2])


def _run_tables(spark, sf):
    """The thirteen tables of the walk-forward with the retrained ensembles; its first phase ends on a
    Monday in the middle of 1998."""
    rows, weights, held, scores = _walked(spark, sf, _learned_model_views)
    force = D.settled(_in_force(spark, sf))
    training = D.settled(walkforward.audits(_absolute_rows(spark, sf), walkforward.fit_turns(force.select("rn", "members"), "absolute")))
    limits = {"defensive": list(POLICY.defensive), "bounded": ["BL_ML"], "cap": POLICY.cap, "floor": POLICY.floor, "group_cap": POLICY.other_cap}
    return runs.tables(rows, weights, D.settled(held), F.lit("1998-06-29").cast("date"), force, training, scores, limits)


@query()
def run_artifacts(spark, sf):
    """A run's tables are written as files; how many rows each of them has when it is read again."""
    root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    run = _run_tables(spark, sf)
    market.write_run(run, root)
    files = [spark.read.option("header", True).csv(f"{root}/{name}", schema=df.schema).agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in run.items()]
    return reduce(DataFrame.unionByName, files)


# ---------------------------------------------------------------- comparisons of paths


_NAVS = f"""{_IV}, iday as (select r.rn, r.d, sum(iv.w * r.r) as r from ret r join iv on iv.asset = r.asset and iv.rn = 25 + 5 * ((r.rn - 26) // 5) where r.rn > 25 group by 1, 2), inav as (select rn, d, exp(sum(ln(1 + r)) over (order by rn rows unbounded preceding)) as nav from iday),
eday as (select rn, d, avg(r) as r from ret where rn > 20 group by 1, 2), enav as (select rn, d, exp(sum(ln(1 + r)) over (order by rn rows unbounded preceding)) as nav from eday)"""


@query(
    f"""with {_NAVS}, c as (select i.d, i.nav / first_value(i.nav) over (order by i.d) as a, e.nav / first_value(e.nav) over (order by i.d) as b from inav i join enav e on e.d = i.d), s as (select *, a / lag(a) over (order by d) - 1 as ra, b / lag(b) over (order by d) - 1 as rb from c)
select count(*) as n_common, round(max(abs(a - b)), 6) as max_gap, round(max_by(a - b, d), 6) as final_gap, round(covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0), 6) as corr from s"""
)
def nav_compare(spark, sf):
    """Two value paths on their common days, both started again at 1 there."""
    rows, weights = _iv_weights(spark, sf)
    ew = N.equal_weights(N.rebalance_rows(rows), rows.select("asset").distinct())
    return X.path_gap(N.nav_constant(rows, weights), N.nav_constant(rows, ew)).select("n_common", *r6("max_gap", "final_gap", "corr"))


@query(
    f"""with {_TURN}, nav as (select g.rn, g.d, coalesce(base, 1) * g as nav from g left join base on g.e = base.e where g.rn > g.e or g.n = g.e), day as (select rn, d, nav / lag(nav, 1, 1) over (order by rn) - 1 as g from nav)
select b.bps::double as bps, case when day.d <= date '1998-06-30' then 'IS' else 'OOS' end as phase, count(*) as n, round(sum(ln((1 + day.g) * (1 - b.bps / 1e4 * coalesce(t.notional, 0)))), 6) as log_growth from day left join turn t on t.d = day.d cross join (select unnest([0, 10, 25, 50]) as bps) b group by 1, 2"""
)
def cost_grid_phases(spark, sf):
    """Growth after costs at each rate, in and out of sample."""
    rows, weights = _iv_weights(spark, sf)
    held = D.held(N.holdings(rows, weights))
    daily = N.path(held).select("strategy", "d", (F.col("nav") / F.lag("nav", 1, 1.0).over(Window.partitionBy("strategy").orderBy("rn")) - 1).alias("g"))
    out = N.costs(daily, N.traded(held), 0, 10, 25, 50).withColumn("phase", F.when(F.col("d") <= F.lit("1998-06-30").cast("date"), "IS").otherwise("OOS"))
    return out.groupBy("bps", "phase").agg(F.count("*").alias("n"), F.round(F.sum(F.log1p("net")), 6).alias("log_growth"))


@query(f"with {RET}, f as (select asset, rn, r, lead(px, 5) over (partition by asset order by d) / px - 1 as y from ret where r is not null) select asset, rn, case when y is null then 'PENDING' when sign(r) = sign(y) then 'HIT' else 'MISS' end as status, round(y, 6) as outcome from f")
def forecast_grades(spark, sf):
    """Each forecast of a direction (the row's return) with its outcome five rows later."""
    rows = D.panel_returns(spark, sf).withColumn("y", I.forward_return(5)).filter("r is not null")
    return stats.graded(rows, "r", "y").select("asset", "rn", "status", F.round("y", 6).alias("outcome"))
