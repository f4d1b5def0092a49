"""DuckDB equivalents of the derived tables, as common table expressions."""

from __future__ import annotations

RAW = """raw as (select p_brand as asset, cast(date_trunc('week', l_shipdate) as date) as d, 100 * pow(sum(l_extendedprice) / sum(l_quantity), 0.1::double) as px
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
PANEL = f"""{RAW}, cal as (select distinct d from raw), names as (select distinct asset from raw),
filled as (select n.asset, c.d, last_value(r.px ignore nulls) over (partition by n.asset order by c.d rows between unbounded preceding and current row) as px
  from names n cross join cal c left join raw r on r.asset = n.asset and r.d = c.d),
panel as (select asset, d, px, row_number() over (partition by asset order by d) as rn from filled
  where d in (select d from filled group by d having count(px) = count(*)))"""
RET = f"""{PANEL}, ret as (select *, round(px / lag(px) over (partition by asset order by d) - 1, 10) as r from panel)"""
MARKET = "mkt as (select cast(date_trunc('week', l_shipdate) as date) as d, 100 * pow(sum(l_extendedprice) / sum(l_quantity), 0.1::double) as px from lineitem group by 1)"
LEDGER = "ledger as (select 'A' || user_id as asset, cast(ts as date) as observation_date, event_type as provider, round(value, 2) as price, ts as available_at, event_id from events)"


def ema(n: int, source: str = "panel", value: str = "px", name: str = "e") -> str:
    """Recursive average of (asset, rn, value), written out as a weighted sum."""
    a = f"(2.0::double / {n + 1})"
    return f"""{name} as (select x.asset, x.rn, sum(case when y.rn = 1 then pow(1 - {a}, x.rn - 1) else {a} * pow(1 - {a}, x.rn - y.rn) end * y.{value}) as v
  from {source} x join {source} y on x.asset = y.asset and y.rn <= x.rn group by 1, 2)"""


def w(n: int, by: str = "asset") -> str:
    return f"over (partition by {by} order by d rows between {n - 1} preceding and current row)"
