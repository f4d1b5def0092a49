"""Named queries of sources, price store, relational lookups and queues, each with its DuckDB equivalent. The
driver's tables stand for the sources: orders for jobs, customers for schedules, events for price rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import serving, store
from .operators import panel as P
from .oracle import LEDGER, PANEL
from .plans import derived as D
from .queries import _revised, _snapshot, _SNAP, query, r6
from .sources import files
from .sources import market as M
from .streaming import jobs

# ---------------------------------------------------------------- sources


@query(f"with {PANEL} select asset, d, round(px, 6) as px from panel where asset in (select p_brand from part where p_size = 50)")
def universe_panel(spark, sf):
    names = D.table(spark, sf, "part").filter("p_size = 50").select(F.col("p_brand").alias("ticker"))
    return M.of_universe(D.panel(spark, sf), names).select("asset", "d", *r6("px"))


@query(f"with {PANEL} select d, round(px, 6) as px from panel where asset = 'Brand#12'")
def market_proxy_series(spark, sf):
    proxy = M.market_proxy({"market_proxy": "Brand#12"})
    return D.panel(spark, sf).filter(F.col("asset") == proxy).select("d", *r6("px"))


@query("select p_name || p_partkey as short_name, coalesce(regexp_matches(nullif(p_type, 'PROMO'), 'econ|bond|fixed income', 'i'), false) as bond from part")
def bond_funds(spark, sf):
    kind = F.concat(F.nullif(F.col("p_type"), F.lit("PROMO")), F.when(F.rlike("p_type", F.lit("(?i)econ")), " bond").otherwise(""))
    return M.fund_names(D.table(spark, sf, "part").select(F.concat("p_name", "p_partkey").alias("short_name"), kind.alias("fund_type")))


@query("select p_partkey, round(p_retailprice / 1000, 2) as price from part")
def fund_nav_prices(spark, sf):
    return files.fund_prices(D.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("nav"))).select("p_partkey", "price")


_QUOTES = """raw as (select cast(ts as date) as d, event_id, (value * 1000)::bigint as v from events), q as (select d, max_by(v, event_id) filter (where event_id % 3 = 0) as pnj, max_by(v, event_id) filter (where event_id % 3 = 1) as like_pnj, max_by(v, event_id) filter (where event_id % 3 = 2) as sjc from raw group by 1)"""


@query(f"with {_QUOTES} select d, coalesce(pnj, like_pnj) as pnj_buy, coalesce(pnj + 10, like_pnj + 10) as pnj_sell, sjc as sjc_buy, sjc + 10 as sjc_sell from q")
def gold_quotes(spark, sf):
    """JSON of places and kinds with grouped numbers as text, back to columns."""
    e = D.table(spark, sf, "events").select(F.col("ts").cast("date").alias("d"), "event_id", (F.col("value") * 1000).cast("decimal(20,0)").cast("bigint").alias("v"))
    e = e.withColumn("name", F.element_at(F.array(F.lit("PNJ"), F.lit("Nhẫn PNJ"), F.lit("SJC")), (F.col("event_id") % 3 + 1).cast("int")))
    e = e.groupBy("d", "name").agg(F.max_by("v", "event_id").alias("v"))
    grouped = lambda c: F.regexp_replace(F.format_number(c, 0), ",", ".")
    kind = F.struct("name", grouped(F.col("v")).alias("buy"), grouped(F.col("v") + 10).alias("sell"))
    raw = e.groupBy("d").agg(F.to_json(F.array(F.struct(F.lit("HN").alias("name"), F.array(F.struct(F.lit("PNJ").alias("name"), F.lit("1").alias("buy"), F.lit("1").alias("sell"))).alias("gold_type")), F.struct(F.lit("TPHCM").alias("name"), F.collect_list(kind).alias("gold_type")))).alias("json"))
    return files.gold_quotes(raw)


_TEXT = """rows as (select cast(o_orderdate as date) as d, o_orderkey as ordinal, case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then null else o_totalprice end as a, case when o_orderkey % 11 = 0 then o_totalprice end as b from orders where o_orderdate between timestamp '1996-03-01' and timestamp '1998-02-01'),
one as (select d, a, b from (select *, row_number() over (partition by d order by ordinal desc) as n from rows) where n = 1), days as (select cast(x as date) as d from (select unnest(generate_series(timestamp '1996-01-01', timestamp '1998-06-30', interval 1 day)) as x))"""


def _gold_text(spark, sf):
    o = D.table(spark, sf, "orders").filter("o_orderdate between timestamp '1996-03-01' and timestamp '1998-02-01'")
    text = F.col("o_totalprice").cast("string")
    return o.select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, None).otherwise(text).alias("a"), F.when(F.col("o_orderkey") % 11 == 0, text).alias("b"))


@query(f"with {_TEXT} select days.d, a, b from days left join one on days.d = one.d")
def gold_calendar(spark, sf):
    rows = P.keep_last(_gold_text(spark, sf), ["d"], ["ordinal"]).select("d", *[F.col(c).try_cast("double").alias(c) for c in "ab"])
    return M.calendar_quotes(rows, "1996-01-01", "1998-06-30")


@query(f"with {_TEXT} select days.d, last_value(a ignore nulls) over (order by days.d rows unbounded preceding) as a, last_value(b ignore nulls) over (order by days.d rows unbounded preceding) as b from days left join one on days.d = one.d")
def gold_calendar_filled(spark, sf):
    return M.filled_calendar(_gold_text(spark, sf), ["a", "b"], "1996-01-01", "1998-06-30")


@query("select greatest((select max(cast(l_shipdate as date)) from lineitem), (select max(cast(o_orderdate as date)) from orders)) as last_day")
def latest_saved_day(spark, sf):
    a, b = D.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")), D.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return M.latest_saved(a, b, a.limit(0))


_CSV = """csv as (select event_id as row_number, case when event_id % 13 = 0 then null when event_id % 17 = 0 then 'no date' else strftime(ts, '%Y-%m-%d') end as date, case when event_id % 19 = 0 then null when event_id % 23 = 0 then 'x' when event_id % 29 = 0 then '-1' else '5.5' end as price from events)"""


def _csv_rows(spark, sf):
    k = F.col("event_id")
    day = F.when(k % 13 == 0, None).when(k % 17 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    price = F.when(k % 19 == 0, None).when(k % 23 == 0, "x").when(k % 29 == 0, "-1").otherwise("5.5")
    return D.table(spark, sf, "events").select(k.alias("row_number"), day.alias("date"), price.alias("price"))


@query(f"with {_CSV} select row_number, case when date is null or price is null then 'MISSING_VALUE' when date = 'no date' then 'INVALID_DATE' when price = 'x' then 'INVALID_NUMBER' else 'INVALID_PRICE' end as code from csv where date is null or price is null or date = 'no date' or price in ('x', '-1') order by row_number limit 100")
def csv_row_findings(spark, sf):
    return M.row_findings(_csv_rows(spark, sf))


@query(f"with {_CSV}, f as (select * from csv order by row_number limit 5000) select min(try_cast(date as date)) as first_day, max(try_cast(date as date)) as last_day, count(try_cast(date as date)) as n from f")
def csv_coverage(spark, sf):
    return M.coverage(_csv_rows(spark, sf))


_BARS = """b as (select o_custkey::varchar as symbol, cast(o_orderdate as date) as d, o_orderkey, case when o_orderkey % 31 = 0 then 0 else round(o_totalprice, 2) end as c from orders), k as (select *, row_number() over (partition by symbol, d order by o_orderkey) as n from b)"""


def _raw_bars(spark, sf):
    price = F.when(F.col("o_orderkey") % 31 == 0, "0").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    bar = F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00'").alias("t"), price.alias("c"))
    rows = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.array_sort(F.collect_list(bar)).alias("x"))
    return rows.select("symbol", F.to_json(F.struct(F.transform("x", lambda b: F.struct(b["t"].alias("t"), b["c"].alias("c"))).alias("data_day"))).alias("json"))


def _window():
    return F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")


@query(f"with {_BARS} select symbol, d, c::double as close from k where c > 0 and d between date '1996-01-01' and date '2000-12-31' and n = 1")
def normalised_bars(spark, sf):
    return M.normalised_bars(_raw_bars(spark, sf), *_window())[0].withColumn("close", F.col("close").cast("double"))


@query(f"with {_BARS} select symbol, case when c <= 0 then 'INVALID_PRICE' when d not between date '1996-01-01' and date '2000-12-31' then 'OUTSIDE_WINDOW' else 'DUPLICATE_DAY' end as code, count(*) as n from k where c <= 0 or d not between date '1996-01-01' and date '2000-12-31' or n > 1 group by 1, 2")
def rejected_bars(spark, sf):
    return M.normalised_bars(_raw_bars(spark, sf), *_window())[1].groupBy("symbol", "code").agg(F.count("*").alias("n"))


@query("select p_brand as symbol, count(*) as row_count, min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day from lineitem join part on l_partkey = p_partkey where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') group by 1")
def pack_manifest(spark, sf):
    rows = D.trades(spark, sf).select(F.col("asset").alias("symbol"), F.col("l_shipdate").cast("date").alias("d"))
    return M.pack_manifest(M.price_pack(rows, ["Brand#1", "Brand#2", "Brand#3"]))


@query("select key, sha is not null as registered, sha as sha256 from (select 'C' || c_custkey as key from customer where c_custkey % 10 <> 0 order by key limit 200 offset 100) left join (select 'C' || o_custkey as k, max(sha256(o_orderkey::varchar)) as sha from orders group by 1) on k = key")
def registered_page(spark, sf):
    """A page of the valid inventory keys with their registration."""
    key = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("bad "), "c_custkey")).otherwise(F.concat(F.lit("C"), "c_custkey"))
    keys = M.inventory(D.table(spark, sf, "customer").select(key.alias("key")))
    pins = D.table(spark, sf, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("key")).agg(F.max(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha256"))
    return store.inventory_page(keys, pins, 100, 200)


@query("select event_id, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'))::date as day, try_cast(replace(g, '.', '') as bigint) as n from (select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%d/%m/%Y') else 'none' end as t, case when event_id % 4 = 0 then 'n.a' else (event_id // 1000) || '.' || lpad((event_id % 1000)::varchar, 3, '0') end as g from events)")
def lenient_parses(spark, sf):
    k = F.col("event_id")
    day = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise("none")
    number = F.when(k % 4 == 0, "n.a").otherwise(F.concat(F.expr("event_id div 1000").cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")))
    return D.table(spark, sf, "events").select("event_id", S.parsed_date(day, "yyyy-MM-dd", "dd/MM/yyyy").alias("day"), S.grouped_integer(number).alias("n"))


@query("select p_partkey, round(p_retailprice * case when p_size % 2 = 0 then 1000 else 1 end, 4) as price from part")
def unit_normalised(spark, sf):
    unit = F.when(F.col("p_size") % 2 == 0, "thousand_vnd").otherwise("vnd")
    return D.table(spark, sf, "part").select("p_partkey", F.round(S.normalised_price(F.round("p_retailprice", 4), unit).cast("double"), 4).alias("price"))


@query(f"with {LEDGER}, s as (select d, row_number() over (order by d) as k from (select distinct observation_date as d from ledger)), x as (select event_id, observation_date, case event_id % 3 when 0 then 'stock' when 1 then 'gold' else 'fund' end as kind, available_at + interval 6 day as pub from ledger), f as (select a.d, b.d as fifth from s a left join s b on b.k = a.k + 5)\n"
       "select event_id, kind, case kind when 'stock' then observation_date + interval 18 hour when 'gold' then observation_date + interval 1 day else greatest(f.fifth + interval 18 hour, case when event_id % 2 = 0 then pub end) end as available_at from x join f on f.d = observation_date")  # fmt: skip
def availability_rules(spark, sf):
    """Same day 18:00 for stocks, the next day for gold, the fifth session after or the provider's time for funds."""
    rows = D.ledger(spark, sf)
    kind = F.element_at(F.array(F.lit("stock"), F.lit("gold"), F.lit("fund")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = rows.select("event_id", "observation_date", kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("available_at") + F.expr("interval 6 days")).cast("timestamp").alias("published"))
    later = P.sessions_after(rows.select(F.col("observation_date").alias("d")), 5)
    rows = rows.join(later.withColumnRenamed("d", "observation_date"), "observation_date")
    return rows.select("event_id", "kind", P.available_at("kind", "observation_date", "later", "published").alias("available_at"))


# ---------------------------------------------------------------- projections and lookups


@query("select c_custkey, w, round(w * c_acctbal, 4) as target, round(sum(w * c_acctbal) over (partition by c_nationkey), 2) as total, round((w - 0.2) * 1000) / 10 as points from (select *, round((c_custkey % 7) / 10.0::double, 3) as w from customer) where isfinite(c_acctbal) and c_acctbal > 0")
def display_weights(spark, sf):
    """Capital by weight, percentage points of a change, only finite positive capital."""
    rows = D.table(spark, sf, "customer").withColumn("w", F.round(F.col("c_custkey") % 7 / F.lit(10.0), 3)).filter(S.finite_positive("c_acctbal"))
    target, total = S.target_capital("c_acctbal", "w", "c_nationkey")
    return rows.select("c_custkey", "w", F.round(target, 4).alias("target"), F.round(total, 2).alias("total"), S.percentage_points(F.col("w") - 0.2).alias("points"))


@query("select p_brand as asset, list_aggregate(list(distinct p_size order by p_size), 'string_agg', ',') as sizes from part group by 1")
def weights_as_text(spark, sf):
    """Numbers kept as text, in order."""
    rows = D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.array_sort(F.collect_set("p_size")).alias("x"))
    return rows.select("asset", F.array_join(S.as_text("x"), ",").alias("sizes"))


@query("with a as (select o_custkey as k, sum(o_totalprice) as v from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, sum(o_totalprice) as v from orders where o_orderkey % 2 = 1 group by 1) select a.k, round(a.v, 2) as a, round(b.v, 2) as b, round(a.v - b.v, 2) as difference from a join b on a.k = b.k")
def reference_reconcile(spark, sf):
    o = D.table(spark, sf, "orders")
    a, b = (o.filter(F.col("o_orderkey") % 2 == i).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v")) for i in (0, 1))
    return store.one_to_one(a, b, ["k"], "v").select("k", *[F.round(c, 2).alias(c) for c in ("a", "b", "difference")])


@query(f"with {PANEL}, t as (select asset, d, case when rn % 9 = 0 then px + 0.5 else px end as other, px from panel where rn % 4 <> 0), r as (select *, abs((px / lag(px) over w - 1) - (other / lag(other) over w - 1)) as dr from t window w as (partition by asset order by d))\n"
       "select asset, count(*) filter (where px = other) as n_equal, count(*) filter (where px <> other) as n_different, round(max(abs(px - other)), 6) as max_price_diff, round(max(dr), 6) as max_return_diff from r group by 1")  # fmt: skip
def provider_price_compare(spark, sf):
    panel = D.panel(spark, sf)
    other = panel.filter("rn % 4 <> 0").select("asset", "d", F.when(F.col("rn") % 9 == 0, F.col("px") + 0.5).otherwise(F.col("px")).alias("px"))
    return store.price_compare(panel.select("asset", "d", "px"), other).select("asset", "n_equal", "n_different", *r6("max_price_diff", "max_return_diff"))


@query("select o_orderkey as recommendation, c_custkey as owner, o_orderstatus as status from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderstatus <> 'P'")
def recommendation_history(spark, sf):
    jobs_ = D.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    return D.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("recommendation"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status")).join(jobs_, "owner").select("recommendation", "owner", "status")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when p_partkey is null or p_size > 45 then 'UNKNOWN_ASSET' when s_suppkey is null or s_acctbal < 0 then 'NOT_PASSED' else 'OK' end as code, count(*) as n from lineitem left join part on p_partkey = l_partkey and p_size <= 45 left join supplier on s_suppkey = l_suppkey and s_acctbal >= 0 group by 1, 2, 3, 4, 5")
def observation_checks(spark, sf):
    """Every observation's asset must be known and its report have passed."""
    line = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    assets = D.table(spark, sf, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    passed = D.table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("passed"))
    code = F.when(F.col("known").isNull(), "UNKNOWN_ASSET").when(F.col("passed").isNull(), "NOT_PASSED").otherwise("OK")
    return line.join(assets, "l_partkey", "left").join(passed, "l_suppkey", "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code")).agg(F.count("*").alias("n"))


@query("select event_type, count(props) as with_metadata, count(*) - count(props) as without, count(*) filter (where extract(hour from ts) >= 18) as late, count(*) filter (where value > 100) as over_100 from events group by 1")
def availability_counts(spark, sf):
    e = D.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("props").alias("with_metadata"), F.count_if(F.col("props").isNull()).alias("without"), F.count_if(F.hour("ts") >= 18).alias("late"), F.count_if(F.col("value") > 100).alias("over_100"))


@query("select count(*) as n from orders where o_orderstatus = 'F' and o_totalprice > 1000 and o_orderdate < timestamp '2000-01-01'")
def filtered_count(spark, sf):
    return D.table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 1000 and o_orderdate < timestamp '2000-01-01'").agg(F.count("*").alias("n"))


@query("select user_id, min(event_id) as first_sequence, min(event_id) > 100 as truncated from events group by 1")
def min_sequence(spark, sf):
    """Retained events start at a sequence; a cursor before it must begin again."""
    return D.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_sequence")).withColumn("truncated", F.col("first_sequence") > 100)


@query(f"with {LEDGER}, m as (select observation_date, price, event_id from ledger where asset = 'A7' order by observation_date desc, event_id desc limit 20) select case when (select max(observation_date) from m) is null then 'NO_OBSERVATIONS' when date_diff('day', (select max(observation_date) from m), date '2024-02-01') > 7 then 'STALE' else 'AVAILABLE' end as status, m.* from (select 1) left join m on true")
def latest_facts(spark, sf):
    return store.latest_facts(D.ledger(spark, sf), "A7", "2024-02-01")


# ---------------------------------------------------------------- store


def _obs(spark, sf):
    e = D.ledger(spark, sf)
    unit = F.when(F.col("event_id") % 401 == 0, "usd").otherwise("vnd")
    return e.select("asset", "observation_date", F.when(F.col("asset") < "A4", "p").otherwise(F.col("provider")).alias("provider"), F.lit("close").alias("price_type"), F.when(F.col("event_id") % 503 == 0, -1.0).otherwise(F.col("price") + 1).alias("price"), unit.alias("source_unit"), F.lit(None).cast("string").alias("price_basis"), "available_at", "event_id")


_OBS = f"""{LEDGER}, obs as (select asset, observation_date, case when asset < 'A4' then 'p' else provider end as provider, case when event_id % 503 = 0 then -1 else price + 1 end as price, case when event_id % 401 = 0 then 'usd' else 'vnd' end as unit, available_at, event_id from ledger),
g as (select *, date_diff('day', lag(observation_date) over (partition by asset order by observation_date, event_id), observation_date) as gap from obs),
a as (select asset, count(distinct provider) as conv, max(gap) as gap, max(observation_date) as last, min(observation_date) as first, count(*) filter (where price <= 0) as bad, count(distinct unit) as bases, count(distinct observation_date) as n, count(*) filter (where available_at > timestamp '2024-01-29 00:00:00') as late from g group by 1)"""


@query(f"with {_OBS}, w as (select distinct asset from ledger union select 'A0' union select 'none') select w.asset, case when conv is null then 'MISSING' when conv > 1 then 'MIXED_PROVIDER' when gap > 7 then 'GAP' when date_diff('day', last, date '2024-02-01') > 7 then 'STALE' when date_diff('day', date '2024-01-01', first) > 7 then 'NO_START' when bad > 0 then 'INVALID_PRICE' when bases > 1 then 'MIXED_BASIS' else 'OK' end as code from w left join a on a.asset = w.asset")
def snapshot_rejections(spark, sf):
    wanted = D.ledger(spark, sf).select("asset").union(spark.range(1).select(F.explode(F.array(F.lit("A0"), F.lit("none")))))
    return store.snapshot_rejections(_obs(spark, sf), wanted, "2024-01-01", "2024-02-01", 7)


@query(f"with {_OBS}, s as (select count(distinct observation_date) as s from obs) select asset, n, unnest(list_filter([case when n <> s then 'UNALIGNED' end, case when conv > 1 then 'MIXED_CONVENTION' end, case when late > 0 then 'LATE' end, case when bad > 0 then 'INVALID_PRICE' end, case when date_diff('day', last, date '2024-01-29') > 2 then 'STALE' end, case when gap > 2 then 'GAP' end, case when n - 1 < 20 then 'SHORT' end], lambda x: x is not null)) as code from a cross join s")
def panel_violations(spark, sf):
    return serving.panel_violations(_obs(spark, sf), 0, F.lit("2024-01-29 00:00:00").cast("timestamp"), 2, 20)


@query("with b as (select event_id as row_number, cast(ts as date) as od, case when event_id % 3 = 0 then null when event_id % 5 = 0 then ts - interval 3 day when event_id % 7 = 0 then ts + interval 40 day else ts end as pub from events) select 1 as batch, row_number, 'PUBLISHED_EARLY' as code, 'error' as severity from b where pub::date < od union all select 1, row_number, 'PUBLISHED_LATE', 'error' from b where pub > timestamp '2024-02-01 00:00:00' union all select 1, row_number, 'INGESTION_KNOWN_AT', 'warning' from b where pub is null")
def publication_findings(spark, sf):
    k = F.col("event_id")
    at = F.when(k % 3 == 0, None).when(k % 5 == 0, F.col("ts") - F.expr("interval 3 days")).when(k % 7 == 0, F.col("ts") + F.expr("interval 40 days")).otherwise(F.col("ts"))
    rows = D.table(spark, sf, "events").select(F.lit(1).alias("batch"), k.alias("row_number"), F.col("ts").cast("date").alias("observation_date"), at.alias("published_at"))
    return store.publication_findings(rows, "2024-02-01 00:00:00")


@query("select 1 as batch, event_id as row_number, 'KIND_CHANGED' as code from events where case when event_id % 50 = 0 then 'gold' else 'stock' end <> case when user_id % 10 = 0 then 'gold' else 'stock' end")
def kind_conflicts(spark, sf):
    e = D.table(spark, sf, "events")
    rows = e.select(F.lit(1).alias("batch"), F.col("event_id").alias("row_number"), F.col("user_id").alias("asset"), F.when(F.col("event_id") % 50 == 0, "gold").otherwise("stock").alias("kind"))
    return store.kind_conflicts(rows, e.select(F.col("user_id").alias("asset"), F.when(F.col("user_id") % 10 == 0, "gold").otherwise("stock").alias("kind")).distinct())


@query("select user_id % 40 as batch, count(*) as n_rows, count(*) > 250 as too_many, count(*) filter (where value > 50) as n_findings, least(count(*) filter (where value > 50), 100) as told from events group by 1")
def batch_limits(spark, sf):
    e = D.table(spark, sf, "events").select((F.col("user_id") % 40).alias("batch"), "value")
    return store.limit_findings(e, e.filter("value > 50"), 250, 100)


@query(f"with {_SNAP}, f as (select asset, observation_date, price::double + case when extract(day from observation_date) % 9 = 0 then 1 else 0 end as price from snap where extract(day from observation_date) <> 5 union all select 'NEW', date '2024-01-03', 1.0), k as (select asset, observation_date, price::double as price from snap)\n"
       "select coalesce(f.asset, k.asset) as asset, coalesce(f.observation_date, k.observation_date) as observation_date, case when f.asset is null then 'REMOVED' when k.asset is null then 'NEW' when f.price <> k.price then 'CHANGED' else 'SAME' end as action from f full outer join k on f.asset = k.asset and f.observation_date = k.observation_date")  # fmt: skip
def history_reconciliation(spark, sf):
    known = _snapshot(spark, sf).select("asset", "observation_date", "price")
    fetched = known.filter("day(observation_date) <> 5").withColumn("price", F.col("price") + F.when(F.day("observation_date") % 9 == 0, 1.0).otherwise(0.0))
    new = spark.range(1).select(F.lit("NEW").alias("asset"), F.lit("2024-01-03").cast("date").alias("observation_date"), F.lit(1.0).alias("price"))
    return store.reconciled(fetched.unionByName(new), known, ["asset", "observation_date"], ["price"])


@query(f"""with {_SNAP}, h as (select asset, sha256(json_object('asset', asset, 'observation_date', observation_date::varchar, 'price', price::double::varchar)::varchar) as h from snap) select asset, sha256(string_agg(h, ',' order by h)) as content_hash, count(*) as n_rows from h group by 1""")
def content_addresses(spark, sf):
    return store.content_address(_snapshot(spark, sf), "asset", ["asset", "observation_date", "price"])


@query(f"with {_SNAP}, n as (select asset, count(*) as n from snap group by 1) select asset, n as n_rows from n where asset not in (select asset from snap where observation_date = date '2024-01-07')")
def new_contents(spark, sf):
    """Contents that are not stored yet; those of the assets seen on one day are."""
    all_ = store.content_address(_snapshot(spark, sf), "asset", ["asset", "observation_date", "price"])
    stored = all_.join(_snapshot(spark, sf).filter("observation_date = date '2024-01-07'").select("asset"), "asset", "left_semi")
    return store.not_stored(all_, stored).select("asset", "n_rows")


@query("with w as (select c_custkey as universe, s as strategy from customer cross join (select unnest(['F', 'O', 'P']) as s)), n as (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc) as k from orders) select universe, strategy, o_orderkey as entry_id, case when o_orderkey is null then 'UNAVAILABLE' when o_orderdate + interval 200 day >= timestamp '2001-06-01' then 'READY' else 'EXPIRED' end as status from w left join n on o_custkey = universe and o_orderstatus = strategy and k = 1")
def universe_status(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("universe"), F.col("o_orderstatus").alias("strategy"), F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("decision_at"), (F.col("o_orderdate") + F.expr("interval 200 days")).alias("valid_until"))
    wanted = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("universe"), F.explode(F.array(*map(F.lit, "FOP"))).alias("strategy"))
    return store.status_of(o, wanted, "2001-06-01 00:00:00")


@query("select o_orderkey, least(o_orderdate + interval 24 hour, cast(o_orderdate - interval 1 day * (o_orderkey % 6) as date) + interval 4 day - interval 1 microsecond) as valid_until from orders")
def bundle_validity(spark, sf):
    o = D.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    last = (F.col("o_orderdate") - F.make_dt_interval((F.col("o_orderkey") % 6).cast("int"))).cast("date")
    return o.select("o_orderkey", serving.valid_until(F.col("o_orderdate"), last, 3).alias("valid_until"))


# ---------------------------------------------------------------- queues


def _orders_as_jobs(spark, sf):
    o = D.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING")
    return o.select((F.col("o_custkey") % 50).alias("queue"), F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("next_attempt_at"), (F.col("o_orderdate") + F.expr("interval 2 days")).alias("lease_until"), F.col("o_orderdate").alias("created_at"))


@query("with j as (select o_custkey % 50 as queue, o_orderkey as job_id, (o_orderkey % 4)::int as attempts, o_orderdate as created_at from orders where (o_orderstatus = 'O' and o_orderdate + interval 1 day <= timestamp '1998-01-01') or (o_orderstatus not in ('O', 'F') and o_orderdate + interval 2 day <= timestamp '1998-01-01')), k as (select *, attempts >= 3 as spent, row_number() over (partition by queue, attempts >= 3 order by created_at, job_id) as n from j)\n"
       "select queue, job_id, case when spent then 'FAILED' else 'RUNNING' end as status, (attempts + case when spent then 0 else 1 end)::int as attempts, case when not spent then (attempts + 1)::int end as fence, case when not spent then timestamp '1998-01-01 00:10:00' end as lease_until from k where spent or n = 1")  # fmt: skip
def queue_claims(spark, sf):
    return jobs.claimed(_orders_as_jobs(spark, sf), "1998-01-01 00:00:00")


@query("select o_orderkey as job_id, least(3600, 30 * power(2, o_orderkey % 12)::bigint) as wait_seconds from orders")
def backoff_waits(spark, sf):
    return D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 12 + 1).alias("n")).select("job_id", jobs.backoff_seconds("n").alias("wait_seconds"))


@query("with s as (select c_custkey as schedule_id, c_custkey % 9 <> 0 as enabled, timestamp '2000-01-01' + interval 1 hour * (c_custkey % 97) as next_run_at, (30 + c_custkey % 5)::int as m, date '2000-01-01' - (c_custkey % 11 * 400)::int as first_day from customer), d as (select * from s where enabled and next_run_at <= timestamp '2000-01-03' and not exists (select 1 from orders where o_custkey = schedule_id and o_orderstatus in ('O', 'P') and o_orderdate + interval 30 day > timestamp '2000-01-03') order by next_run_at, schedule_id limit 20)\n"
       "select schedule_id, case when date_diff('day', first_day, date '2000-01-03') > 3650 then 'EXPIRED' else 'QUEUED' end as action, case when date_diff('day', first_day, date '2000-01-03') <= 3650 then 'tick:' || strftime(next_run_at, '%Y-%m-%d %H:%M:%S') end as tick_key, case when date_diff('day', first_day, date '2000-01-03') <= 3650 then timestamp '2000-01-03' + interval 1 minute * m end as next_run_at from d")  # fmt: skip
def schedule_tick(spark, sf):
    c, k = D.table(spark, sf, "customer"), F.col("c_custkey")
    next_run = F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 97).cast("int"))
    schedules = c.select(k.alias("schedule_id"), (k % 9 != 0).alias("enabled"), next_run.alias("next_run_at"), (30 + k % 5).cast("int").alias("interval_minutes"), F.date_sub(F.lit("2000-01-01").cast("date"), (k % 11 * 400).cast("int")).alias("first_day"))
    o = D.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED")
    live = o.select(F.col("o_custkey").alias("schedule_id"), status.alias("status"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("deadline"))
    return jobs.schedule_tick(schedules, live, "2000-01-03 00:00:00")


@query("with r as (select event_id as arrival, event_id % 4000 as e, event_id % 3000 as job_id, user_id % 3 as h, event_id % 5 as v from events), k as (select *, row_number() over (partition by e order by arrival) as n from r), j as (select o_orderkey as job_id, o_orderstatus as s, o_orderkey % 3 as h, o_orderkey % 5 as v, o_orderdate + interval 1 hour as dl from orders)\n"
       "select arrival, k.job_id, case when j.job_id is null or k.h <> j.h then 'UNMATCHED' when n > 1 then 'DUPLICATE' when s <> 'O' then 'TERMINAL' when dl <= timestamp '1998-01-01' then 'DEADLINE_EXCEEDED' when k.v <> j.v then 'STALE_VERSION' else 'SUCCEEDED' end as outcome from k left join j on j.job_id = k.job_id")  # fmt: skip
def result_correlation(spark, sf):
    e, o = D.table(spark, sf, "events"), D.table(spark, sf, "orders")
    results = e.select(F.col("event_id").alias("arrival"), (F.col("event_id") % 4000).alias("event_id"), (F.col("event_id") % 3000).alias("job_id"), (F.col("user_id") % 3).alias("input_hash"), (F.col("event_id") % 5).alias("version"))
    known = o.dropDuplicates(["o_orderkey"]).select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE").alias("status"), (F.col("o_orderkey") % 3).alias("input_hash"), (F.col("o_orderkey") % 5).alias("version"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour")).alias("deadline"))
    return jobs.correlated(results, known, "1998-01-01 00:00:00")


@query("select o_orderkey as job_id, case when o_orderstatus = 'O' and o_orderdate + interval 1 hour <= timestamp '1998-01-01' then 'FAILED' when o_orderstatus = 'O' then 'QUEUED' else 'OTHER' end as status from orders")
def deadline_expiry(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("OTHER").alias("status"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour")).alias("deadline"))
    return o.select("job_id", jobs.expired("status", "deadline", "1998-01-01 00:00:00").alias("status"))


@query("select event_id, ts as created_at from events where event_type = 'error' order by ts, event_id limit 20")
def outbox_batch(spark, sf):
    rows = D.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("published_at"))
    return jobs.outbox(rows).select("event_id", "created_at")


@query("select event_id, case when event_type in ('view', 'click') and event_id % 10 <> 0 then 'accepted' else 'dead' end as lane from events")
def validated_events(spark, sf):
    rows = D.table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"), F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("payload"))
    good, dead = jobs.validated(rows, "k int", ["view", "click"])
    return good.select("event_id", F.lit("accepted").alias("lane")).unionByName(dead.select("event_id", F.lit("dead").alias("lane")))
