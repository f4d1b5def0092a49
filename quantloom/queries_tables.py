"""Named queries over kept tables and SQL text: merges by coverage, canonical documents, functions under SQL names."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import canonical, sql
from .operators import coverage
from .oracle import RET
from .plans import derived as D
from .queries import _BARS, query, r6
from .session import shared_folder
from .sources import paged
from .streaming import tail

EXTENDS = {"train": False, "test": True, "full": True}

_KEPT = """daily as (select cast(l_shipdate as date) as d, sum(l_extendedprice) / sum(l_quantity) as px, count(*) as n from lineitem group by 1),
saved as (select 'train' as phase, * from daily where d between date '1995-03-01' and date '1997-12-31' union all select 'test', * from daily where d between date '1998-01-01' and date '1999-06-30' union all select 'full', * from daily where d between date '1995-03-01' and date '1999-06-30'),
fresh as (select d, case when day(d) % 5 <> 0 then px * 1.01 end as px, case when day(d) % 7 <> 0 then n + 1 end as n from daily where d < date '1995-06-01' or d between date '1997-12-01' and date '1998-02-01' or d > date '1999-07-10'),
cov as (select phase, min(d) as first, max(d) as last, count(*) as n_saved from saved group by 1), ext(phase, extends) as (values ('train', false), ('test', true), ('full', true))"""


def _kept(spark, sf):
    """A daily series kept in three phases, and an update before, inside and after their coverage, with gaps."""
    rows = D.held(D.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"), F.count("*").alias("n")))
    parts = {"train": ("1995-03-01", "1997-12-31"), "test": ("1998-01-01", "1999-06-30"), "full": ("1995-03-01", "1999-06-30")}
    inside = F.array(*[F.when(F.col("d").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(p)) for p, (a, b) in parts.items()])
    saved = rows.select(F.explode(F.array_compact(inside)).alias("phase"), "d", "px", "n")
    new = rows.filter("d < date '1995-06-01' or d between date '1997-12-01' and date '1998-02-01' or d > date '1999-07-10'")
    return saved, new.select("d", F.when(F.day("d") % 5 != 0, F.col("px") * 1.01).alias("px"), F.when(F.day("d") % 7 != 0, F.col("n") + 1).alias("n"))


@query(
    f"""with {_KEPT}, took as (select c.phase, f.* from fresh f join cov c on f.d >= c.first join ext using (phase) where extends or f.d <= c.last),
one as (select phase, d, coalesce(max(px) filter (where s = 1), max(px) filter (where s = 0)) as px, coalesce(max(n) filter (where s = 1), max(n) filter (where s = 0)) as n from (select *, 0 as s from saved union all select *, 1 from took) group by 1, 2)
select phase, d, round(last_value(px ignore nulls) over (partition by phase order by d rows unbounded preceding), 6) as px, last_value(n ignore nulls) over (partition by phase order by d rows unbounded preceding) as n from one"""
)
def coverage_merge(spark, sf):
    saved, new = _kept(spark, sf)
    return coverage.merged(saved, new, EXTENDS, ["px", "n"]).select("phase", "d", *r6("px"), "n")


@query(
    f"""with {_KEPT}, met as (select c.phase, f.d, f.d >= c.first and (extends or f.d <= c.last) as taken, f.d < (select min(d) from saved) as early, not extends and f.d > c.last as late, c.last from fresh f cross join cov c join ext using (phase)),
s as (select phase, count(*) filter (where taken) as n_taken, count(*) filter (where early) as n_before, count(*) filter (where late) as n_refused, min(d) filter (where taken) as f, count(*) filter (where taken and d > last) as more from met group by 1)
select phase, n_saved, n_taken, n_before, n_refused, (case when n_taken > 0 then greatest(date_diff('day', last, f) - 1, 0) else 0 end)::int as gap_days, case when n_taken = 0 then 'skipped' when more > 0 then 'extended' else 'refreshed' end as status from cov join s using (phase)"""
)
def coverage_notes(spark, sf):
    """What the update does to each phase."""
    return coverage.notes(*_kept(spark, sf), EXTENDS)


@query(
    """select c_custkey, sha256('{"account":{"balance":' || c_acctbal::double::varchar || ',"segment":"' || c_mktsegment || '"},"key":' || c_custkey || ',"moved":null,"names":["' || c_name || '","' || n_name || '"],"ok":' || case when c_acctbal > 0 then 'true' else 'false' end
|| ',"shares":{"a":' || (c_custkey / 8.0::double)::varchar || ',"b":0.5}}') as document_sha256 from customer join nation on c_nationkey = n_nationkey"""
)
def canonical_documents(spark, sf):
    """Digest of each customer as a nested document."""
    rows = D.table(spark, sf, "customer").join(D.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    account = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"))
    shares = F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.col("c_custkey") / 8)
    whole = F.struct(F.col("c_custkey").alias("key"), account.alias("account"), F.array("c_name", "n_name").alias("names"), F.lit(None).cast("date").alias("moved"), (F.col("c_acctbal") > 0).alias("ok"), shares.alias("shares"))
    out = rows.select("c_custkey", whole.alias("doc"))
    return out.select("c_custkey", canonical.document_hash(F.col("doc"), out.schema["doc"].dataType).alias("document_sha256"))


@query(
    f"""with {RET}, s as (select asset, max_by(px, d) / min_by(px, d) - 1 as total, count(r) as n, min(r) as low from ret group by 1)
select asset, round(total, 6) as total, round(pow(1 + total, 252.0::double / n) - 1, 6) as annual, round(least(greatest(low, -0.05), 0.05), 6) as worst, case when low <= -0.2 then 'crisis' when low <= -0.1 then 'stress' else 'normal' end as regime, regexp_matches(asset, '^[A-Z0-9_-]{{1,64}}$') as valid from s"""
)
def sql_names(spark, sf):
    """Functions of the library called from SQL text."""
    sql.register(spark)
    return spark.sql(
        """with s as (select asset, simple_return(max_by(px, d), min_by(px, d)) as total, count(r) as n, min(r) as low from {returns} group by asset)
           select asset, round(total, 6) as total, round(annual_return(total, n), 6) as annual, round(clipped(low, -0.05D, 0.05D), 6) as worst, regime_of(1D, low) as regime, is_valid_id(asset) as valid from s""",
        returns=D.panel_returns(spark, sf),
    )


@query(
    """with r as (select r_name, n_name, row_number() over (partition by r_name order by n_name) as i from nation join region on n_regionkey = r_regionkey),
s as (select a.r_name, a.n_name || ',' || b.n_name || ',' || c.n_name as members, a.i, b.i as j, c.i as k from r a join r b on a.r_name = b.r_name and a.i < b.i join r c on b.r_name = c.r_name and b.i < c.i)
select r_name, row_number() over (partition by r_name order by i, j, k) - 1 as place, members from s"""
)
def nation_subsets(spark, sf):
    """All subsets of three nations of each region, from the table function in SQL text."""
    sql.register(spark)
    both = D.table(spark, sf, "nation").join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return spark.sql(
        """with packed as (select r_name, array_sort(collect_list(n_name)) as names from {rows} group by r_name)
           select r_name, s.place, array_join(transform(s.members, i -> names[i - 1]), ',') as members from packed, lateral combinations(size(names), 3) s""",
        rows=both,
    )


@query(f"with {_BARS} select asset as symbol, d, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, row_number() over (partition by asset order by d)::double as volume from bars qualify d >= date '1996-01-01'")
def paged_bars(spark, sf):
    """Weekly bars from pages of 50 rows for each symbol, which Spark writes first, with the first days pushed down."""
    by = Window.partitionBy("asset").orderBy("d")
    rows = D.bars(spark, sf).withColumn("volume", F.row_number().over(by).cast("double"))
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages = rows.select(F.col("asset").alias("symbol"), F.floor((F.col("volume") - 1) / 50).cast("int").alias("page"), F.col("d").cast("string").alias("d"), "open", "high", "low", "close", "volume")
    pages.repartition("symbol").write.partitionBy("symbol", "page").json(path)
    paged.register(spark)
    out = spark.read.format("paged_bars").options(path=path, batch="4").load().filter("d >= date '1996-01-01'")
    return out.select("symbol", "d", *r6("open", "high", "low", "close"), "volume")


@query(
    """with log as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as sequence from events), kept as (select * from log where ts >= (select max(ts) from events) - interval 14 day),
c as (select user_id, user_id % 40 as cursor, min(sequence) as first from kept group by 1), a as (select *, cursor + 1 < first as reset, case when cursor + 1 < first then first - 1 else cursor end as start from c)
select user_id::varchar as key, cursor, reset, sequence, event_id from kept join a using (user_id) where sequence > start and sequence <= start + 20"""
)
def cursor_poll(spark, sf):
    """The next 20 events of each reader from a log that keeps two weeks."""
    e = D.table(spark, sf, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    log = e.select("user_id", "event_id", "ts", number.alias("sequence")).crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("interval 14 days")).alias("since")))).filter("ts >= since")  # one row
    log = log.select(F.col("user_id").cast("string").alias("key"), "sequence", "event_id")
    cursors = e.select(F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 40).alias("cursor")).distinct()
    return tail.poll(log, cursors, 20).select("key", "cursor", "reset", "sequence", "event_id")
