"""Bitemporal price store: quality findings, all-or-nothing batches, append-only revisions, snapshots as
of a moment, content hashes, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_hash, valid_id

KEY = ["asset", "observation_date", "provider", "price_type"]
UNITS = {"stock": ["vnd", "thousand_vnd"], "fund": ["vnd", "thousand_vnd"], "gold": ["vnd_per_tael", "thousand_vnd"]}


def quality_findings(batch: DataFrame, now: str) -> DataFrame:
    """One row per broken rule: (batch, row_number, code, severity)."""
    double = F.row_number().over(Window.partitionBy("batch", *KEY).orderBy("row_number")) > 1
    units = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    unit_ok = F.array_contains(F.coalesce(F.try_element_at(units, F.col("kind")), F.array().cast("array<string>")), F.col("source_unit"))
    rules = [
        ("INVALID_ID", "error", ~valid_id("asset")),
        ("INVALID_PRICE", "error", F.col("price").isNull() | (F.col("price") <= 0)),
        ("FUTURE_DATE", "error", F.col("observation_date") > F.lit(now).cast("date")),
        ("UNIT_MISMATCH", "error", ~F.coalesce(unit_ok, F.lit(False))),
        ("DUPLICATE_KEY", "error", double),
        ("UNKNOWN_BASIS", "warning", F.coalesce(F.col("price_basis"), F.lit("unverified")) == "unverified"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, bad in rules]))
    return batch.select("batch", "row_number", found.alias("f")).select("batch", "row_number", F.explode("f").alias("f")).select("batch", "row_number", "f.code", "f.severity")


def accepted(batch: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows of batches without any error; a batch with one is left out whole."""
    bad = findings.filter("severity = 'error'").select("batch").distinct()
    return batch.join(bad, "batch", "left_anti")


def missing_sessions(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Expected days without an observation and observed days that are not expected, per asset."""
    days = sessions.agg(F.array_sort(F.collect_set("d")).alias("all"))
    have = prices.groupBy("asset").agg(F.collect_set("d").alias("have")).join(F.broadcast(days))
    out = have.select("asset", F.explode(F.concat(F.transform(F.array_except("all", "have"), lambda d: F.struct(d.alias("d"), F.lit("MISSING").alias("code"))), F.transform(F.array_except("have", "all"), lambda d: F.struct(d.alias("d"), F.lit("UNEXPECTED").alias("code"))))).alias("x"))
    return out.select("asset", "x.d", "x.code")


def revisions(observations: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """Append-only history: a row is a new revision if its content differs from the one before it, so a price
    that returns is a revision again. Numbered from 1."""
    by = Window.partitionBy(*key).orderBy(*order)
    rows = observations.withColumn("content_hash", canonical_hash(*content)).withColumn("_b", F.lag("content_hash").over(by))
    new = rows.filter(F.col("_b").isNull() | (F.col("_b") != F.col("content_hash"))).drop("_b")
    return new.withColumn("revision", F.row_number().over(by).cast("bigint"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def snapshot(revised: DataFrame, cutoff: str, key: list[str]) -> DataFrame:
    """What was known at the cutoff: the newest available revision of each key."""
    return latest(revised.filter(F.col("available_at") <= F.lit(cutoff).cast("timestamp")), key, ["available_at", "revision"])


def snapshot_checks(snap: DataFrame, as_of: str, max_age_days: int) -> DataFrame:
    """Per asset: rows, first and last day, largest gap in days, stale and gap flags."""
    gap = F.date_diff("observation_date", F.lag("observation_date").over(Window.partitionBy("asset").orderBy("observation_date")))
    rows = snap.select("asset", "observation_date").distinct().withColumn("gap", gap)
    out = rows.groupBy("asset").agg(F.count("*").alias("n"), F.min("observation_date").alias("first_day"), F.max("observation_date").alias("last_day"), F.max("gap").cast("bigint").alias("max_gap"))
    stale = F.date_diff(F.lit(as_of).cast("date"), F.col("last_day")) > max_age_days
    return out.withColumn("stale", stale).withColumn("gapped", F.coalesce(F.col("max_gap") > max(1, max_age_days), F.lit(False)))


def content_address(snap: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group the hash of its rows' hashes in order: equal content, equal address."""
    rows = snap.withColumn("_h", canonical_hash(*columns))
    return rows.groupBy(group).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("_h"))), 256).alias("content_hash"), F.count("*").alias("n_rows"))


def readiness(catalog: DataFrame, now: str) -> DataFrame:
    """Newest entry per universe and whether it still holds."""
    newest = latest(catalog, ["universe"], ["decision_at", "entry_id"])
    return newest.withColumn("status", F.when(F.col("valid_until") >= F.lit(now).cast("timestamp"), "READY").otherwise("EXPIRED"))


def publication_findings(batch: DataFrame, now: str) -> DataFrame:
    """Rules of publication times: not before the observation's day, not after the moment; without one the time
    of ingestion counts as that of knowledge, which is a warning."""
    at = F.col("published_at")
    rules = [
        ("PUBLISHED_EARLY", "error", at.cast("date") < F.col("observation_date")), ("PUBLISHED_LATE", "error", at > F.lit(now).cast("timestamp")), ("INGESTION_KNOWN_AT", "warning", at.isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, bad in rules]))
    return batch.select("batch", "row_number", F.explode(found).alias("f")).select("batch", "row_number", "f.code", "f.severity")


def kind_conflicts(batch: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows whose kind is not the one that the asset (asset, kind) has had from the start."""
    return batch.join(assets.select("asset", F.col("kind").alias("known_kind")), "asset").filter("kind <> known_kind").select("batch", "row_number", F.lit("KIND_CHANGED").alias("code"))


def limit_findings(batch: DataFrame, findings: DataFrame, most_rows: int = 5000, most_findings: int = 100) -> DataFrame:
    """Per batch its rows and whether they are too many, and how many findings are told of how many."""
    n = batch.groupBy("batch").agg(F.count("*").alias("n_rows"))
    f = findings.groupBy("batch").agg(F.count("*").alias("n_findings"))
    out = n.join(f, "batch", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return out.select("batch", "n_rows", (F.col("n_rows") > most_rows).alias("too_many"), "n_findings", F.least("n_findings", F.lit(most_findings)).alias("told"))


def snapshot_rejections(snap: DataFrame, wanted: DataFrame, start: str, as_of: str, max_age_days: int) -> DataFrame:
    """Per wanted asset the first reason why a snapshot cannot use it, or OK: no observations, several providers,
    a gap, stale, no start, a bad price, several bases."""
    gap = F.date_diff("observation_date", F.lag("observation_date").over(Window.partitionBy("asset").orderBy("observation_date")))
    rows = snap.withColumn("_gap", gap).groupBy("asset").agg(
        F.count_distinct(F.struct("provider", "price_type")).alias("conventions"), F.max("_gap").alias("gap"), F.max("observation_date").alias("last"), F.min("observation_date").alias("first"),
        F.count_if(F.col("price").isNull() | (F.col("price") <= 0)).alias("bad"), F.count_distinct(F.struct("source_unit", F.coalesce("price_basis", F.lit("")))).alias("bases"),
    )
    code = (
        F.when(F.col("conventions").isNull(), "MISSING").when(F.col("conventions") > 1, "MIXED_PROVIDER").when(F.col("gap") > max(1, max_age_days), "GAP")
        .when(F.date_diff(F.lit(as_of).cast("date"), F.col("last")) > max_age_days, "STALE").when(F.date_diff(F.col("first"), F.lit(start).cast("date")) > max_age_days, "NO_START")
        .when(F.col("bad") > 0, "INVALID_PRICE").when(F.col("bases") > 1, "MIXED_BASIS").otherwise("OK")
    )
    return wanted.select("asset").distinct().join(rows, "asset", "left").select("asset", code.alias("code"))


def not_stored(candidates: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """Candidates whose content is new; the others are reused as they are."""
    return candidates.join(stored.select(key), key, "left_anti")


def reconciled(fetched: DataFrame, known: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """A whole history fetched again against the newest known revision of each key: what is new or changed is
    appended, what is the same stays, and a known key that is gone refuses the run. (key, action)"""
    a = fetched.select(*key, canonical_hash(*content).alias("_new"))
    b = known.select(*key, canonical_hash(*content).alias("_old"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_new").isNull(), "REMOVED").when(F.col("_old").isNull(), "NEW").when(F.col("_new") != F.col("_old"), "CHANGED").otherwise("SAME")
    return both.select(*key, action.alias("action"))


def status_of(catalog: DataFrame, universes: DataFrame, now: str) -> DataFrame:
    """Per wanted (universe, strategy) READY, EXPIRED, or UNAVAILABLE where the catalog has none."""
    newest = latest(catalog, ["universe", "strategy"], ["decision_at", "entry_id"])
    rows = universes.join(newest.select("universe", "strategy", "entry_id", "valid_until"), ["universe", "strategy"], "left")
    status = F.when(F.col("entry_id").isNull(), "UNAVAILABLE").when(F.col("valid_until") >= F.lit(now).cast("timestamp"), "READY").otherwise("EXPIRED")
    return rows.select("universe", "strategy", "entry_id", status.alias("status"))


def latest_facts(observations: DataFrame, asset: str, today: str, most: int = 20, max_age_days: int = 7) -> DataFrame:
    """An asset's newest observations (asset, observation_date, price, event_id) and one status for all."""
    mine = observations.filter(F.col("asset") == asset).orderBy(F.desc("observation_date"), F.desc("event_id")).limit(most)
    last = mine.agg(F.max("observation_date").alias("last"))
    status = F.when(F.col("last").isNull(), "NO_OBSERVATIONS").when(F.date_diff(F.lit(today).cast("date"), F.col("last")) > max_age_days, "STALE").otherwise("AVAILABLE")
    return last.select(status.alias("status")).join(mine.select("observation_date", "price", "event_id"), how="left")


def one_to_one(a: DataFrame, b: DataFrame, key: list[str], column: str) -> DataFrame:
    """Matched rows of two tables with the difference of a column; a key that either has twice is an error."""
    def once(rows: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*key))
        return rows.withColumn(column, F.when(n > 1, F.raise_error(F.lit("key is not unique")).cast("double")).otherwise(F.col(column)))

    left, right = once(a).select(*key, F.col(column).alias("a")), once(b).select(*key, F.col(column).alias("b"))
    return left.join(right, key).select(*key, "a", "b", (F.col("a") - F.col("b")).alias("difference"))


def price_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per asset common days of two price tables (asset, d, px): equal and different prices, largest differences
    of prices and of returns."""
    both = ours.join(theirs.withColumnRenamed("px", "other"), ["asset", "d"])
    by = Window.partitionBy("asset").orderBy("d")
    r = [F.col(c) / F.nullif(F.lag(c).over(by), F.lit(0.0)) - 1 for c in ("px", "other")]
    rows = both.withColumn("dr", F.abs(r[0] - r[1]))
    same = F.col("px") == F.col("other")
    return rows.groupBy("asset").agg(F.count_if(same).alias("n_equal"), F.count_if(~same).alias("n_different"), F.max(F.abs(F.col("px") - F.col("other"))).alias("max_price_diff"), F.max("dr").alias("max_return_diff"))


def inventory_page(keys: DataFrame, registered: DataFrame, offset: int, most: int) -> DataFrame:
    """A page of the inventory's keys with whether each is registered, and its pin (key, sha256)."""
    page = keys.orderBy("key").offset(offset).limit(most)
    return page.join(registered.select("key", "sha256"), "key", "left").select("key", F.col("sha256").isNotNull().alias("registered"), "sha256")
