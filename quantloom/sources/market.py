"""Market sources and sinks: universes, proxies, bars, calendars of quotes, pinned CSV files, artifacts that are
named by their content, published bundles."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import parsed_date, valid_id
from . import files

#: Fixed values of the sources: the name of bond funds' types, the default proxy, limits of one input.
BOND = "(?i)Trái phiếu|Bond|Fixed Income"
PROXY = "E1VFVN30"
MOST_BYTES, MOST_ROWS, MOST_FINDINGS, MOST_DAYS = 4 << 20, 5000, 100, 3650
FEWEST_SYMBOLS, MOST_SYMBOLS = 2, 20
BARS = "struct<data_day:array<struct<t:string,c:string>>>"


def split_path(entry: dict, phase: str, split: bool, exists: Callable[[str], bool]) -> str:
    """The phase's own file where files are split, train or test is asked for and the file exists; else the
    full one."""
    own = entry.get(f"{phase}_path") if split and phase in ("train", "test") else None
    return own if own and exists(own) else entry["full_path"]


def tickers(spark: SparkSession, config: dict, path: str) -> DataFrame:
    """The configured list, or the lines of a file."""
    listed = config.get("vn30_universe")
    if listed:
        return spark.createDataFrame([(t.strip(),) for t in listed if t.strip()], "ticker string")
    return files.read_lines(spark, path)


def market_proxy(config: dict) -> str:
    name = config.get("market_proxy", PROXY)
    if not isinstance(name, str) or not name.strip():
        raise ValueError("market_proxy must be a name")
    return name


def of_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """The panel's rows of the universe (ticker)."""
    return panel.join(universe.select(F.col("ticker").alias("asset")).distinct(), "asset", "left_semi")


def bars(spark: SparkSession, folder: str, index: bool = False, first: int = 0, batch: int | None = None) -> DataFrame:
    """Daily bars of a folder of CSV files; those of indices lie under indices/. first and batch take a part of
    the symbols in name order."""
    rows = files.ohlcv(spark, f"{folder}/indices" if index else folder)
    if not first and batch is None:
        return rows
    names = rows.select("symbol").distinct().withColumn("_i", F.row_number().over(Window.orderBy("symbol")) - 1)
    last = F.lit(True) if batch is None else F.col("_i") < first + batch
    return rows.join(names.filter((F.col("_i") >= first) & last).select("symbol"), "symbol", "left_semi")


def members(rows: DataFrame, index: str) -> DataFrame:
    """Tickers of an index from (index, ticker), once each, in name order."""
    return rows.filter(F.col("index") == index).select(F.trim("ticker").alias("ticker")).filter("ticker <> ''").distinct().orderBy("ticker")


def fund_names(funds: DataFrame) -> DataFrame:
    """short_name, and whether the fund's type says bond; no type, no bond."""
    return funds.select("short_name", F.coalesce(F.rlike("fund_type", F.lit(BOND)), F.lit(False)).alias("bond"))


def calendar_quotes(quotes: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each calendar day, null where nothing was quoted."""
    days = quotes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return days.join(quotes, "d", "left")


def filled_calendar(rows: DataFrame, columns: list[str], start: str, end: str) -> DataFrame:
    """Quotes as text (d, ordinal, columns): bad numbers become null, the last row of a day wins, every day of
    the range gets the last known value of each column."""
    numbers = rows.select("d", "ordinal", *[F.col(c).try_cast("double").alias(c) for c in columns])
    last = Window.partitionBy("d").orderBy(F.desc("ordinal"))
    one = numbers.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("d", *columns)
    year = F.year("d")
    daily = calendar_quotes(one, start, end).withColumn("_y", year)
    # filled year by year, then from the years before: no window over all days
    within = Window.partitionBy("_y").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    part = daily.select("d", "_y", *[F.last(c, ignorenulls=True).over(within).alias(c) for c in columns])
    ends = part.groupBy("_y").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("d"))).alias(f"_{c}") for c in columns])
    before = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_y", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    return part.join(carried, "_y").select("d", *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def latest_saved(*tables: DataFrame) -> DataFrame:
    """The last day of all tables (d); null with none."""
    out = None
    for t in tables:
        one = t.agg(F.max("d").alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.max("d").alias("last_day"))


def row_findings(rows: DataFrame, date_col: str = "date", price_col: str = "price", most: int = MOST_FINDINGS) -> DataFrame:
    """Of text rows (row_number, ...) the first broken rule of each, at most `most`, in row order."""
    day, price = parsed_date(date_col, "yyyy-MM-dd"), F.col(price_col).try_cast("decimal(24,6)")
    code = F.when(F.col(date_col).isNull() | F.col(price_col).isNull(), "MISSING_VALUE").when(day.isNull(), "INVALID_DATE").when(price.isNull(), "INVALID_NUMBER").when(price <= 0, "INVALID_PRICE")
    return rows.select("row_number", code.alias("code")).filter("code is not null").orderBy("row_number").limit(most)


def trusted_csv(spark: SparkSession, root: str, name: str, sha256: str, columns: list[str]) -> DataFrame:
    """Text rows (row_number, columns) of a file under the root whose bytes have the pinned hash. ValueError for a
    path that leaves the root, a file that is too large or another one, missing columns or too many rows."""
    if name.startswith("/") or ".." in name.split("/") or ":" in name:
        raise ValueError("path leaves the root")
    pin = spark.read.format("binaryFile").load(f"{root}/{name}").select("length", F.when(F.col("length") <= MOST_BYTES, F.sha2("content", 256)).alias("h")).first()
    if pin["length"] > MOST_BYTES or pin["h"] != sha256:
        raise ValueError("file too large" if pin["length"] > MOST_BYTES else "file changed")
    text = spark.read.text(f"{root}/{name}", wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", "^﻿|\r", ""), "\n")).alias("row_number", "line"))
    head = [c.strip() for c in lines.filter("row_number = 0").first()["line"].split(",")]
    if set(columns) - set(head):
        raise ValueError(f"missing columns {sorted(set(columns) - set(head))}")
    parts = F.from_csv("line", F.lit(", ".join(f"`{c}` string" for c in head)), {"mode": "PERMISSIVE"})
    rows = lines.filter("row_number > 0 and trim(line) <> ''").select(F.col("row_number").cast("bigint").alias("row_number"), parts.alias("x")).select("row_number", *[F.col(f"x.`{c}`").alias(c) for c in columns])
    if rows.count() > MOST_ROWS:
        raise ValueError("too many rows")
    return rows


def coverage(rows: DataFrame, date_col: str = "date", most: int = MOST_ROWS) -> DataFrame:
    """First and last day that parse among the first rows; bad rows are skipped."""
    day = parsed_date(date_col, "yyyy-MM-dd")
    return rows.orderBy("row_number").limit(most).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(day).alias("n"))


def normalised_bars(raw: DataFrame, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """(symbol, json) with data_day[] of (t, c) to (symbol, d, close), and the rejected bars with their reason: no
    price over 0, a day outside the window, a day twice."""
    bars_ = raw.select("symbol", F.posexplode(F.from_json("json", BARS)["data_day"]).alias("i", "b")).select("symbol", "i", F.try_to_timestamp(F.substring("b.t", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("d"), F.col("b.c").try_cast("decimal(24,6)").alias("close"))
    again = F.row_number().over(Window.partitionBy("symbol", "d").orderBy("i")) > 1
    code = F.when(F.col("d").isNull(), "INVALID_DATE").when(F.col("close").isNull() | (F.col("close") <= 0), "INVALID_PRICE").when((F.col("d") < start) | (F.col("d") > end), "OUTSIDE_WINDOW").when(again, "DUPLICATE_DAY")
    rows = bars_.withColumn("code", code)
    return rows.filter("code is null").select("symbol", "d", "close"), rows.filter("code is not null").select("symbol", "d", "close", "code")


def window_ok(start: Column, end: Column) -> Column:
    return (start <= end) & (F.date_diff(end, start) <= MOST_DAYS)


def price_pack(rows: DataFrame, symbols: list[str]) -> DataFrame:
    """The rows of a pack of FEWEST to MOST_SYMBOLS different symbols."""
    wanted = sorted(set(symbols))
    if len(wanted) != len(symbols) or not FEWEST_SYMBOLS <= len(wanted) <= MOST_SYMBOLS or not all(x and x.strip() for x in wanted):
        raise ValueError(f"a pack has {FEWEST_SYMBOLS} to {MOST_SYMBOLS} different symbols")
    return rows.filter(F.col("symbol").isin(wanted))


def pack_manifest(rows: DataFrame) -> DataFrame:
    """Per symbol rows, first and last day of a pack (symbol, d)."""
    return rows.groupBy("symbol").agg(F.count("*").alias("row_count"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def inventory(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Valid keys in name order."""
    return rows.filter(valid_id("key")).orderBy("key").limit(most)


# ------------------------------------------------------------------ stores of files


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def content_hash(rows: DataFrame) -> str:
    """Hash of the rows' hashes, whatever their order: hashes are summed in 32 parts, so equal rows count."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    one = rows.select(F.lit(1)).sparkSession.createDataFrame([("x",)], "x string")
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return one.crossJoin(sums).select(F.sha2(F.concat_ws("|", F.lit(",".join(sorted(rows.columns))), "n", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(8)]), 256)).first()[0]


def store_artifact(rows: DataFrame, root: str) -> str:
    """Writes the rows under their content's hash and returns it; what is there already stays as it is."""
    spark, name = rows.sparkSession, content_hash(rows)
    fs, path = _fs(spark, f"{root}/{name}/_SUCCESS")
    if not fs.exists(path):
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
    return name


def load_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of an artifact, whose content is hashed again."""
    rows = spark.read.parquet(f"{root}/{name}")
    if content_hash(rows) != name:
        raise ValueError(f"artifact {name} was changed")
    return rows


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str, sha256: str, most_bytes: int = 32 << 20) -> DataFrame:
    """A snapshot's observations if its manifest names this id and hash, and its size is in bounds."""
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{root}/{snapshot_id}/manifest.json").collect()))
    if manifest.get("id") != snapshot_id or manifest.get("content_hash") != sha256:
        raise ValueError("snapshot does not match its manifest")
    fs, path = _fs(spark, f"{root}/{snapshot_id}/rows")
    if fs.getContentSummary(path).getLength() > most_bytes:
        raise ValueError("snapshot too large")
    rows = spark.read.parquet(f"{root}/{snapshot_id}/rows")
    if content_hash(rows) != sha256:
        raise ValueError("snapshot was changed")
    return rows


def publish_snapshot(rows: DataFrame, root: str, snapshot_id: str) -> str:
    spark, sha256 = rows.sparkSession, content_hash(rows)
    rows.write.mode("errorifexists").parquet(f"{root}/{snapshot_id}/rows")
    _write_text(spark, f"{root}/{snapshot_id}/manifest.json", json.dumps({"id": snapshot_id, "content_hash": sha256}, sort_keys=True))
    return sha256


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _checksum(entry: dict) -> str:
    return hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def _commits(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """The highest number given out, and the entries of the whole commits in order. A commit that a crash cut short, or
    whose checksum is wrong, is none."""
    fs, folder = _fs(spark, f"{root}/log")
    if not fs.exists(folder):
        return 0, []
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
    entries = []
    for name in names:
        _, path = _fs(spark, f"{root}/log/{name}")
        stream = fs.open(path)
        try:
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()
        try:
            commit = json.loads(text)
            if commit["checksum"] == _checksum(commit["entry"]):
                entries.append(commit["entry"])
        except (ValueError, KeyError, TypeError):
            continue
    return max((int(n.split(".")[0]) for n in names), default=0), entries


def publish_bundle(spark: SparkSession, root: str, entry: dict, tries: int = 20) -> list[dict]:
    """Commits an entry (id, universe, decision_at, ...) and returns the catalog. The catalog is a log of numbered files, each
    made by an exclusive create and never changed, so writers need no lock: who finds a number taken takes the next. A
    crash leaves at most a file that is not whole, which readers pass over. An entry is immutable: the same one again
    changes nothing, another one of its id is refused."""
    for _ in range(tries):
        last, entries = _commits(spark, root)
        same = [x for x in entries if x["id"] == entry["id"]]
        if same and same[0] != entry:
            raise ValueError(f"{entry['id']} is published with other contents")
        if same:
            return _in_order(entries)
        try:
            _write_text(spark, f"{root}/log/{last + 1:010d}.json", json.dumps({"checksum": _checksum(entry), "entry": entry}, sort_keys=True))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            continue
        return read_catalog(spark, root, demo=True)
    raise RuntimeError(f"{root}: another writer took each of {tries} numbers")


def _in_order(entries: list[dict]) -> list[dict]:
    """Newest decision first; of equal ones the later commit. Of an id that two writers committed the first counts."""
    first = {}
    for x in entries:
        first.setdefault(x["id"], x)
    return sorted(reversed(first.values()), key=lambda x: x["decision_at"], reverse=True)


def read_catalog(spark: SparkSession, root: str, universe: str | None = None, demo: bool = False) -> list[dict]:
    """Entries, newest first, from the log; demo entries only where they are asked for."""
    rows = _in_order(_commits(spark, root)[1])
    return [x for x in rows if (universe is None or x["universe"] == universe) and (demo or not x.get("demo"))]


def write_metrics(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(tables: dict[str, DataFrame], root: str) -> None:
    """A run's tables, one folder of CSV files for each name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
