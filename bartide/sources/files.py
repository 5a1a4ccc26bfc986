"""Readers and writers of the landed files: daily price files, index files, exports, JSON documents, ledgers.

Every reader states the columns it wants, takes text raw and casts it with try_cast, so that one bad cell is a null and
never fails a job. Directories are read at once; the session filter replaces the loop over day files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bartide.functions.numbers import missing_to_null, parse_number
from bartide.functions.text import action_parts

# fixed values: columns and date formats of the landed files
PRICE_COLUMNS = ["SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "LAST_PRICE", "CLOSE_PRICE", "AVG_PRICE",
                 "TTL_TRD_QNTY", "TURNOVER_LACS", "NO_OF_TRADES", "DELIV_QTY", "DELIV_PER"]
PRICE_NAMES = ["symbol", "series", "session", "prev_close", "open", "high", "low", "last", "close", "avg", "qty", "turnover", "trades", "deliv_qty", "deliv_per"]
DATE_FORMATS = ("dd-MMM-yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")
INGEST_SERIES, RETURN_SERIES = ("EQ", "BE", "SM"), ("EQ", "BE")


def any_date(text) -> Column:
    """A date in any of the known formats, else null."""
    clean = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(clean, F.lit(f))) for f in DATE_FORMATS])


def raw_csv(spark: SparkSession, path, columns: Sequence[str], first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """A CSV directory as trimmed text columns with trimmed header names; missing columns are nulls. With folders by year
    only those in question are read."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if "year" in rows.columns:
        rows = rows if first_year is None else rows.where(F.col("year") >= first_year)
        rows = rows if last_year is None else rows.where(F.col("year") <= last_year)
    found = {c.replace("﻿", "").strip(): c for c in rows.columns}
    return rows.select(*[F.trim(F.col(f"`{found[c]}`")).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in columns])


def read_prices(spark: SparkSession, path, start: str | None = None, end: str | None = None, symbols: DataFrame | None = None,
                series: Sequence[str] = INGEST_SERIES, aliases: DataFrame | None = None) -> DataFrame:
    """Daily price rows of a directory of day files, cleaned and filtered; files full of another session's rows left out."""
    raw = raw_csv(spark, path, PRICE_COLUMNS, *[d and int(d[:4]) for d in (start, end)]).withColumn("file", F.input_file_name())
    typed = clean_prices(raw)
    kept = own_session(typed).where(F.col("series").isin(*series))
    if start:
        kept = kept.where(F.col("session") >= F.lit(start).cast("date"))
    if end:
        kept = kept.where(F.col("session") <= F.lit(end).cast("date"))
    if aliases is not None:
        kept = kept.join(aliases, F.col("symbol") == F.col("old"), "left").withColumn("symbol", F.coalesce("new", "symbol")).drop("old", "new")
    return kept if symbols is None else kept.join(symbols.select("symbol"), "symbol", "left_semi")


def clean_prices(raw: DataFrame) -> DataFrame:
    """Text price columns to typed ones: thousands separators removed, unreadable cells null."""
    texts = {"SYMBOL", "SERIES"}
    columns = []
    for source, name in zip(PRICE_COLUMNS, PRICE_NAMES):
        if source in texts:
            columns.append(F.trim(source).alias(name))
        elif source == "DATE1":
            columns.append(any_date(source).alias(name))
        else:
            columns.append(missing_to_null(F.regexp_replace(source, ",", "").try_cast("double")).alias(name))
    rest = [c for c in raw.columns if c not in PRICE_COLUMNS]
    return raw.select(*columns, *rest)


def file_day(name: str = "file") -> Column:
    """The session a day file is named after ('..._05-Jan-2026.csv')."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(name, r"(\d{2}-[A-Za-z]{3}-\d{4})", 1), F.lit("dd-MMM-yyyy")))


def own_session(rows: DataFrame) -> DataFrame:
    """Drop files none of whose rows belong to the session in the file's (or its folder's) name: a holiday answered with
    another day. Files named after no day are kept without looking at their rows together."""
    dated = rows.withColumn("_day", file_day())
    good = dated.where(F.col("_day").isNotNull()).groupBy("_day").agg(F.max(F.coalesce(F.col("session") == F.col("_day"), F.lit(False))).alias("_own"))
    # a row a day, so broadcast: a shuffle would send all rows of files named after no day to one task, as their key is null
    return dated.join(F.broadcast(good), "_day", "left").where(F.col("_day").isNull() | F.col("_own")).drop("file", "_day", "_own")


def read_index(spark: SparkSession, path, name: str) -> DataFrame:
    """Closes of one index from a directory of index files."""
    columns = ["Index Name", "Index Date", "Open Index Value", "High Index Value", "Low Index Value", "Closing Index Value"]
    rows = raw_csv(spark, path, columns).where(F.lower(F.trim("Index Name")) == name.strip().lower())
    values = [parse_number(F.col(c)).alias(n) for c, n in zip(columns[2:], ("open", "high", "low", "close"))]
    return rows.select(F.lit(name).alias("index_name"), any_date("Index Date").alias("session"), *values).dropna(subset=["session", "close"])


def read_total_return(spark: SparkSession, path, as_of: str | None = None) -> DataFrame:
    """Total-return index levels; raises when a required column is absent."""
    columns = ["IndexName", "Date", "Total Returns Index", "Net Total Return Index"]
    header = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    absent = [c for c in columns if c not in header]
    if absent:
        raise ValueError(f"missing column(s): {', '.join(absent)}")
    rows = raw_csv(spark, path, columns).select(F.col("IndexName").alias("index_name"), any_date("Date").alias("session"),
                                                parse_number("Total Returns Index").alias("tri"), parse_number("Net Total Return Index").alias("net_tri"))
    rows = rows.dropna(subset=["session", "tri"])
    return rows if as_of is None else rows.where(F.col("session") <= F.lit(as_of).cast("date"))


def _documents(spark: SparkSession, path, schema: str) -> DataFrame:
    """Records of JSON lists, one list per symbol; the symbol is the file's name or its folder's (symbol=...)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows if "symbol" in rows.columns else rows.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json$", 1))


def read_actions(spark: SparkSession, path) -> DataFrame:
    """Adjusting corporate actions from JSON documents."""
    named = _documents(spark, path, "subject string, exDate string").withColumn("ord", F.monotonically_increasing_id())
    parsed = named.select("symbol", any_date("exDate").alias("ex_date"), "ord", "subject", action_parts("subject").alias("a"))
    return parsed.where(F.col("a").isNotNull() & F.col("ex_date").isNotNull()).select("symbol", "ex_date", "ord", "a.kind", "a.factor", "subject")


def read_results(spark: SparkSession, path) -> DataFrame:
    """Days of board meetings about results from JSON documents."""
    rows = _documents(spark, path, "bm_date string, bm_purpose string, bm_desc string")
    about = F.lower(F.concat_ws(" ", "bm_purpose", "bm_desc")).contains("result")
    return (rows.where(about).select("symbol", any_date("bm_date").alias("event_date"))
            .where(F.col("event_date").isNotNull()).distinct())


def read_universe(spark: SparkSession, path, min_cap: float, excluded: DataFrame | None = None) -> DataFrame:
    """Members of an exported screen: coded, large enough, not excluded by name or industry."""
    columns = ["Name", "NSE Code", "Industry Group", "Industry", "Market Capitalization"]
    rows = raw_csv(spark, path, columns).select(
        F.col("NSE Code").alias("symbol"), F.col("Name").alias("company"), F.col("Industry Group").alias("industry_group"), F.col("Industry").alias("industry"),
        F.col("Market Capitalization").try_cast("double").alias("market_cap"))
    kept = rows.where((F.length("symbol") > 0) & (F.col("market_cap") >= min_cap))
    return kept if excluded is None else kept.join(excluded.select("symbol"), "symbol", "left_anti")


def read_ledger(spark: SparkSession, path) -> DataFrame:
    rows = raw_csv(spark, path, ["date", "instrument", "action", "quantity", "price", "note"])
    return rows.select(any_date("date").alias("session"), "instrument", "action", F.col("quantity").try_cast("double").alias("quantity"),
                       F.col("price").try_cast("double").alias("price"), "note")


def read_marks(spark: SparkSession, path) -> DataFrame:
    """Settlement marks of options, one per session and instrument: the first one noted."""
    rows = raw_csv(spark, path, ["date", "instrument", "settle"]).select(any_date("date").alias("session"), "instrument", F.col("settle").try_cast("double").alias("settle"))
    return rows.dropna().dropDuplicates(["session", "instrument"])


def read_factors(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """Factor levels by session; an unreadable level is null, a row without a date is left out."""
    rows = raw_csv(spark, path, ["date", *names])
    return rows.select(any_date("date").alias("session"), *[parse_number(F.col(n)).alias(n) for n in names]).where(F.col("session").isNotNull())


def latest_bill(spark: SparkSession, path, fallback: float) -> DataFrame:
    """One row: the yield of the latest auction on file, or a fixed one, with the auction's day (null for the fixed one)."""
    rows = raw_csv(spark, path, ["auction_date", "yield_pct"]).select(any_date("auction_date").alias("day"), F.col("yield_pct").try_cast("double").alias("y")).dropna()
    return rows.agg(F.coalesce(F.max_by("y", "day"), F.lit(fallback)).alias("yield_pct"), F.max("day").alias("auction_date"))


def write_documents(records: DataFrame, path: str) -> None:
    """(symbol, record) as one JSON list per symbol, a folder each. A symbol has few records."""
    lists = records.groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list("record"))).alias("value"))
    lists.write.mode("overwrite").partitionBy("symbol").text(path)


def pledge_share(payload: str) -> Column:
    """Pledged percentage of the latest disclosure in a JSON payload; 0 for an empty list, null for a blank value."""
    data = F.from_json(payload, "data array<struct<shp: string, percPromoterShares: string>>")["data"]
    dated = F.transform(data, lambda r: F.struct(F.coalesce(any_date(r["shp"]), F.lit("1900-01-01").cast("date")).alias("day"), r["percPromoterShares"].alias("share")))
    latest = F.reduce(dated, F.get(dated, F.lit(0)), lambda best, r: F.when(r["day"] > best["day"], r).otherwise(best))
    return F.when(F.coalesce(F.size(data), F.lit(0)) <= 0, F.lit(0.0)).otherwise(parse_number(latest["share"]))


def write_table(rows: DataFrame, path: str, by: Sequence[str] = (), csv: bool = False) -> None:
    """Write a result as Parquet (or CSV for display), partitioned by the given columns."""
    writer = rows.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


def partition_days(spark: SparkSession, path: str, column: str = "session") -> list[str]:
    """The days a table has, from the names of its folders (`session=2001-05-07`): no file is opened. Bounded by the calendar."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def latest_days(spark: SparkSession, path: str, count: int, as_of: str | None = None, column: str = "session") -> DataFrame:
    """The rows of the latest `count` days on or before `as_of` of a table with a folder a day: the days are chosen before any data is read,
    so the scan opens the files of those days only."""
    days = [d for d in partition_days(spark, path, column) if as_of is None or d <= as_of][-count:]
    rows = spark.read.parquet(path)
    return rows.where(F.col(column).isin(*[F.lit(d).cast(rows.schema[column].dataType) for d in days]) if days else F.lit(False))
