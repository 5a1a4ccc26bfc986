"""Registered queries: documents and exports written as they land, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bartide.plans.catalog import Query
from bartide.plans.feeds import scratch
from bartide.plans.market_sql import SYMBOL, with_tables
from bartide.sources import files
from bartide.sources import market as mk

LEAST_CAP = 40.0
FALLBACK_YIELD = 5.5


def action_files(spark, folder):
    """Corporate actions as one JSON list per symbol, read back: what changes prices on which day."""
    path = scratch(spark, "actions")
    raw = mk.raw_actions(spark, folder)
    files.write_documents(raw.select("symbol", F.struct("subject", F.col("ex_text").alias("exDate")).alias("record")), path)
    return files.read_actions(spark, path).groupBy("symbol", "ex_date", "kind", "factor").agg(F.count(F.lit(1)).alias("actions"))


def result_files(spark, folder):
    """Board meetings as one JSON list per symbol, read back: the days of results."""
    path = scratch(spark, "meetings")
    rows = mk.table(spark, folder, "lineitem").where((F.col("l_linenumber") == 4) & (F.col("l_quantity") >= 40))
    purpose = F.when(F.col("l_partkey") % 3 == 0, "Fund Raising").when(F.col("l_partkey") % 3 == 1, "Financial Results").otherwise("Board Meeting")
    about = F.when(F.col("l_partkey") % 3 == 2, "quarterly RESULTS of lot ").otherwise("lot ")
    record = F.struct(F.date_format("l_shipdate", "dd-MMM-yyyy").alias("bm_date"), purpose.alias("bm_purpose"), F.concat(about, F.col("l_orderkey").cast("string")).alias("bm_desc"))
    files.write_documents(rows.select(mk.symbol_of("l_suppkey").alias("symbol"), record.alias("record")), path)
    return files.read_results(spark, path)


def universe_export(spark, folder):
    """A screen exported as CSV and read back: coded, large enough, not excluded."""
    path = scratch(spark, "export")
    rows = mk.listings(spark, folder).join(mk.fundamentals(spark, folder).select("symbol", "market_cap"), "symbol")
    number = F.substring("symbol", 4, 10).cast("long")
    files.write_table(rows.select(F.col("company").alias("Name"), F.when(number % 10 != 9, F.col("symbol")).otherwise(" ").alias("NSE Code"), F.col("sector").alias("Industry Group"),
                                  F.col("sector").alias("Industry"), F.when(number % 10 != 8, F.format_string("%.4f", "market_cap")).otherwise("n/a").alias("Market Capitalization")), path, csv=True)
    excluded = rows.where(number % 10 == 7).select("symbol")
    return files.read_universe(spark, path, LEAST_CAP, excluded).select("symbol", "company", "industry", "market_cap")


def mark_files(spark, folder):
    """Settlement marks of options by session, written as text and read back."""
    path = scratch(spark, "marks")
    rows = mk.trades(spark, folder).where(F.col("instrument").startswith("INDEX "))
    means = rows.groupBy("session", "instrument").agg(F.avg("price").alias("settle"))
    files.write_table(means.select(F.date_format("session", "yyyy-MM-dd").alias("date"), "instrument", F.col("settle").cast("string").alias("settle")), path, csv=True)
    return files.read_marks(spark, path)


def factor_files(spark, folder):
    """Factor levels written as text, every tenth cell unreadable, and read back."""
    path = scratch(spark, "factors")
    names = ["market", "large", "bond", "rate"]
    levels = mk.factor_levels(spark, folder, mk.weekly_bars(spark, folder))
    shown = [F.when(F.dayofyear("session") % 10 != k, F.col(n).cast("string")).otherwise("-").alias(n) for k, n in enumerate(names)]
    files.write_table(levels.select(F.date_format("session", "dd-MM-yyyy").alias("date"), *shown), path, csv=True)
    return files.read_factors(spark, path, names)


def bill_files(spark, folder):
    """The latest bill yield per order priority, each priority with a file of its own; one has no auctions and takes the fixed yield."""
    parts = []
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "NONE"):
        path = scratch(spark, "bills")
        rows = mk.table(spark, folder, "orders").where(F.col("o_orderpriority") == priority)
        days = rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("y"))
        files.write_table(days.select(F.date_format("day", "dd-MMM-yyyy").alias("auction_date"), F.format_string("%.9f", F.col("y") / 100000).alias("yield_pct")), path, csv=True)
        parts.append(files.latest_bill(spark, path, FALLBACK_YIELD).withColumn("priority", F.lit(priority)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def day_files(spark, folder):
    """Price files named after their session; every 13th week's holds the rows of the week before and is refused."""
    path = scratch(spark, "days")
    bars = mk.weekly_bars(spark, folder)
    named = F.when(F.weekofyear("session") % 13 == 0, F.date_add("session", 7)).otherwise(F.col("session"))
    out = bars.where(F.weekofyear("session") % 13 != 1).select(
        F.col("symbol").alias("SYMBOL"), F.lit("EQ").alias("SERIES"), F.date_format("session", "dd-MMM-yyyy").alias("DATE1"), F.col("close").cast("string").alias("CLOSE_PRICE"),
        F.concat(F.lit("prices_"), F.date_format(named, "dd-MMM-yyyy"), F.lit(".csv")).alias("day"))
    files.write_table(out.repartition("day"), path, ["day"], csv=True)
    return files.read_prices(spark, path).select("symbol", "session", "close")


QUERIES = [
    Query("action_files", "S6", "symbol:s ex_date:d kind:s factor:6 actions:i", action_files, with_tables("SELECT symbol, ex_date, kind, factor, count(*) AS actions FROM actions GROUP BY ALL")),
    Query("result_files", "S7", "symbol:s event_date:d", result_files, f"""
SELECT DISTINCT {SYMBOL.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS event_date FROM lineitem WHERE l_linenumber = 4 AND l_quantity >= 40 AND l_partkey % 3 <> 0"""),
    Query("universe_export", "S9", "symbol:s company:s industry:s market_cap:4", universe_export, with_tables(f"""
SELECT l.symbol, l.company, l.sector AS industry, CAST(printf('%.4f', f.market_cap) AS DOUBLE) AS market_cap FROM listed l JOIN fund f ON f.symbol = l.symbol
WHERE l.suppkey % 10 NOT IN (7, 8, 9) AND CAST(printf('%.4f', f.market_cap) AS DOUBLE) >= {LEAST_CAP}""")),
    Query("mark_files", "S11 D11", "session:d instrument:s settle:6", mark_files, with_tables(
        "SELECT session, instrument, avg(price) AS settle FROM trades WHERE instrument LIKE 'INDEX %' GROUP BY 1, 2")),
    Query("factor_files", "S11 P4", "session:d market:6 large:6 bond:6 rate:6", factor_files, with_tables(
        "SELECT session, " + ", ".join(f"CASE WHEN dayofyear(session) % 10 <> {k} THEN {n} END AS {n}" for k, n in enumerate(("market", "large", "bond", "rate"))) + " FROM factors")),
    Query("bill_files", "S11 X11", "priority:s yield_pct:6 auction_date:d", bill_files, f"""
SELECT p.priority, coalesce(b.y, {FALLBACK_YIELD}) AS yield_pct, b.day AS auction_date FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('NONE')) AS p(priority) LEFT JOIN (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 100000 AS y FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) = 1) b ON b.o_orderpriority = p.priority"""),
    Query("day_files", "S4 S1", "symbol:s session:d close:6", day_files, with_tables(
        "SELECT symbol, session, close FROM bars WHERE weekofyear(session) % 13 > 1")),
]
