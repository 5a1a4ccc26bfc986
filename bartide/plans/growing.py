"""Registered queries: tables that grow by batches, restated levels, the latest days of a landed table, stops as keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.operators import prep
from bartide.plans.catalog import Query
from bartide.plans.feeds import scratch
from bartide.plans.market_sql import with_tables
from bartide.session import cut_lineage
from bartide.sources import batches, files
from bartide.sources import market as mk
from bartide.streaming import stops

STORED_UNTIL, OVERLAP_FROM, LATE_FROM = "2001-06-04", "2001-05-14", "2001-09-03"
KEY = ["index_name", "session"]


# ---- index levels that grow by checked batches (S14) ------------------------------------------------------------------------

def taken_batches(spark, folder):
    """(table folder, schema, outcomes): a first load, its update with an overlap, the same update again, one that contradicts what is stored and one without
    anything new."""
    levels = cut_lineage(mk.index_levels(spark, folder, mk.weekly_bars(spark, folder)).where(F.col("price").isNotNull()).select(*KEY, F.col("price").alias("level")))
    day = lambda text: F.lit(text).cast("date")
    first, update = levels.where(F.col("session") < day(STORED_UNTIL)), levels.where(F.col("session").between(day(OVERLAP_FROM), day(LATE_FROM)))
    shifted = levels.where(F.col("session") >= day(OVERLAP_FROM)).withColumn("level", F.col("level") * F.when(F.col("index_name") == "ASIA", 1.001).otherwise(1.0))
    table = scratch(spark, "levels")
    steps = [("1 load", "load", first), ("2 update", "update", update), ("3 again", "update", update), ("4 contradicts", "shifted", shifted), ("5 nothing new", "second look", update)]
    outcomes = []
    for step, batch, rows in steps:
        version = batches.current(spark, table).number
        found = batches.append(spark, table, rows, batch, KEY, ["level"])
        outcomes.append((step, found.status, found.rows, batches.current(spark, table).number - version))
    return table, levels.schema, outcomes


def grown_levels(spark, folder):
    table, schema, _ = taken_batches(spark, folder)
    return batches.read(spark, table, schema)


def batch_outcomes(spark, folder):
    return spark.createDataFrame(taken_batches(spark, folder)[2], "step string, status string, rows long, versions long")


# ---- keyed rates by batches, merged in levels (S15, ST1) ------------------------------------------------------------------------

def merged_rates(spark, folder):
    """Rates of customers from the orders of each year in turn, every year a batch: versions of a key are merged as batches come in."""
    rows = cut_lineage(mk.table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), mk.arrival_key(
        (F.unix_date(F.to_date("o_orderdate")), 6), (F.col("o_orderkey"), 15)).alias("at"), F.col("o_totalprice").alias("rate")))
    table = scratch(spark, "rates")
    kept = rows.drop("year")
    for year in sorted(r["year"] for r in rows.select("year").distinct().collect()):  # a row a year
        batches.upsert(spark, table, rows.where(F.col("year") == year).select(kept.columns), f"year {year}", ["customer"], "at")
    return batches.read_latest(spark, table, kept.schema, ["customer"], "at").select("customer", "rate")


# ---- the latest days of a landed table (S12, S16, S1) ----------------------------------------------------------------------------

def landed_bars(spark, folder):
    """Bars as they land, a folder a session."""
    path = scratch(spark, "daily")
    bars = mk.weekly_bars(spark, folder).select("symbol", "session", "close", "turnover")
    bars.repartition("session").write.partitionBy("session").parquet(path)
    return path


def latest_turnover_files(spark, folder):
    """Median turnover over the latest 30 sessions on or before a day, of which only the files are opened."""
    rows = files.latest_days(spark, landed_bars(spark, folder), 30, "2001-09-28")
    return rows.groupBy("symbol").agg(F.percentile("turnover", F.lit(0.5)).alias("median_turnover"), F.count(F.lit(1)).alias("sessions"), F.max("session").alias("last"))


# ---- restated factor levels (P4, W15) ----------------------------------------------------------------------------------------------

AS_OF_DAYS = ("2000-06-30", "2001-03-30", "2001-11-30")
LATE_DAYS = 49


def published_levels(spark, folder):
    """(session, published, level, price): the market level of a session appears the same day, every ninth week's seven weeks later; the price index is always there."""
    bars = mk.weekly_bars(spark, folder)
    late = F.weekofyear("session") % 9 == 0
    return mk.factor_levels(spark, folder, bars).select("session", F.when(late, F.date_add("session", LATE_DAYS)).otherwise(F.col("session")).alias("published"),
                                                        F.col("market").alias("level"), F.col("large").alias("price"))


def restated_factors(spark, folder):
    """The market factor as it was known on several days: a level that was not published yet is bridged with the price index and flagged; once it is
    published the next answer carries it."""
    rows = prep.levels_as_of(published_levels(spark, folder), AS_OF_DAYS)
    before = F.lag("filled").over(Window.partitionBy("as_of").orderBy("session"))
    return rows.withColumn("market_ret", F.col("filled") / before - 1)


# ---- trailing stops as keyed state (ST3, W16, T13) --------------------------------------------------------------------------------

SHARE, NEAR_PCT, IDLE_DAYS, SECOND_LOT = 0.97, 0.5, 21, "1998-07-06"


def trailing_stop_alerts(spark, folder):
    """Weekly closes arrive in two lots: the stream takes the first one and stops, and a new run goes on from its state."""
    path, table, checkpoint = (scratch(spark, f"stops-{part}") for part in ("in", "out", "state"))
    bars = cut_lineage(mk.weekly_bars(spark, folder).select("symbol", "session", "close", F.col("session").cast("timestamp").alias("at")))
    for lot in (F.col("session") < F.lit(SECOND_LOT).cast("date"), F.col("session") >= F.lit(SECOND_LOT).cast("date")):
        bars.where(lot).write.mode("append").parquet(path)
        stream = spark.readStream.schema(bars.schema).parquet(path)
        stops.run_alerts(spark, stops.trailing_alerts(stream, SHARE, NEAR_PCT, IDLE_DAYS), table, checkpoint)
    return spark.read.schema(stops.ALERTS).parquet(table)


TRAILED_SQL = f"""
SELECT symbol, session, close, stop, CASE WHEN close <= stop THEN 'breached' ELSE 'near' END AS alert FROM (
  SELECT *, min(CASE WHEN close <= stop THEN session END) OVER (PARTITION BY symbol, run) AS hit FROM (
    SELECT *, {SHARE} * max(close) OVER (PARTITION BY symbol, run ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM (
      SELECT *, sum(CASE WHEN session - before > {IDLE_DAYS} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY session) AS run FROM (
        SELECT symbol, session, close, lag(session) OVER (PARTITION BY symbol ORDER BY session) AS before FROM bars))))
WHERE close <= stop * {1 + NEAR_PCT / 100} AND (hit IS NULL OR session <= hit)"""

QUERIES = [
    Query("grown_index_levels", "S14", "index_name:s session:d level:6", grown_levels, with_tables(f"""
SELECT index_name, session, price AS level FROM index_levels WHERE price IS NOT NULL AND session <= DATE '{LATE_FROM}'""")),
    Query("batch_outcomes", "S14", "step:s status:s rows:i versions:i", batch_outcomes, with_tables(f"""
SELECT '1 load' AS step, 'appended' AS status, count(*) FILTER (session < DATE '{STORED_UNTIL}') AS rows, 1 AS versions FROM lv
UNION ALL SELECT '2 update', 'appended', count(*) FILTER (session BETWEEN DATE '{STORED_UNTIL}' AND DATE '{LATE_FROM}'), 1 FROM lv
UNION ALL SELECT '3 again', 'repeated', 0, 0
UNION ALL SELECT '4 contradicts', 'conflict', count(*) FILTER (index_name = 'ASIA' AND session BETWEEN DATE '{OVERLAP_FROM}' AND DATE '{LATE_FROM}'), 0 FROM lv
UNION ALL SELECT '5 nothing new', 'nothing new', 0, 0""", lv="SELECT * FROM index_levels WHERE price IS NOT NULL")),
    Query("merged_rates", "S15 ST1", "customer:i rate:2", merged_rates,
          "SELECT o_custkey AS customer, arg_max(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS rate FROM orders GROUP BY 1"),
    Query("latest_turnover_files", "S12 S16 S1", "symbol:s median_turnover:3 sessions:i last:d", latest_turnover_files, with_tables("""
SELECT symbol, quantile_cont(turnover, 0.5) AS median_turnover, count(*) AS sessions, max(session) AS last FROM bars
WHERE session IN (SELECT DISTINCT session FROM bars WHERE session <= DATE '2001-09-28' ORDER BY session DESC LIMIT 30) GROUP BY 1""")),
    Query("restated_factors", "P4 W15", "as_of:d session:d filled:6 provisional:b market_ret:6", restated_factors, with_tables("""
SELECT as_of, session, filled, provisional, filled / lag(filled) OVER (PARTITION BY as_of ORDER BY session) - 1 AS market_ret FROM rec""",
        known=f"""SELECT as_of, row_number() OVER (PARTITION BY as_of ORDER BY session) AS k, session, large AS price,
          CASE WHEN session + CASE WHEN weekofyear(session) % 9 = 0 THEN {LATE_DAYS} ELSE 0 END <= as_of THEN market END AS level
          FROM factors JOIN (VALUES """ + ", ".join(f"(DATE '{d}')" for d in AS_OF_DAYS) + """) AS d(as_of) ON session <= as_of""",
        rec="""SELECT as_of, k, session, price, level AS filled, false AS provisional FROM known WHERE k = 1
          UNION ALL SELECT l.as_of, l.k, l.session, l.price, CASE WHEN l.level IS NULL THEN CASE WHEN r.filled IS NOT NULL AND l.price IS NOT NULL AND r.price > 0 THEN r.filled * l.price / r.price END ELSE l.level END,
            coalesce(l.level IS NULL AND r.filled IS NOT NULL AND l.price IS NOT NULL AND r.price > 0, false)
          FROM rec r JOIN known l ON l.as_of = r.as_of AND l.k = r.k + 1""")),
    Query("trailing_stop_alerts", "ST3 W16 T13", "symbol:s session:d close:6 stop:6 alert:s", trailing_stop_alerts, with_tables(TRAILED_SQL)),
]
