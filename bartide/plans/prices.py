"""Registered queries: price preparation, calendars, as-of and event joins, gap filling, incremental tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.functions import text
from bartide.functions.numbers import parse_number, per_session_rate
from bartide.operators import prep
from bartide.operators import rolling as rl
from bartide.operators.ranking import quantiles
from bartide.plans.catalog import Query
from bartide.plans.market_sql import calendar_sql, with_tables
from bartide.sources import market as mk


FALLBACK_YIELD = 5.5  # percent, where no bill is known


def corporate_actions(spark, folder):
    """Published subjects and 'dd-MMM-yyyy' dates classified into adjusting actions."""
    raw = mk.raw_actions(spark, folder)
    parsed = raw.select("symbol", F.to_date("ex_text", "dd-MMM-yyyy").alias("ex_date"), "ord", text.action_parts("subject").alias("a"))
    return parsed.where(F.col("a").isNotNull()).select("symbol", "ex_date", "ord", "a.kind", "a.factor")


def adjusted(spark, folder):
    return prep.back_adjust(mk.weekly_bars(spark, folder), corporate_actions(spark, folder))


def jumps(spark, folder):
    return prep.unexplained_jumps(mk.weekly_bars(spark, folder))


def chained(spark, folder):
    return prep.chained_prices(adjusted(spark, folder))


def chained_limited(spark, folder):
    return prep.chained_prices(mk.weekly_bars(spark, folder), jump_limit=0.2)


def foreign_asof(spark, folder):
    sessions = mk.numbered_calendar(mk.weekly_bars(spark, folder))
    return prep.as_of(sessions, mk.foreign_closes(spark, folder), "session", "day", "close")


def last_close_asof(spark, folder):
    """Latest close on or before the order's day for the symbols of all its line items."""
    bars = mk.weekly_bars(spark, folder)
    lines = mk.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), mk.symbol_of("l_suppkey").alias("symbol"))
    orders = mk.table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(lines, "o_orderkey").select("symbol", "day")
    days = orders.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("orders"))
    return prep.as_of(days, bars.select("symbol", "session", "close"), "day", "session", "close", ["symbol"], strict=False)


def bridged(spark, folder):
    return prep.bridge_levels(mk.index_levels(spark, folder, mk.weekly_bars(spark, folder)), "level", "price")


def factor_table(spark, folder):
    """Factor levels on the session calendar with the foreign close strictly before each session, and their returns."""
    levels = mk.factor_levels(spark, folder, mk.weekly_bars(spark, folder))
    joined = prep.as_of(levels, mk.foreign_closes(spark, folder), "session", "day", "close").withColumnRenamed("close_asof", "crude")
    w = Window.orderBy("session")
    ret = {c: F.col(c) / F.lag(c).over(w) - 1 for c in ("market", "large", "bond", "rate", "crude")}
    moved = joined.withColumns({f"{c}_ret": e for c, e in ret.items()})
    return moved.where(F.col("rate_ret").isNotNull()).withColumn("mkt_excess", F.col("market_ret") - F.col("rate_ret"))


def grid_returns(spark, folder):
    """One-session returns on the calendar: null on a missed session and on the one after it."""
    bars = mk.weekly_bars(spark, folder)
    dense = prep.on_calendar(bars, mk.numbered_calendar(bars), ["close"])
    return dense.withColumn("ret", F.col("close") / F.nullif(rl.back("close", 1, order="n"), F.lit(0.0)) - 1)


def filled_closes(spark, folder):
    """Gaps on the calendar: carried without limit and carried once inside the history."""
    bars = mk.weekly_bars(spark, folder)
    dense = prep.on_calendar(bars, mk.numbered_calendar(bars), ["close"])
    return dense.withColumns({"ffill": rl.carried("close", order="n"), "ffill1": rl.carried_once_inside("close", order="n"),
                              "history": F.count("close").over(rl.so_far(order="n"))})


def rolling_stats(spark, folder):
    bars = mk.weekly_bars(spark, folder)
    return bars.select(
        "symbol", "session", rl.rolling("close", F.avg, 20, 15).alias("mean20"), rl.rolling("close", F.stddev_samp, 20, 15).alias("sd20"),
        rl.rolling("high", F.max, 20, 15).alias("max20"), rl.rolling("low", F.min, 20, 15).alias("min20"),
        rl.rolling_median("turnover", 20, 15).alias("median20"), rl.mean_shift("close", 5, 10).alias("shift"),
        (rl.back("close", 21) / rl.back("close", 126) - 1).alias("skip_ret"), (rl.ahead("close", 63) / F.col("close") - 1).alias("fwd_ret"),
        F.sum("qty").over(rl.so_far()).alias("cum_qty"), F.max("close").over(rl.so_far()).alias("peak"),
        rl.chained(F.col("close") / F.col("prev_close") - 1).alias("growth"))


def span(rows, *days):
    """One row with the first and the last of some day columns: the range their calendar has to cover."""
    return rows.agg(F.least(*[F.min(d) for d in days]).alias("first"), F.greatest(*[F.max(d) for d in days]).alias("last"))


def weekday_sessions(spark, folder):
    """Every order counted on the session calendar: sessions from the order to a horizon, at least one."""
    orders = (mk.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
              .withColumn("horizon", F.lit("2001-12-21").cast("date")))
    calendar = prep.weekday_calendar(span(orders, "day", "horizon"), mk.EXTRA_SESSIONS, mk.HOLIDAYS)
    return prep.sessions_between(orders, calendar, "day", "horizon", "sessions", at_least=1)


def expected(spark, folder):
    events = mk.table(spark, folder, "events").select("event_id", "ts")
    # ten days more on each side: a zone's offset, and the last session before the first moment
    days = events.agg(F.date_sub(F.to_date(F.min("ts")), 10).alias("first"), F.date_add(F.to_date(F.max("ts")), 10).alias("last"))
    return prep.expected_session(events, prep.weekday_calendar(days, mk.EXTRA_SESSIONS, mk.HOLIDAYS), "ts")


def staleness(spark, folder):
    """Trading days each sector index trails the reference date, its last third of the year being unpublished."""
    levels = mk.index_levels(spark, folder, mk.weekly_bars(spark, folder)).where(F.col("level").isNotNull())
    lag = F.length("index_name") * 7
    last = (levels.where(F.col("session") < F.date_sub(F.lit("2001-11-05").cast("date"), lag)).groupBy("index_name")
            .agg(F.max("session").alias("last")).withColumn("reference", F.lit("2001-11-30").cast("date")))
    calendar = prep.weekday_calendar(span(last, "last", "reference"), mk.EXTRA_SESSIONS, mk.HOLIDAYS)
    return prep.sessions_between(last, calendar, "last", "reference", "behind")


def events_of(spark, folder):
    """Announcement days: shipments of the fourth line item in large lots."""
    rows = mk.table(spark, folder, "lineitem").where((F.col("l_linenumber") == 4) & (F.col("l_quantity") >= 46))
    return rows.select(mk.symbol_of("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("event_date"))


def announcement_windows(spark, folder):
    bars = mk.weekly_bars(spark, folder)
    return prep.event_windows(events_of(spark, folder), bars, mk.benchmark(bars), mk.numbered_calendar(bars), active=20)


def appended_levels(spark, folder):
    """A stored level table extended by a fetched one; ASIA's fetch disagrees on the overlap and is refused."""
    levels = (mk.index_levels(spark, folder, mk.weekly_bars(spark, folder)).where(F.col("price").isNotNull())
              .select("index_name", "session", F.col("price").alias("level")))
    stored = levels.where(F.col("session") < F.lit("2001-06-04").cast("date"))
    shift = F.when(F.col("index_name") == "ASIA", 1.001).otherwise(1.0)
    fetched = levels.where(F.col("session") >= F.lit("2001-05-14").cast("date")).withColumn("level", F.col("level") * shift)
    return prep.append_checked(stored, fetched, ["index_name", "session"], "index_name", ["level"])


def upserted_rates(spark, folder):
    """Keyed rates from the orders, the last one written per day kept."""
    rows = mk.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_totalprice").alias("rate"))
    return prep.keep_last(rows, ["day"], "o_orderkey")


def latest_rates(spark, folder):
    """Per customer the yield of the latest bill (order) released by a date, a fixed rate where none is, and the rate of one session."""
    bills = mk.table(spark, folder, "orders").where(F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp")).select(
        F.col("o_custkey").alias("customer"), mk.arrival_key((F.unix_date(F.to_date("o_orderdate")), 6), (F.col("o_orderkey"), 15)).alias("at"),
        (F.col("o_totalprice") / 100000).alias("yield_pct"))
    last = prep.keep_last(bills, ["customer"], "at")
    customers = mk.table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"))
    rate = F.coalesce("yield_pct", F.lit(FALLBACK_YIELD))
    return customers.join(last, "customer", "left").select("customer", rate.alias("rate_pct"), F.col("yield_pct").isNull().alias("fallback"), per_session_rate(rate / 100).alias("session_rate"))


def last_turnover(spark, folder):
    """Median turnover over the latest 30 sessions of the calendar, on the symbols that traded."""
    bars = mk.weekly_bars(spark, folder)
    days = mk.numbered_calendar(bars)
    kept = bars.join(days.where(F.col("n") > F.lit(0)), "session")
    last = days.agg(F.max("n").alias("_last"))
    recent = kept.join(last, F.col("n") > F.col("_last") - 30).select("symbol", "turnover")
    return recent.groupBy("symbol").agg(F.percentile("turnover", F.lit(0.5)).alias("median_turnover"), F.count(F.lit(1)).alias("sessions"))


def latest_chain(spark, folder):
    """Per symbol the bars of the latest session on or before a date."""
    return prep.latest_on_or_before(mk.weekly_bars(spark, folder), "session", F.lit("2000-02-29").cast("date"), ["symbol"])


def tick_dedup(spark, folder):
    """One row per (symbol, day): the last tick written."""
    ticks = mk.table(spark, folder, "lineitem").select(
        mk.symbol_of("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day"),
        mk.arrival_key((F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 10), (F.round(F.col("l_extendedprice") * 100), 14)).alias("seq"),
        "l_quantity", "l_extendedprice")
    return prep.keep_last(ticks, ["symbol", "day"], "seq")


def cleaned_numbers(spark, folder):
    """Display text of every order value and back: currency signs, separators, percent signs, dashes."""
    rows = mk.table(spark, folder, "orders")
    shown = F.when(F.col("o_orderkey") % 5 == 0, "-").when(F.col("o_orderkey") % 5 == 1, F.concat(F.format_number("o_totalprice", 2), F.lit("%"))) \
        .otherwise(F.concat(F.lit(" ₹ "), F.format_number("o_totalprice", 2)))
    return rows.select(F.col("o_orderkey").alias("orderkey"), parse_number(shown).alias("value"))


def monthly_quantiles(spark, folder):
    """Exact cross-sectional median and deciles of turnover per session, without gathering a session in one task."""
    return quantiles(mk.weekly_bars(spark, folder), ["session"], "turnover", {"p10": 0.1, "median": 0.5, "p80": 0.8})


ROLL_SQL = """
SELECT symbol, session, CASE WHEN count(close) OVER r20 >= 15 THEN avg(close) OVER r20 END AS mean20,
  CASE WHEN count(close) OVER r20 >= 15 THEN stddev_samp(close) OVER r20 END AS sd20, CASE WHEN count(high) OVER r20 >= 15 THEN max(high) OVER r20 END AS max20,
  CASE WHEN count(low) OVER r20 >= 15 THEN min(low) OVER r20 END AS min20, CASE WHEN count(turnover) OVER r20 >= 15 THEN quantile_cont(turnover, 0.5) OVER r20 END AS median20,
  CASE WHEN count(close) OVER (w ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING) = 5 THEN avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(close) OVER (w ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING) END AS shift,
  lag(close, 21) OVER w / lag(close, 126) OVER w - 1 AS skip_ret, lead(close, 63) OVER w / close - 1 AS fwd_ret,
  sum(qty) OVER w AS cum_qty, max(close) OVER w AS peak, product(1 + coalesce(close / prev_close - 1, 0.0)) OVER w AS growth
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session), r20 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""

CHAIN_SQL = """
SELECT symbol, session, ret, adj AS adj_close, high * adj / close AS adj_high, low * adj / close AS adj_low FROM (
  SELECT symbol, session, high, low, close, ret, first_value(close) OVER w * product(1 + ret) OVER w AS adj FROM (
    SELECT *, CASE WHEN lag(close) OVER w IS NULL OR prev_close IS NULL THEN 0.0 {rule} ELSE close / prev_close - 1 END AS ret FROM {source}
    WINDOW w AS (PARTITION BY symbol ORDER BY session)) WINDOW w AS (PARTITION BY symbol ORDER BY session))"""

QUERIES = [
    Query("corporate_actions", "X3 S6 D9 X18", "symbol:s ex_date:d ord:i kind:s factor:6", corporate_actions, with_tables("SELECT * FROM actions")),
    Query("back_adjusted_prices", "P1 J9", "symbol:s session:d open:5 high:5 low:5 close:5 qty:3 prev_close:5", adjusted, with_tables("SELECT * FROM adjusted")),
    Query("unexplained_jumps", "F14", "symbol:s session:d prev_close:6 close:6 ret:6", jumps, with_tables(
        "SELECT symbol, session, prev_close, close, close / prev_close - 1 AS ret FROM osc_in WHERE rn > 1 AND abs(close / prev_close - 1) > 0.3")),
    Query("chained_prices", "P2", "symbol:s session:d ret:6 adj_close:4 adj_high:4 adj_low:4", chained,
          with_tables(CHAIN_SQL.format(rule="", source="adjusted"))),
    Query("chained_prices_without_jumps", "P3 F21", "symbol:s session:d ret:6 adj_close:5 adj_high:5 adj_low:5", chained_limited,
          with_tables(CHAIN_SQL.format(rule="WHEN abs(close / prev_close - 1) > 0.2 THEN 0.0", source="bars"))),
    Query("foreign_close_asof", "J6", "session:d n:i close_asof:6", foreign_asof, with_tables("""
SELECT session, n, f.close AS close_asof FROM cal ASOF LEFT JOIN foreign_closes f ON f.day < cal.session""")),
    Query("latest_close_asof", "J7", "symbol:s day:d orders:i close_asof:6", last_close_asof, with_tables("""
SELECT o.symbol, o.day, o.orders, b.close AS close_asof FROM asked o ASOF LEFT JOIN bars b ON b.symbol = o.symbol AND b.session <= o.day""",
        asked="""SELECT 'SYM' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS symbol, CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")),
    Query("bridged_index_levels", "W15 D3", "index_name:s session:d price:6 level:6 filled:6 provisional:b", bridged, with_tables("""
SELECT l.index_name, l.session, l.price, l.level, r.filled, r.provisional FROM lv l JOIN rec r ON r.index_name = l.index_name AND r.k = l.k""",
        lv="SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY session) AS k FROM index_levels",
        rec="""SELECT index_name, k, price, level AS filled, false AS provisional FROM lv WHERE k = 1
          UNION ALL SELECT l.index_name, l.k, l.price, CASE WHEN l.level IS NULL THEN CASE WHEN r.filled IS NOT NULL AND l.price IS NOT NULL AND r.price > 0 THEN r.filled * l.price / r.price END ELSE l.level END,
            coalesce(l.level IS NULL AND r.filled IS NOT NULL AND l.price IS NOT NULL AND r.price > 0, false)
          FROM rec r JOIN lv l ON l.index_name = r.index_name AND l.k = r.k + 1""")),
    Query("factor_returns", "P4 P5 D6 W1", "session:d market:6 large:6 bond:6 rate:6 crude:6 market_ret:6 large_ret:6 bond_ret:6 rate_ret:8 crude_ret:6 mkt_excess:6",
          factor_table, with_tables("""
SELECT * FROM (SELECT *, market / lag(market) OVER w - 1 AS market_ret, large / lag(large) OVER w - 1 AS large_ret, bond / lag(bond) OVER w - 1 AS bond_ret,
  rate / lag(rate) OVER w - 1 AS rate_ret, crude / lag(crude) OVER w - 1 AS crude_ret, (market / lag(market) OVER w) - (rate / lag(rate) OVER w) AS mkt_excess
FROM (SELECT factors.*, f.close AS crude FROM factors ASOF LEFT JOIN foreign_closes f ON f.day < factors.session) WINDOW w AS (ORDER BY session)) WHERE rate_ret IS NOT NULL""")),
    Query("calendar_returns", "D5 J5 N5", "symbol:s session:d close:6 ret:6", grid_returns, with_tables(
        "SELECT symbol, session, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY n) - 1 AS ret FROM grid")),
    Query("filled_closes", "W12 W6", "symbol:s session:d close:6 ffill:6 ffill1:6 history:i", filled_closes, with_tables("""
SELECT symbol, session, close, last_value(close IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  coalesce(close, CASE WHEN count(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 0 THEN lag(close) OVER w END) AS ffill1,
  count(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY n)""")),
    Query("rolling_windows", "W2 W3 W4 W5 W19 G8", "symbol:s session:d mean20:6 sd20:6 max20:6 min20:6 median20:3 shift:6 skip_ret:6 fwd_ret:6 cum_qty:2 peak:6 growth:5",
          rolling_stats, with_tables(ROLL_SQL)),
    Query("sessions_to_horizon", "X7 X8", "day:d orders:i sessions:i", weekday_sessions, with_tables("""
SELECT o.day, orders, greatest(h.sessions_so_far - c.sessions_so_far, 1) AS sessions
FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) o JOIN wk c ON c.day = o.day
JOIN wk h ON h.day = DATE '2001-12-21'""", wk=calendar_sql("1995-01-01", "2001-12-31"))),
    Query("expected_sessions", "X9", "event_id:i expected:d", expected, with_tables("""
SELECT event_id, last_session AS expected FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS local FROM events) e
JOIN wk ON wk.day = CASE WHEN hour(local) >= 19 THEN CAST(local AS DATE) ELSE CAST(local AS DATE) - 1 END""", wk=calendar_sql("2023-12-20", "2024-02-10"))),
    Query("index_staleness", "P6", "index_name:s last:d reference:d behind:i", staleness, with_tables("""
SELECT index_name, last, DATE '2001-11-30' AS reference, greatest(h.sessions_so_far - c.sessions_so_far, 0) AS behind
FROM (SELECT index_name, max(session) AS last FROM index_levels WHERE level IS NOT NULL AND session < DATE '2001-11-05' - CAST(length(index_name) * 7 AS INTEGER) GROUP BY 1) l
JOIN wk c ON c.day = l.last JOIN wk h ON h.day = DATE '2001-11-30'""", wk=calendar_sql("1995-01-01", "2001-12-31"))),
    Query("announcement_windows", "J8", "symbol:s event_date:d known:i until:i ear:5", announcement_windows, with_tables("""
SELECT symbol, event_date, known, least(known + 19, coalesce(lead(known) OVER (PARTITION BY symbol ORDER BY known) - 1, 2147483647)) AS until, ear FROM (
  SELECT symbol, known, arg_max(ear, event_date) AS ear, max(event_date) AS event_date FROM (
    SELECT e.symbol, e.event_date, e.pos + 1 AS known, (p1.close / p0.close - m1.bench / m0.bench) * 100 AS ear
    FROM (SELECT symbol, event_date, min(n) AS pos FROM ev JOIN cal ON cal.session >= ev.event_date GROUP BY 1, 2) e
    JOIN numbered p0 ON p0.symbol = e.symbol AND p0.n = e.pos - 1 JOIN numbered p1 ON p1.symbol = e.symbol AND p1.n = e.pos + 1
    JOIN bench m0 ON m0.session = p0.session JOIN bench m1 ON m1.session = p1.session) GROUP BY 1, 2)""",
        ev="SELECT DISTINCT 'SYM' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS symbol, CAST(l_shipdate AS DATE) AS event_date FROM lineitem WHERE l_linenumber = 4 AND l_quantity >= 46")),
    Query("appended_index_levels", "S14 J15 U2", "index_name:s session:d level:6 source:s", appended_levels, with_tables("""
SELECT *, 'stored' AS source FROM stored UNION ALL SELECT f.*, 'appended' FROM fetched f WHERE f.session NOT IN (SELECT session FROM stored s WHERE s.index_name = f.index_name)
AND f.index_name NOT IN (SELECT f2.index_name FROM fetched f2 JOIN stored s ON s.index_name = f2.index_name AND s.session = f2.session WHERE abs(f2.level - s.level) / s.level > 1e-4)""",
        stored="SELECT index_name, session, price AS level FROM index_levels WHERE price IS NOT NULL AND session < DATE '2001-06-04'",
        fetched="SELECT index_name, session, price * CASE WHEN index_name = 'ASIA' THEN 1.001 ELSE 1.0 END AS level FROM index_levels WHERE price IS NOT NULL AND session >= DATE '2001-05-14'")),
    Query("upserted_rates", "S15", "day:d o_orderkey:i rate:2", upserted_rates,
          "SELECT CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS rate FROM orders GROUP BY 1"),
    Query("latest_rates", "X11 X10", "customer:i rate_pct:7 fallback:b session_rate:9", latest_rates, f"""
SELECT customer, rate_pct, fallback, pow(1 + rate_pct / 100, 1 / 252.0) - 1 AS session_rate FROM (SELECT c_custkey AS customer, coalesce(y, {FALLBACK_YIELD}) AS rate_pct, y IS NULL AS fallback FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_totalprice / 100000, (o_orderdate, o_orderkey)) AS y FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' GROUP BY 1) ON o_custkey = c_custkey)"""),
    Query("recent_median_turnover", "S16", "symbol:s median_turnover:3 sessions:i", last_turnover, with_tables("""
SELECT symbol, quantile_cont(turnover, 0.5) AS median_turnover, count(*) AS sessions FROM numbered WHERE n > (SELECT max(n) FROM cal) - 30 GROUP BY 1""")),
    Query("latest_available_bars", "S12", "symbol:s session:d close:6", latest_chain, with_tables("""
SELECT symbol, session, close FROM bars WHERE session <= DATE '2000-02-29' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) = 1""")),
    Query("last_tick_per_day", "F5", "symbol:s day:d l_quantity:2 l_extendedprice:2", tick_dedup, """
SELECT 'SYM' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS symbol, CAST(l_shipdate AS DATE) AS day, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS l_quantity,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY 1, 2"""),
    Query("cleaned_numbers", "F6 F1", "orderkey:i value:2", cleaned_numbers,
          "SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders"),
    Query("turnover_quantiles", "G8 G9", "session:d p10:2 median:2 p80:2", monthly_quantiles, with_tables("""
SELECT session, quantile_cont(turnover, 0.1) AS p10, quantile_cont(turnover, 0.5) AS median, quantile_cont(turnover, 0.8) AS p80 FROM bars GROUP BY 1""")),
]
