"""Registered queries: technical indicators on weekly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from bartide.operators import indicators as ind
from bartide.operators.ranking import with_positions, with_ranks
from bartide.operators.rolling import latest, smoothed
from bartide.plans.catalog import Query
from bartide.plans.market_sql import offset_sql, spread_sql, with_tables
from bartide.session import cut_lineage
from bartide.sources import market as mk


def _bars(spark, folder):
    return mk.weekly_bars(spark, folder)


def _by_symbol(spark, folder):
    return mk.weekly_bars_by_symbol(spark, folder)


def _paired(spark, folder):
    bars = _bars(spark, folder)
    return ind.paired_sessions(bars, mk.benchmark(bars))


def price_bars(spark, folder):
    return _by_symbol(spark, folder)


def wilder(spark, folder):
    """Smoothing of a series with gaps: changes that are missing on every fifth session."""
    bars = _by_symbol(spark, folder)
    gappy = bars.select("symbol", "session", F.when(F.weekofyear("session") % 5 != 0, F.col("close")).alias("x"))
    return smoothed(gappy, {"y": "x"}, 14).where(F.col("y").isNotNull())


def ewm_range(spark, folder):
    bars = _by_symbol(spark, folder)
    ranged = bars.select("symbol", "session", ind.true_range("prev_close").alias("tr"))
    return smoothed(ranged, {"atr": "tr"}, 14, seed_rows=1, dense=True)


def osc(spark, folder):
    return ind.oscillators(_by_symbol(spark, folder))


def atr(spark, folder):
    return ind.average_true_range(_by_symbol(spark, folder))


def levels(spark, folder):
    return ind.support_resistance(_by_symbol(spark, folder))


def relative_strength(spark, folder):
    """Leaderboard of the 63-session spread over the benchmark."""
    return with_positions(ind.spreads(_paired(spark, folder), {"63": 63}), [], "rs_63", ["symbol"], "position")


def rs_offsets(spark, folder):
    return ind.spread_path(_paired(spark, folder), 63).where(F.col("d") < 15)


def rs_momentum(spark, folder):
    return ind.spread_momentum(ind.spread_path(_paired(spark, folder), 63))


def sector_strength(spark, folder):
    rows = ind.spreads(_paired(spark, folder), {"63": 63}).join(mk.listings(spark, folder).select("symbol", "sector"), "symbol")
    return with_ranks(ind.against_sector(rows, "ret_63"), ["sector"], "vs_sector", high="sector_rank")


def run_up(spark, folder):
    return ind.run_up(ind.spreads(_paired(spark, folder), {"10": 10, "63": 63}))


def summary(spark, folder):
    bars = cut_lineage(_bars(spark, folder))  # trend, ranges, levels and strength read them
    return ind.technical_summary(bars, mk.benchmark(bars), dealt=mk.by_symbol(spark, folder, bars))


def volatility(spark, folder):
    return ind.volatility(ind.session_returns(_bars(spark, folder)))


def stops_frame(spark, folder):
    """Stops at the latest close, trailed against the stops of the bars up to 13 sessions earlier."""
    bars = mk.by_symbol(spark, folder, cut_lineage(_bars(spark, folder)))

    def at(rows, tag):
        price = latest(rows).select("symbol", F.col("close").alias(f"price{tag}"))
        out = (price.join(ind.average_true_range(rows).withColumnRenamed("atr", f"atr{tag}"), "symbol")
               .join(ind.support_resistance(rows).select("symbol", F.col("support").alias(f"support{tag}")), "symbol", "left"))
        stop, method = ind.atr_stop(f"price{tag}", f"atr{tag}", f"support{tag}", multiple=1.5)
        return out.withColumns({f"stop{tag}": stop, f"method{tag}": method})

    earlier = bars.where(F.col("session") < F.lit("2001-08-06").cast("date"))
    both = at(bars, "").join(at(earlier, "_old").select("symbol", "stop_old"), "symbol", "left")
    stop, method = ind.trailed_stop("stop", "method", "stop_old", "price")
    return both.withColumns({"final_stop": stop, "final_method": method})


STOPS_SQL = {
    "old_bars": "SELECT * FROM bars WHERE session < DATE '2001-08-06'",
}


def _renamed(text: str, names: dict[str, str]) -> str:
    import re
    for old, new in names.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


def stops_sql() -> str:
    from bartide.plans.market_sql import CTES

    names = {n: f"{n}_old" for n in ("osc_in", "etr_in", "atr_rec", "last_atr", "levels")}
    extra = {f"{n}_old": _renamed(CTES[n], {**names, "bars": "old_bars"}) for n in names}

    def stop(levels, atr):
        base = "l.current_price - 1.5 * a.atr"
        near = f"(l.support >= {base} - a.atr AND l.support < {base})"
        stop = f"CASE WHEN {near} THEN l.support - 0.25 * a.atr ELSE {base} END"
        return f"""SELECT l.symbol, l.current_price AS price, a.atr, l.support, CASE WHEN a.atr > 0 AND {stop} > 0 THEN {stop} END AS stop,
          CASE WHEN a.atr IS NULL OR a.atr <= 0 OR {stop} <= 0 THEN 'unavailable' WHEN {near} THEN 'support' ELSE 'atr' END AS method
          FROM {levels} l JOIN {atr} a ON a.symbol = l.symbol"""

    return with_tables("""
SELECT n.symbol, n.price, n.atr, n.support, n.stop, n.method, o.stop AS stop_old,
  CASE WHEN o.stop IS NULL THEN n.stop WHEN o.stop >= n.price THEN o.stop WHEN n.stop IS NULL OR round_even(o.stop, 2) > round_even(n.stop, 2) THEN o.stop ELSE n.stop END AS final_stop,
  CASE WHEN o.stop IS NULL THEN n.method WHEN o.stop >= n.price THEN 'breached' WHEN n.stop IS NULL OR round_even(o.stop, 2) > round_even(n.stop, 2) THEN 'trailed' ELSE n.method END AS final_method
FROM stops_now n LEFT JOIN stops_old o ON o.symbol = n.symbol""",
                       **STOPS_SQL, **extra, stops_now=stop("levels", "last_atr"), stops_old=stop("levels_old", "last_atr_old"))


QUERIES = [
    Query("price_bars", "D1 S1 G1 W1 W7", "symbol:s session:d open:6 high:6 low:6 close:6 qty:2 turnover:2 trades:i prev_close:6",
          price_bars, with_tables("SELECT * FROM bars")),
    Query("wilder_smoothing", "T1", "symbol:s session:d x:6 y:6", wilder, with_tables(
        "SELECT s.symbol, s.session, s.x, r.y FROM series s JOIN rec r ON r.symbol = s.symbol AND r.rn = s.rn WHERE r.y IS NOT NULL",
        series="""SELECT symbol, session, CASE WHEN weekofyear(session) % 5 <> 0 THEN close END AS x, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn,
          count(*) OVER (PARTITION BY symbol) AS total FROM bars""",
        rec="""SELECT symbol, 14::BIGINT AS rn, avg(x) AS y FROM series WHERE rn <= 14 AND total >= 14 GROUP BY 1
          UNION ALL SELECT s.symbol, s.rn, CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE (r.y * 13 + s.x) / 14 END
          FROM rec r JOIN series s ON s.symbol = r.symbol AND s.rn = r.rn + 1""")),
    Query("exponential_range", "W18", "symbol:s session:d tr:6 atr:6", ewm_range, with_tables(
        "SELECT s.symbol, s.session, s.tr, r.y AS atr FROM series s JOIN rec r ON r.symbol = s.symbol AND r.rn = s.rn",
        series="""SELECT symbol, session, greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0)) AS tr,
          row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn FROM bars""",
        rec="""SELECT symbol, rn, tr AS y FROM series WHERE rn = 1
          UNION ALL SELECT s.symbol, s.rn, (r.y * 13 + s.tr) / 14 FROM rec r JOIN series s ON s.symbol = r.symbol AND s.rn = r.rn + 1""")),
    Query("strength_index", "T2", "symbol:s session:d rsi:6", osc, with_tables("SELECT symbol, session, rsi FROM tech")),
    Query("directional_index", "T3 T14", "symbol:s session:d plus_di:6 minus_di:6 dx:6 adx:6 trend:s", osc, with_tables("SELECT * FROM tech")),
    Query("average_true_range", "T4", "symbol:s atr:6", atr, with_tables("SELECT * FROM last_atr")),
    Query("support_resistance", "T5 W4", "symbol:s current_price:6 support:2 resistance:2 sessions:i", levels,
          with_tables("SELECT symbol, current_price, support, resistance, total AS sessions FROM levels")),
    Query("relative_strength", "T6 J1 W10 U3", "symbol:s rs_63:2 ret_63:2 bench_63:2 position:i", relative_strength, with_tables(
        "SELECT symbol, rs AS rs_63, ret AS ret_63, bench_ret AS bench_63, row_number() OVER (ORDER BY rs DESC, symbol) AS position FROM spread63",
        spread63=spread_sql(63))),
    Query("relative_strength_offsets", "T7 W2 J2", "symbol:s d:i rs:2 ret:2", rs_offsets,
          with_tables("SELECT * FROM path63 WHERE d < 15", path63=offset_sql(63))),
    Query("relative_strength_momentum", "T8", "symbol:s rs_now:2 rs_prev:2 rs_momentum:2", rs_momentum, with_tables("""
SELECT symbol, CASE WHEN k = 10 THEN now END AS rs_now, CASE WHEN k = 10 THEN round_even(prev, 2) END AS rs_prev,
  CASE WHEN k = 10 THEN round_even(late - prev, 2) END AS rs_momentum FROM (SELECT symbol, max(CASE WHEN d = 0 THEN rs END) AS now,
  avg(CASE WHEN d < 5 THEN rs END) AS late, avg(CASE WHEN d BETWEEN 10 AND 14 THEN rs END) AS prev,
  count(CASE WHEN d < 5 OR d BETWEEN 10 AND 14 THEN rs END) AS k FROM path63 GROUP BY 1)""", path63=offset_sql(63))),
    Query("sector_relative_strength", "T9 W8 J3", "symbol:s sector:s ret_63:2 sector_avg:6 vs_sector:6 sector_rank:i", sector_strength, with_tables("""
SELECT *, rank() OVER (PARTITION BY sector ORDER BY vs_sector DESC) AS sector_rank FROM (
  SELECT s.symbol, sector, ret AS ret_63, avg(ret) OVER (PARTITION BY sector) AS sector_avg, ret - avg(ret) OVER (PARTITION BY sector) AS vs_sector
  FROM spread63 s JOIN listed USING (symbol))""", spread63=spread_sql(63))),
    Query("recent_run_up", "T10", "symbol:s rs_10:2 rs_63:2 recent_share:1", run_up, with_tables("""
SELECT a.symbol, a.rs AS rs_10, b.rs AS rs_63, CASE WHEN b.rs > 0 THEN round_even(a.rs / b.rs * 100, 1) END AS recent_share
FROM spread10 a JOIN spread63 b ON a.symbol = b.symbol""", spread10=spread_sql(10), spread63=spread_sql(63))),
    Query("technical_summary", "T11 J3", "symbol:s current_price:2 rsi:2 adx:2 plus_di:2 minus_di:2 trend:s rs_63:2 support:2 resistance:2 sessions:i",
          summary, with_tables("""
SELECT t.symbol, round_even(t.close, 2) AS current_price, round_even(rsi, 2) AS rsi, round_even(adx, 2) AS adx, round_even(plus_di, 2) AS plus_di,
  round_even(minus_di, 2) AS minus_di, trend, rs AS rs_63, support, resistance, t.total AS sessions
FROM tech t LEFT JOIN spread63 s ON s.symbol = t.symbol LEFT JOIN levels l ON l.symbol = t.symbol WHERE t.rn = t.total AND t.total >= 5
UNION ALL SELECT symbol, NULL, NULL, NULL, NULL, NULL, 'N/A (Insufficient Data)', NULL, NULL, NULL, total FROM tech WHERE rn = total AND total < 5""",
                               spread63=spread_sql(63))),
    Query("return_volatility", "T12 G5 X10", "symbol:s observations:i session_vol:8 annual_vol:6 annual_mean:6", volatility, with_tables("""
SELECT symbol, count(*) AS observations, stddev_samp(ret) AS session_vol, stddev_samp(ret) * sqrt(252.0) AS annual_vol, avg(ret) * 252 AS annual_mean
FROM (SELECT symbol, close / prev_close - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars WHERE prev_close > 0)
WHERE k <= 252 GROUP BY 1""")),
    Query("stop_levels", "T13", "symbol:s price:4 atr:6 support:2 stop:6 method:s stop_old:6 final_stop:6 final_method:s", stops_frame, stops_sql()),
]
