"""Registered queries: cross-sectional signal studies on weekly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.operators import backtests as bt
from bartide.operators import indicators as ind
from bartide.operators import prep
from bartide.operators import rolling as rl
from bartide.operators.ranking import top_rows
from bartide.plans import prices
from bartide.operators.ranking import quantiles
from bartide.plans.catalog import Query
from bartide.plans.indicators import _renamed
from bartide.plans.market_sql import CTES, define, with_tables
from bartide.plans.prices import CHAIN_SQL
from bartide.session import cut_as_dealt, cut_lineage
from bartide.sources import market as mk

WINDOWS = (21, 63, 126, 189, 252)
WARMUP, EVERY, HORIZON = 126, 13, 26  # weekly sessions
SPLIT_DAY, TOP, POOL = "1999-06-30", 8, 16
GAP_FLOOR, MIN_HISTORY, CAP_FLOOR, TURNOVER_FLOOR = 2.0, 100, 300.0, 4000.0
SKIP, SHORT, LONG = 4, 26, 52
STOP_MULTIPLE = 3.0
SIGNALS = [*[f"rs_{w}" for w in WINDOWS], "rs_skip", "high_52w", "vol_63", "rs_126_per_vol", "above_ma200", "deliv_trend", "turnover_trend",
           "sector_rs_126", "rs_126_vs_sector", "composite", "adx", "di_gap", "rsi", "dist_high"]
FLAGS = ["burst", "strong_trend", "overbought", "near_high"]
QUOTA, PILLARS = [("AFRICA", 1), ("ASIA", 1)], [("AFRICA", 3), ("ASIA", 3), ("EUROPE", 2)]
BANDS = [150.0, 290.0, 300.0, 310.0, 320.0, 330.0, 340.0]


def panel_of(spark, folder, jump_limit=None):
    """(panel, calendar, bench): bars and panel are stored as dealt by symbol, so that no branch that reads them exchanges them again. What a session
    has but once, its day and benchmark, is not stored with every row."""
    bars = cut_as_dealt(mk.panel_bars(spark, folder))
    bench = cut_lineage(mk.benchmark(bars))
    calendar = cut_lineage(mk.numbered_calendar(bench))
    panel = cut_as_dealt(bt.price_panel(mk.with_previous(bars), calendar, bench, jump_limit).drop("session", "bench"))
    return panel.join(F.broadcast(calendar), "n").join(F.broadcast(bench), "session"), calendar, bench


def sectors(spark, folder):
    return mk.listings(spark, folder).select("symbol", "sector")


def on_dates(rows, calendar, warmup=WARMUP):
    total = calendar.agg(F.max("n").alias("_total"))  # one row
    return rows.join(total).where(bt.is_rebalance(warmup, EVERY, HORIZON, "_total")).drop("_total")


def with_period(rows):
    return rows.withColumn("period", F.when(F.col("session") <= F.lit(SPLIT_DAY).cast("date"), "in sample").otherwise("out of sample"))


def onto_dates(rows, calendar, reach, skip=0):
    return bt.onto_dates(rows, calendar, reach, WARMUP, EVERY, HORIZON, skip)


def signal_panel(spark, folder):
    panel, calendar, _ = panel_of(spark, folder)
    daily = panel.withColumn("daily", F.col("close") / rl.back("close", 1, order="n") - 1).select("symbol", "n", "close", "high", "deliv", "turnover", "daily")
    rolled = bt.rolled_on_dates(onto_dates(daily, calendar, 252))
    rows = bt.momentum_signals(on_dates(bt.momentum_moves(panel, WINDOWS, HORIZON), calendar), rolled).join(sectors(spark, folder), "symbol")
    rows = rows.join(bt.trend_columns(panel), ["symbol", "n"], "left")
    scored = bt.with_composite(bt.with_sector_spread(cut_lineage(rows)))
    return bt.with_flags(scored.where(F.col("fwd_rs").isNotNull() & F.col("rs_126").isNotNull()), SPLIT_DAY)


def stored_signals(spark, folder):
    return cut_lineage(bt.with_repeats(signal_panel(spark, folder)))


def date_scores(spark, folder):
    return bt.date_scores(bt.tall_signals(stored_signals(spark, folder), SIGNALS), TOP)


def scorecard(spark, folder):
    return bt.scorecard(cut_lineage(date_scores(spark, folder)))


def conditional(spark, folder):
    return bt.conditional_effect(stored_signals(spark, folder), FLAGS)


def current_rule(spark, folder):
    return bt.rule_against_universe(stored_signals(spark, folder), (F.col("rs_63") > 2) & (F.col("di_gap") > 0))


def reliability(spark, folder):
    panel = stored_signals(spark, folder)
    card = cut_lineage(bt.scorecard(cut_lineage(bt.date_scores(bt.tall_signals(panel, SIGNALS), TOP))))
    return bt.reliability(card, panel)


def rotation_panel(spark, folder):
    panel, calendar, _ = panel_of(spark, folder)
    rows = on_dates(bt.rotation_signals(panel, sectors(spark, folder), HORIZON), calendar)
    rows = rows.join(bt.trend_columns(panel).select("symbol", "n", "di_gap"), ["symbol", "n"])
    known = rows.dropna(subset=["rs_skip", "fwd_rs", "di_gap", "x_n", "y_n", "x_s", "y_s"])
    return with_period(bt.with_conviction(known))


def eligible_rotation(spark, folder):
    return cut_lineage(bt.eligible_rows(rotation_panel(spark, folder), GAP_FLOOR, MIN_HISTORY))


def conviction_picks(spark, folder):
    rows = eligible_rotation(spark, folder)
    strong = rows.where(F.col("conviction").isin("High", "Moderate"))
    return (bt.best_of(strong, "A conviction", TOP).unionByName(bt.best_of(rows, "B no filter", TOP))
            .unionByName(bt.best_of(rows.where(F.col("x_n") > 0), "C strength above 0", TOP)))


def conviction_outcomes(spark, folder):
    return bt.outcome_table(bt.per_date(conviction_picks(spark, folder)))


def conviction_differences(spark, folder):
    return bt.paired_differences(cut_lineage(bt.per_date(conviction_picks(spark, folder))), "B no filter", two_sided=True)


def conviction_changes(spark, folder):
    return bt.changed_dates(conviction_picks(spark, folder), "A conviction", "B no filter")


def announcement_rows(spark, folder):
    """Rebalance rows with the latest announcement return that is still active."""
    panel, calendar, _ = panel_of(spark, folder)
    windows = prep.event_windows(prices.events_of(spark, folder), panel.where(F.col("close").isNotNull()).select("symbol", "session", "close"),
                                 panel.select("session", "bench").distinct(), calendar, active=30)
    rows = panel.withColumns({"rs_skip": bt.spread_over(105, 21), "fwd_rs": bt.forward_spread(HORIZON)})
    rows = with_period(on_dates(rows, calendar)).select("symbol", "n", "session", "period", "rs_skip", "fwd_rs", "history")
    rows = rows.join(bt.trend_columns(panel).select("symbol", "n", "di_gap"), ["symbol", "n"]).dropna(subset=["rs_skip", "fwd_rs", "di_gap"])
    known = windows.select("symbol", "known", F.struct("ear", "until").alias("w"))
    found = prep.as_of(rows, known, "n", "known", "w", ["symbol"], strict=False)
    found = found.withColumn("ear", F.when(F.col("n") <= F.col("w_asof.until"), F.col("w_asof.ear"))).drop("w_asof")
    return bt.eligible_rows(found, GAP_FLOOR, MIN_HISTORY)


def announcement_picks(spark, folder):
    rows = cut_lineage(announcement_rows(spark, folder))
    pool = top_rows(rows, ["n"], POOL, F.desc("rs_skip"), F.col("symbol"))
    kind = rows.where(~F.coalesce(F.col("ear") < 0, F.lit(False)))
    return (bt.best_of(rows, "B baseline", TOP).unionByName(bt.best_of(rows, "E1 announcement alone", TOP, "ear"))
            .unionByName(bt.best_of(pool, "E2 pool then announcement", TOP, "ear")).unionByName(bt.best_of(kind, "E3 no negative announcement", TOP)))


def announcement_outcomes(spark, folder):
    return bt.outcome_table(bt.per_date(announcement_picks(spark, folder)))


def announcement_differences(spark, folder):
    return bt.paired_differences(cut_lineage(bt.per_date(announcement_picks(spark, folder))), "B baseline")


def quota_picks(spark, folder):
    rows = eligible_rotation(spark, folder)

    def table(values):
        return spark.createDataFrame(values, "sector string, minimum int")
    return (bt.quota_picks(rows, "B no quotas", TOP, None).unionByName(bt.quota_picks(rows, "Q one each", TOP, table(QUOTA)))
            .unionByName(bt.quota_picks(rows, "P pillars", TOP, table(PILLARS))))


def quota_outcomes(spark, folder):
    return bt.outcome_table(bt.per_date(quota_picks(spark, folder)))


def quota_differences(spark, folder):
    return bt.paired_differences(cut_lineage(bt.per_date(quota_picks(spark, folder))), "B no quotas")


def market_moments(bench, calendar):
    days = bench.join(calendar, "session").select("n", "bench")
    order = Window.orderBy("n")  # a calendar
    moved = days.withColumn("m", F.col("bench") / F.lag("bench").over(order) - 1)
    window = order.rowsBetween(-(LONG - 1) - SKIP, -SKIP)
    return moved.select("n", "m", F.avg("m").over(window).alias("m_mean"), F.var_samp("m").over(window).alias("m_var"))


def extension_rows(spark, folder):
    panel, calendar, bench = panel_of(spark, folder)
    returns = panel.withColumn("r", F.col("close") / rl.back("close", 1, order="n") - 1).select("symbol", "n", "r")
    moves = on_dates(panel.withColumns({"rs_skip": bt.spread_over(SHORT - SKIP, SKIP), "fwd_rs": bt.forward_spread(HORIZON)}), calendar)
    rows = bt.residual_momentum(moves, onto_dates(returns, calendar, LONG, SKIP), market_moments(bench, calendar), SKIP, SHORT, LONG)
    rows = with_period(rows).join(bt.trend_columns(panel).select("symbol", "n", "di_gap"), ["symbol", "n"])
    known = rows.dropna(subset=["rs_skip", "resid_mom", "pan", "fwd_rs", "di_gap"])
    return bt.eligible_rows(known, GAP_FLOOR, MIN_HISTORY)


def extension_differences(spark, folder):
    rows = cut_lineage(extension_rows(spark, folder))
    pool = top_rows(rows, ["n"], POOL, F.desc("rs_skip"), F.col("symbol"))
    picks = (bt.best_of(rows, "B baseline", TOP).unionByName(bt.best_of(rows, "R residual momentum", TOP, "resid_mom"))
             .unionByName(bt.best_of(pool, "F frog in the pan", TOP, "pan", ascending=True)))
    return bt.paired_differences(cut_lineage(bt.per_date(picks)), "B baseline")


def universe_rows(spark, folder, panel):
    """Jump-suppressed panel with market value as known at each session and its true range."""
    whole = rl.by_symbol(order="n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = mk.fundamentals(spark, folder).select("symbol", "market_cap")
    rows = panel.join(caps, "symbol").withColumns({
        "cap_then": F.col("market_cap") * F.col("close") / F.last("close", ignorenulls=True).over(whole),
        "rs_skip": bt.spread_over(105, 21), "fwd_rs": bt.forward_spread(HORIZON),
        "tr": F.when(F.col("high").isNotNull(), ind.true_range(rl.back("close", 1, order="n")))})
    return bt.decayed_mean(rows, "atr", "tr", 1 / 14, 14)


def universe_dates(spark, folder, panel, calendar):
    """The universe on the rebalance dates, with the median turnover and trend of each."""
    median = bt.median_on_dates(panel.select("symbol", "n", "turnover"), on_dates(calendar, calendar), "turnover", 63, 40).withColumnRenamed("median", "median_turnover")
    rows = with_period(on_dates(universe_rows(spark, folder, panel), calendar)).join(median, ["symbol", "n"])
    return rows.join(bt.trend_columns(panel).select("symbol", "n", "di_gap"), ["symbol", "n"], "left")


def wide_range(spark, folder):
    return universe_rows(spark, folder, panel_of(spark, folder, 0.35)[0]).where(F.col("atr").isNotNull())


def stop_rule_paths(spark, folder):
    panel, calendar, bench = panel_of(spark, folder, 0.35)
    fit = universe_dates(spark, folder, panel, calendar).dropna(subset=["rs_skip", "di_gap", "cap_then", "median_turnover", "atr", "close"])
    fit = bt.eligible_rows(fit, GAP_FLOOR, MIN_HISTORY).where((F.col("cap_then") >= CAP_FLOOR) & (F.col("median_turnover") >= TURNOVER_FLOOR))
    fit = cut_lineage(fit.select("symbol", "n", "period", "rs_skip", "close", "atr"))
    sizes = fit.groupBy("n").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= TOP).select("n")
    picks = cut_lineage(top_rows(fit.join(sizes, "n", "left_semi"), ["n"], TOP, F.desc("rs_skip"), F.col("symbol")))
    # only what was picked, a handful a date, is followed: its whole history, as the range looks back
    picked = F.broadcast(picks.select("symbol").distinct())
    followed = bt.price_panel(mk.with_previous(cut_as_dealt(mk.panel_bars(spark, folder)).join(picked, "symbol", "left_semi")), calendar, bench, 0.35)
    path = cut_lineage(universe_rows(spark, folder, followed).select("symbol", "n", "close", "atr"))
    runs = [("S stop", True, None), ("S fixed stop", False, None), ("S stop and target", True, 1.0)]
    out = None
    for name, trail, target in runs:
        one = bt.stop_outcomes(picks, path, HORIZON, STOP_MULTIPLE, trail, target).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.join(picks.select("n", "symbol", "period"), ["n", "symbol"]), bench.join(calendar, "session")


def stop_outcomes(spark, folder):
    """Spread of every rule's quarter over the market, holding included."""
    slots, days = stop_rule_paths(spark, folder)
    slots = cut_lineage(slots)
    market = days.withColumn("mkt", F.lead("bench", HORIZON).over(Window.orderBy("n")) / F.col("bench") - 1)
    hold = slots.where(F.col("rule") == "S stop").select(F.lit("H hold").alias("rule"), "n", "period", F.col("held").alias("v"), F.lit(0).alias("out"))
    both = slots.select("rule", "n", "period", F.col("stopped").alias("v"), F.col("exited").cast("int").alias("out")).unionByName(hold)
    return (both.groupBy("rule", "n", "period").agg(F.avg("v").alias("value"), F.sum("out").alias("exits")).join(market.select("n", "mkt"), "n")
            .withColumn("outcome", (F.col("value") - 1 - F.col("mkt")) * 100))


def stop_differences(spark, folder):
    return bt.paired_differences(cut_lineage(stop_outcomes(spark, folder)).select("rule", "n", "period", "outcome"), "H hold")


def universe_comparison(spark, folder):
    panel, calendar, _ = panel_of(spark, folder, 0.35)
    dated = universe_dates(spark, folder, panel, calendar).dropna(subset=["rs_skip", "fwd_rs", "di_gap"])
    fit = bt.eligible_rows(dated, GAP_FLOOR, MIN_HISTORY).join(sectors(spark, folder), "symbol")
    today = F.when((F.col("market_cap") >= CAP_FLOOR) & (F.col("sector") != "EUROPE"), F.lit("today"))
    then = F.when((F.col("cap_then") >= CAP_FLOOR) & (F.col("median_turnover") >= TURNOVER_FLOOR), F.lit("point in time"))
    tagged = cut_lineage(fit.select("symbol", "n", "period", "rs_skip", "fwd_rs", F.explode(F.array_compact(F.array(today, then))).alias("universe")))
    return bt.universe_scores(tagged, TOP)


def liquidity_rows(spark, folder):
    caps = mk.fundamentals(spark, folder).select("symbol", "market_cap").where(F.col("market_cap") >= BANDS[0])
    return caps.join(prices.last_turnover(spark, folder), "symbol")


def liquidity_bands(spark, folder):
    rows = bt.banded(liquidity_rows(spark, folder), "market_cap", BANDS)
    shares = rows.groupBy("band").agg(F.count(F.lit(1)).alias("stocks"), F.avg((F.col("median_turnover") >= 6000).cast("double")).alias("share_liquid"))
    return shares.join(quantiles(rows, ["band"], "median_turnover", {"median_turnover": 0.5}), "band", "left")


def liquidity_correlation(spark, folder):
    rows = cut_lineage(liquidity_rows(spark, folder)).withColumn("all", F.lit(1))
    return bt.rank_correlation(rows, ["all"], "market_cap", "median_turnover")


# ---- the same in SQL ----
define("chain0", CHAIN_SQL.format(rule="", source="bars"))
define("chain35", CHAIN_SQL.format(rule="WHEN abs(close / prev_close - 1) > 0.35 THEN 0.0", source="bars"))


def _panel_sql(chain: str, tag: str) -> None:
    fill = ", ".join(f"coalesce({c}, CASE WHEN count({c}) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 0 THEN lag({c}) OVER w END) AS {o}"
                     for c, o in (("adj_close", "close"), ("adj_high", "high"), ("adj_low", "low"), ("dl", "deliv"), ("turnover", "turnover")))
    define(f"panel{tag}", f"""
SELECT p.*, b.bench, count(close) OVER (PARTITION BY symbol ORDER BY n) AS history FROM (SELECT symbol, n, session, {fill} FROM (
SELECT g.symbol, g.n, g.session, c.adj_close, c.adj_high, c.adj_low, g.deliv_qty / g.qty * 100 AS dl, g.turnover FROM grid g LEFT JOIN {chain} c ON c.symbol = g.symbol AND c.session = g.session)
WINDOW w AS (PARTITION BY symbol ORDER BY n)) p JOIN bench b ON b.session = p.session""")
    define(f"panel_bars{tag}", f"SELECT symbol, n AS session, high, low, close, lag(close) OVER (PARTITION BY symbol ORDER BY n) AS prev_close FROM panel{tag} WHERE close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL")
    names = {n: f"{n}_p{tag}" for n in ("osc_in", "osc", "dmi_in", "adx_rec", "tech")}
    for name in names:
        define(f"{name}_p{tag}", _renamed(CTES[name], {**names, "bars": f"panel_bars{tag}"}))
    define(f"trend{tag}", f"SELECT symbol, session AS n, adx, plus_di - minus_di AS di_gap, rsi FROM tech_p{tag} WHERE total >= 40")


_panel_sql("chain0", "")
_panel_sql("chain35", "35")


def rs_sql(rows: int, skip: int = 0) -> str:
    def ratio(c):
        return f"(lag({c}, {skip}) OVER w / lag({c}, {skip + rows}) OVER w - 1)"
    return f"({ratio('close')} - {ratio('bench')}) * 100"


FWD_SQL = f"((lead(close, {HORIZON}) OVER w / close - 1) - (lead(bench, {HORIZON}) OVER w / bench - 1)) * 100"
REBALANCE_SQL = f"n > {WARMUP} AND (n - 1 - {WARMUP}) % {EVERY} = 0 AND n - 1 + {HORIZON} < (SELECT max(n) FROM cal)"
PERIOD_SQL = f"CASE WHEN session <= DATE '{SPLIT_DAY}' THEN 'in sample' ELSE 'out of sample' END AS period"


def roll_sql(c: str, how: str, rows: int, least: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY n ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) OVER {frame} >= {least} THEN {how}({c}) OVER {frame} END)"


define("sig_rows", f"""
SELECT *, CASE WHEN rs_63 > 0 THEN rs_10 / rs_63 * 100 END AS burst_share, round((close / {roll_sql('high', 'max', 20, 15)} - 1) * 100, 9) AS dist_high, close / {roll_sql('high', 'max', 252, 200)} AS high_52w,
  {roll_sql('daily', 'stddev_samp', 63, 50)} * sqrt(252.0) * 100 AS vol_63, rs_126 / {roll_sql('daily', 'stddev_samp', 126, 100)} AS rs_126_per_vol, (close / {roll_sql('close', 'avg', 200, 180)} - 1) * 100 AS above_ma200,
  {roll_sql('deliv', 'avg', 21, 15)} - {roll_sql('deliv', 'avg', 126, 100)} AS deliv_trend, {roll_sql('turnover', 'avg', 21, 15)} / {roll_sql('turnover', 'avg', 126, 100)} AS turnover_trend
FROM (SELECT *, {', '.join(f'{rs_sql(w)} AS rs_{w}' for w in WINDOWS)}, {rs_sql(10)} AS rs_10, {rs_sql(105, 21)} AS rs_skip, {FWD_SQL} AS fwd_rs, close / lag(close, 126) OVER w - 1 AS ret126,
  bench / lag(bench, 126) OVER w - 1 AS bench126, close / lag(close) OVER w - 1 AS daily FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY n))""")
define("sig_dates", f"""
SELECT s.*, l.sector, t.adx, t.di_gap, t.rsi, avg(ret126) OVER (PARTITION BY l.sector, s.n) AS smean FROM (SELECT * FROM sig_rows WHERE {REBALANCE_SQL}) s JOIN listed l ON l.symbol = s.symbol LEFT JOIN trend t ON t.symbol = s.symbol AND t.n = s.n""")


def pct_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY n ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY n, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY n) END"


define("signals", f"""
SELECT *, {PERIOD_SQL}, coalesce(burst_share > 50, false) AS burst, coalesce(adx > 25 AND di_gap > 0, false) AS strong_trend, coalesce(rsi > 70, false) AS overbought, coalesce(dist_high >= -2, false) AS near_high FROM (
SELECT *, (smean - bench126) * 100 AS sector_rs_126, (ret126 - smean) * 100 AS rs_126_vs_sector, ({pct_sql('rs_126')} + {pct_sql('high_52w')}) / 2 AS composite FROM sig_dates) WHERE fwd_rs IS NOT NULL AND rs_126 IS NOT NULL""")
define("tall_signals", " UNION ALL ".join(f"SELECT '{s}' AS signal, n, period, symbol, fwd_rs, CAST({s} AS DOUBLE) AS value FROM signals WHERE {s} IS NOT NULL" for s in SIGNALS))


def avg_rank_sql(c: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"


define("scored", """
SELECT signal, n, period, corr(ra, rb) AS ic, count(*) AS names, avg(fwd_rs) FILTER (value >= q80) - avg(fwd_rs) AS spread, avg(fwd_rs) FILTER (hi <= 8) > 0 AS best_beats, avg(fwd_rs) FILTER (lo <= 8) > 0 AS worst_beats FROM (
SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY signal, n) AS q80, row_number() OVER (PARTITION BY signal, n ORDER BY value DESC, symbol) AS hi, row_number() OVER (PARTITION BY signal, n ORDER BY value, symbol) AS lo,
  """ + avg_rank_sql("value", "signal, n") + " AS ra, " + avg_rank_sql("fwd_rs", "signal, n") + """ AS rb FROM tall_signals) GROUP BY 1, 2, 3 HAVING count(*) >= 25""")
define("scored_labels", "SELECT 'all' AS label, * FROM scored UNION ALL SELECT period, * FROM scored")
define("card", """
SELECT s.*, t.t FROM (SELECT label, signal, count(*) AS dates, avg(ic) AS mean_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) * 100 AS ic_positive_pct, avg(spread) AS top_fifth_pp, avg(CASE WHEN best_beats THEN 1.0 ELSE 0.0 END) * 100 AS best_beat_pct,
  avg(CASE WHEN worst_beats THEN 1.0 ELSE 0.0 END) * 100 AS worst_beat_pct FROM scored_labels GROUP BY 1, 2) s LEFT JOIN (SELECT label, signal, CASE WHEN count(*) > 2 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(*)) END AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY label, signal ORDER BY n) AS p FROM scored_labels WHERE ic IS NOT NULL) WHERE (p - 1) % 3 = 0 GROUP BY 1, 2) t ON t.label = s.label AND t.signal = s.signal""")
define("rot_base", """
SELECT p.*, l.sector, close / lag(close, 63) OVER w - 1 AS ret63, bench / lag(bench, 63) OVER w - 1 AS mkt63 FROM panel p JOIN listed l ON l.symbol = p.symbol WINDOW w AS (PARTITION BY p.symbol ORDER BY n)""")
_SHIFT = "CASE WHEN count({0}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND count({0}) OVER (w ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING) = 5 THEN avg({0}) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg({0}) OVER (w ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING) END"
define("rot_rows", f"""
SELECT *, {_SHIFT.format('x_n')} AS y_n, {_SHIFT.format('x_s')} AS y_s, {rs_sql(105, 21)} AS rs_skip, {FWD_SQL} AS fwd_rs FROM (
SELECT *, (ret63 - mkt63) * 100 AS x_n, (ret63 - avg(ret63) OVER (PARTITION BY sector, n)) * 100 AS x_s FROM rot_base) WINDOW w AS (PARTITION BY symbol ORDER BY n)""")


def _quadrant(s: str, m: str) -> str:
    return f"CASE WHEN {s} > 0 THEN CASE WHEN {m} > 0 THEN 'LEADING' ELSE 'WEAKENING' END WHEN {m} > 0 THEN 'IMPROVING' ELSE 'LAGGING' END"


define("rotation", f"""
SELECT *, CASE WHEN q1 = 'LEADING' AND q2 = 'LEADING' THEN 'High' WHEN q1 IN ('LEADING', 'IMPROVING') OR q2 IN ('LEADING', 'IMPROVING') THEN 'Moderate' ELSE 'Low' END AS conviction FROM (
SELECT r.symbol, r.sector, r.n, r.session, r.history, r.rs_skip, r.fwd_rs, r.x_n, r.y_n, r.x_s, r.y_s, t.di_gap, {PERIOD_SQL}, {_quadrant('x_n', 'y_n')} AS q1, {_quadrant('x_s', 'y_s')} AS q2
FROM (SELECT * FROM rot_rows WHERE {REBALANCE_SQL}) r JOIN trend t ON t.symbol = r.symbol AND t.n = r.n
WHERE rs_skip IS NOT NULL AND fwd_rs IS NOT NULL AND di_gap IS NOT NULL AND x_n IS NOT NULL AND y_n IS NOT NULL AND x_s IS NOT NULL AND y_s IS NOT NULL)""")
define("rot_fit", f"SELECT * FROM rotation WHERE di_gap >= {GAP_FLOOR} AND history >= {MIN_HISTORY}")


def top_sql(rule: str, source: str, order: str, size: int = TOP) -> str:
    return f"SELECT '{rule}' AS rule, n, period, symbol, fwd_rs FROM ({source}) QUALIFY row_number() OVER (PARTITION BY n ORDER BY {order}, symbol) <= {size}"


define("conv_picks", " UNION ALL ".join([
    top_sql("A conviction", "SELECT * FROM rot_fit WHERE conviction IN ('High', 'Moderate')", "rs_skip DESC"), top_sql("B no filter", "SELECT * FROM rot_fit", "rs_skip DESC"),
    top_sql("C strength above 0", "SELECT * FROM rot_fit WHERE x_n > 0", "rs_skip DESC")]))


def per_date_sql(picks: str) -> str:
    return f"SELECT rule, n, period, avg(fwd_rs) AS outcome FROM {picks} GROUP BY 1, 2, 3"


def outcome_sql(dates: str) -> str:
    return f"""SELECT label, rule, count(*) AS dates, avg(outcome) AS mean_pp, avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END) * 100 AS beat_pct, stddev_samp(outcome) AS sd_pp, min(outcome) AS worst_pp FROM (
SELECT 'all' AS label, * FROM ({dates}) UNION ALL SELECT period, * FROM ({dates})) GROUP BY 1, 2"""


def diff_sql(dates: str, base: str, two_sided: bool = False) -> str:
    strength = "abs(t)" if two_sided else "t"
    rows = f"SELECT r.rule, r.n, r.period, r.outcome - b.outcome AS diff FROM ({dates}) r JOIN ({dates}) b ON b.n = r.n AND b.rule = '{base}' WHERE r.rule <> '{base}'"
    return f"""SELECT m.rule, m.diff_in, m.diff_out, t.t, coalesce(m.up AND {strength} >= 2, false) AS adopt FROM (SELECT rule, max(d) FILTER (period = 'in sample') AS diff_in, max(d) FILTER (period = 'out of sample') AS diff_out, bool_and(d > 0) AS up
  FROM (SELECT rule, period, avg(diff) AS d FROM ({rows}) GROUP BY 1, 2) GROUP BY 1) m LEFT JOIN (SELECT rule, CASE WHEN count(*) > 2 AND stddev_samp(diff) > 0 THEN avg(diff) / stddev_samp(diff) * sqrt(count(*)) END AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n) AS p FROM ({rows}) WHERE diff IS NOT NULL) WHERE (p - 1) % 3 = 0 GROUP BY 1) t ON t.rule = m.rule"""


define("ev", "SELECT DISTINCT 'SYM' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS symbol, CAST(l_shipdate AS DATE) AS event_date FROM lineitem WHERE l_linenumber = 4 AND l_quantity >= 46")
define("ev_win", """
SELECT symbol, known, least(known + 29, coalesce(lead(known) OVER (PARTITION BY symbol ORDER BY known) - 1, 2147483647)) AS until, ear FROM (
  SELECT symbol, known, arg_max(ear, event_date) AS ear FROM (SELECT e.symbol, e.event_date, e.pos + 1 AS known, (p1.close / p0.close - p1.bench / p0.bench) * 100 AS ear
    FROM (SELECT symbol, event_date, min(n) AS pos FROM ev JOIN cal ON cal.session >= ev.event_date GROUP BY 1, 2) e JOIN panel p0 ON p0.symbol = e.symbol AND p0.n = e.pos - 1 JOIN panel p1 ON p1.symbol = e.symbol AND p1.n = e.pos + 1
    WHERE p0.close IS NOT NULL AND p1.close IS NOT NULL) GROUP BY 1, 2)""")
define("ear_rows", f"""
SELECT r.symbol, r.n, r.session, r.history, r.rs_skip, r.fwd_rs, t.di_gap, {PERIOD_SQL}, w.ear FROM (SELECT * FROM (SELECT *, {rs_sql(105, 21)} AS rs_skip, {FWD_SQL} AS fwd_rs FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY n)) WHERE {REBALANCE_SQL}) r
JOIN trend t ON t.symbol = r.symbol AND t.n = r.n LEFT JOIN ev_win w ON w.symbol = r.symbol AND r.n BETWEEN w.known AND w.until
WHERE rs_skip IS NOT NULL AND fwd_rs IS NOT NULL AND t.di_gap >= {GAP_FLOOR} AND history >= {MIN_HISTORY}""")
define("ear_picks", " UNION ALL ".join([
    top_sql("B baseline", "SELECT * FROM ear_rows", "rs_skip DESC"), top_sql("E1 announcement alone", "SELECT * FROM ear_rows WHERE ear IS NOT NULL", "ear DESC"),
    top_sql("E2 pool then announcement", f"SELECT * FROM (SELECT * FROM ear_rows QUALIFY row_number() OVER (PARTITION BY n ORDER BY rs_skip DESC, symbol) <= {POOL}) WHERE ear IS NOT NULL", "ear DESC"),
    top_sql("E3 no negative announcement", "SELECT * FROM ear_rows WHERE NOT coalesce(ear < 0, false)", "rs_skip DESC")]))


def _quota_sql(rule: str, minimums) -> str:
    if not minimums:
        return top_sql(rule, "SELECT * FROM rot_fit", "rs_skip DESC")
    values = ", ".join(str(m) for m in minimums)
    return f"""SELECT '{rule}' AS rule, n, period, symbol, fwd_rs FROM (SELECT f.*, row_number() OVER (PARTITION BY n, f.sector ORDER BY rs_skip DESC, symbol) <= coalesce(q.minimum, 0) AS must
  FROM rot_fit f LEFT JOIN (VALUES {values}) AS q(sector, minimum) ON q.sector = f.sector) QUALIFY row_number() OVER (PARTITION BY n ORDER BY must DESC, rs_skip DESC, symbol) <= {TOP}"""


define("quota_picks", " UNION ALL ".join([_quota_sql("B no quotas", None), _quota_sql("Q one each", QUOTA), _quota_sql("P pillars", PILLARS)]))
define("mkt_days", f"""
SELECT n, m, avg(m) OVER f AS m_mean, var_samp(m) OVER f AS m_var FROM (SELECT n, bench / lag(bench) OVER (ORDER BY n) - 1 AS m FROM (SELECT n, max(bench) AS bench FROM panel GROUP BY 1))
WINDOW f AS (ORDER BY n ROWS BETWEEN {LONG - 1 + SKIP} PRECEDING AND {SKIP} PRECEDING)""")
# residuals row by row over each rebalance date's window, as the definition says
define("ret_rows", "SELECT p.symbol, p.n, p.close / lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.n) - 1 AS r, d.m FROM panel p JOIN mkt_days d ON d.n = p.n")
define("ext_rows", f"""
SELECT b.symbol, b.n, sum(r.r - b.beta * r.m - b.alpha) / stddev_samp(r.r - b.beta * r.m - b.alpha) AS resid_mom,
  sign(product(1 + r.r) - 1) * (count(*) FILTER (r.r < 0) - count(*) FILTER (r.r > 0)) / count(*) AS pan FROM (
SELECT d.symbol, d.n, covar_samp(r.r, r.m) / any_value(m.m_var) AS beta, avg(r.r) - covar_samp(r.r, r.m) / any_value(m.m_var) * any_value(m.m_mean) AS alpha FROM (SELECT symbol, n FROM panel WHERE {REBALANCE_SQL}) d
JOIN ret_rows r ON r.symbol = d.symbol AND r.n BETWEEN d.n - {LONG - 1 + SKIP} AND d.n - {SKIP} AND r.r IS NOT NULL JOIN mkt_days m ON m.n = d.n GROUP BY 1, 2) b
JOIN ret_rows r ON r.symbol = b.symbol AND r.n BETWEEN b.n - {SHORT - 1} AND b.n - {SKIP} AND r.r IS NOT NULL GROUP BY 1, 2""")
define("ext_fit", f"""
SELECT p.symbol, p.n, p.session, p.rs_skip, p.fwd_rs, e.resid_mom, e.pan, {PERIOD_SQL} FROM (SELECT *, {rs_sql(SHORT - SKIP, SKIP)} AS rs_skip, {FWD_SQL} AS fwd_rs FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY n)) p
JOIN ext_rows e ON e.symbol = p.symbol AND e.n = p.n JOIN trend t ON t.symbol = p.symbol AND t.n = p.n
WHERE p.rs_skip IS NOT NULL AND p.fwd_rs IS NOT NULL AND e.resid_mom IS NOT NULL AND e.pan IS NOT NULL AND t.di_gap >= {GAP_FLOOR} AND p.history >= {MIN_HISTORY}""")
define("ext_picks", " UNION ALL ".join([
    top_sql("B baseline", "SELECT * FROM ext_fit", "rs_skip DESC"), top_sql("R residual momentum", "SELECT * FROM ext_fit", "resid_mom DESC"),
    top_sql("F frog in the pan", f"SELECT * FROM ext_fit QUALIFY row_number() OVER (PARTITION BY n ORDER BY rs_skip DESC, symbol) <= {POOL}", "pan")]))
define("tr_rows", """
SELECT symbol, n, row_number() OVER (PARTITION BY symbol ORDER BY n) AS i, CASE WHEN high IS NOT NULL THEN greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) END AS tr
FROM panel35 WINDOW w AS (PARTITION BY symbol ORDER BY n)""")
define("atr_steps", """
SELECT symbol, n, i, tr AS y, 1.0::DOUBLE AS old, CASE WHEN tr IS NULL THEN 0 ELSE 1 END AS seen FROM tr_rows WHERE i = 1
UNION ALL SELECT t.symbol, t.n, t.i, CASE WHEN t.tr IS NULL THEN a.y WHEN a.seen = 0 THEN t.tr ELSE (a.old * (13.0 / 14) * a.y + t.tr / 14) / (a.old * (13.0 / 14) + 1.0 / 14) END,
  CASE WHEN t.tr IS NULL THEN a.old * (13.0 / 14) ELSE 1.0 END, a.seen + CASE WHEN t.tr IS NULL THEN 0 ELSE 1 END FROM atr_steps a JOIN tr_rows t ON t.symbol = a.symbol AND t.i = a.i + 1""")
define("uni", f"""
SELECT p.*, f.market_cap, f.market_cap * p.close / last_value(p.close IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cap_then,
  CASE WHEN count(turnover) OVER m >= 40 THEN quantile_cont(turnover, 0.5) OVER m END AS median_turnover, {rs_sql(105, 21)} AS rs_skip, {FWD_SQL} AS fwd_rs, CASE WHEN a.seen >= 14 THEN a.y END AS atr, t.di_gap
FROM panel35 p JOIN fund f ON f.symbol = p.symbol JOIN atr_steps a ON a.symbol = p.symbol AND a.n = p.n LEFT JOIN trend35 t ON t.symbol = p.symbol AND t.n = p.n
WINDOW w AS (PARTITION BY p.symbol ORDER BY p.n), m AS (PARTITION BY p.symbol ORDER BY p.n ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
define("stop_picks", f"""
SELECT * FROM (SELECT *, {PERIOD_SQL}, count(*) OVER (PARTITION BY n) AS k, row_number() OVER (PARTITION BY n ORDER BY rs_skip DESC, symbol) AS place FROM uni WHERE {REBALANCE_SQL} AND rs_skip IS NOT NULL AND atr IS NOT NULL AND close IS NOT NULL
  AND di_gap >= {GAP_FLOOR} AND history >= {MIN_HISTORY} AND cap_then >= {CAP_FLOOR} AND median_turnover >= {TURNOVER_FLOOR}) WHERE k >= {TOP} AND place <= {TOP}""")
# day by day: the stop is raised after each close, a breach exits at the next close
define("stop_days", f"""
SELECT n AS n0, symbol, period, rule, close AS px, close - {STOP_MULTIPLE} * atr AS stop, CASE WHEN target THEN close + {STOP_MULTIPLE} * atr ELSE 'Infinity'::DOUBLE END AS goal, trail, n AS day, close AS last, false AS pending, NULL::DOUBLE AS out FROM stop_picks
  CROSS JOIN (VALUES ('S stop', true, false), ('S fixed stop', false, false), ('S stop and target', true, true)) AS v(rule, trail, target)
UNION ALL SELECT d.n0, d.symbol, d.period, d.rule, d.px, s.level, d.goal, d.trail, d.day + 1, coalesce(u.close, d.last), CASE WHEN u.close IS NULL OR d.out IS NOT NULL THEN d.pending WHEN d.pending THEN true ELSE u.close <= s.level OR u.close >= d.goal END,
  CASE WHEN d.out IS NOT NULL THEN d.out WHEN u.close IS NOT NULL AND d.pending THEN u.close END
FROM stop_days d LEFT JOIN uni u ON u.symbol = d.symbol AND u.n = d.day + 1 CROSS JOIN LATERAL (SELECT CASE WHEN d.trail AND u.close IS NOT NULL AND u.atr IS NOT NULL AND NOT d.pending THEN greatest(d.stop, u.close - {STOP_MULTIPLE} * u.atr) ELSE d.stop END AS level) s WHERE d.day < d.n0 + {HORIZON}""")
define("stop_slots", f"SELECT n0 AS n, symbol, period, rule, last / px AS held, CASE WHEN out IS NOT NULL THEN out / px * (1 - 0.0025) ELSE last / px END AS stopped, out IS NOT NULL AS exited FROM stop_days WHERE day = n0 + {HORIZON}")
define("stop_dates", f"""
SELECT s.rule, s.n, s.period, s.exits, (s.v - 1 - m.mkt) * 100 AS outcome FROM (SELECT rule, n, period, avg(stopped) AS v, count(*) FILTER (exited) AS exits FROM stop_slots GROUP BY 1, 2, 3 UNION ALL SELECT 'H hold', n, period, avg(held), 0 FROM stop_slots WHERE rule = 'S stop' GROUP BY 1, 2, 3) s
JOIN (SELECT n, lead(bench, {HORIZON}) OVER (ORDER BY n) / bench - 1 AS mkt FROM (SELECT n, max(bench) AS bench FROM panel35 GROUP BY 1)) m ON m.n = s.n""")
define("uni_rows", f"""
SELECT u.symbol, u.n, u.rs_skip, u.fwd_rs, {PERIOD_SQL}, v.universe FROM (SELECT * FROM uni WHERE {REBALANCE_SQL}) u JOIN listed l ON l.symbol = u.symbol CROSS JOIN (VALUES ('today'), ('point in time')) AS v(universe)
WHERE rs_skip IS NOT NULL AND fwd_rs IS NOT NULL AND di_gap >= {GAP_FLOOR} AND history >= {MIN_HISTORY} AND CASE WHEN v.universe = 'today' THEN market_cap >= {CAP_FLOOR} AND sector <> 'EUROPE' ELSE coalesce(cap_then >= {CAP_FLOOR} AND median_turnover >= {TURNOVER_FLOOR}, false) END""")
define("liq", f"""
SELECT f.symbol, f.market_cap, t.median_turnover FROM fund f JOIN (SELECT symbol, quantile_cont(turnover, 0.5) AS median_turnover FROM numbered WHERE n > (SELECT max(n) FROM cal) - 30 GROUP BY 1) t ON t.symbol = f.symbol WHERE f.market_cap >= {BANDS[0]}""")
_BAND = "CASE " + " ".join(f"WHEN market_cap > {a} {'' if b is None else f'AND market_cap <= {b}'} THEN '({a:g}, {'inf' if b is None else f'{b:g}'}]'" for a, b in zip(BANDS, [*BANDS[1:], None])) + " END"
OUTCOME = "label:s rule:s dates:i mean_pp:5 beat_pct:4 sd_pp:5 worst_pp:5"
DIFF = "rule:s diff_in:5 diff_out:5 t:5 adopt:b"

QUERIES = [
    Query("signal_panel", "B1 D14 W13", "symbol:s n:i session:d sector:s period:s fwd_rs:5 " + " ".join(f"{s}:5" for s in SIGNALS if s not in ("adx", "di_gap", "rsi")) + " burst_share:1 adx:5 di_gap:5 rsi:5 burst:b strong_trend:b overbought:b near_high:b",
          signal_panel, with_tables("SELECT * FROM signals")),
    Query("signal_dates", "B2 G11 K2 G12", "signal:s n:i period:s ic:6 names:i spread:5 best_beats:b worst_beats:b", date_scores, with_tables("SELECT * FROM scored")),
    Query("signal_scorecard", "B2 G18 G19", "label:s signal:s dates:i mean_ic:6 ic_positive_pct:4 t:4 top_fifth_pp:5 best_beat_pct:4 worst_beat_pct:4", scorecard, with_tables("SELECT * FROM card")),
    Query("conditional_effects", "B3", "label:s flag:s n_with:i n_without:i with_pp:5 without_pp:5 difference_pp:5 with_beat_pct:4 without_beat_pct:4", conditional, with_tables(
        "SELECT label, flag, count(*) FILTER (v) AS n_with, count(*) FILTER (NOT v) AS n_without, avg(fwd_rs) FILTER (v) AS with_pp, avg(fwd_rs) FILTER (NOT v) AS without_pp, avg(fwd_rs) FILTER (v) - avg(fwd_rs) FILTER (NOT v) AS difference_pp, "
        "avg(CASE WHEN fwd_rs > 0 THEN 100.0 ELSE 0 END) FILTER (v) AS with_beat_pct, avg(CASE WHEN fwd_rs > 0 THEN 100.0 ELSE 0 END) FILTER (NOT v) AS without_beat_pct FROM ("
        + " UNION ALL ".join(f"SELECT {lab} AS label, '{f}' AS flag, {f} AS v, fwd_rs FROM tops" for f in FLAGS for lab in ("'all'", "period")) + ") GROUP BY 1, 2",
        tops="SELECT * FROM (SELECT *, quantile_cont(rs_126, 0.8) OVER (PARTITION BY n) AS q FROM signals) WHERE rs_126 >= q")),
    Query("current_rule", "B4", "label:s vs_universe_pp:5 beat_pct:4 dates:i", current_rule, with_tables("""
SELECT label, avg(rule - al) AS vs_universe_pp, avg(CASE WHEN rule > 0 THEN 100.0 ELSE 0 END) AS beat_pct, count(*) AS dates FROM (SELECT 'all' AS label, * FROM d UNION ALL SELECT period, * FROM d) WHERE rule IS NOT NULL GROUP BY 1""",
        d="SELECT n, period, avg(fwd_rs) FILTER (rs_63 > 2 AND di_gap > 0) AS rule, avg(fwd_rs) AS al FROM signals GROUP BY 1, 2")),
    Query("signal_reliability", "B5", "signal:s ic_in:6 ic_out:6 t_all:4 side:s reliable:b", reliability, with_tables("""
SELECT signal, max(mean_ic) FILTER (label = 'in sample') AS ic_in, max(mean_ic) FILTER (label = 'out of sample') AS ic_out, any_value(t_all) AS t_all, CASE WHEN any_value(m) > 0 THEN 'top' ELSE 'bottom' END AS side,
  (bool_and(mean_ic > 0) OR bool_and(mean_ic < 0)) AND bool_and(CASE WHEN m > 0 THEN best_beat_pct ELSE worst_beat_pct END > base) AND coalesce(abs(any_value(t_all)) >= 2, false) AS reliable
FROM (SELECT c.*, b.base, avg(c.mean_ic) OVER (PARTITION BY c.signal) AS m, a.t AS t_all FROM card c JOIN (SELECT period, avg(CASE WHEN f > 0 THEN 100.0 ELSE 0 END) AS base FROM (SELECT n, period, avg(fwd_rs) AS f FROM signals GROUP BY 1, 2) GROUP BY 1) b ON b.period = c.label
LEFT JOIN card a ON a.signal = c.signal AND a.label = 'all') GROUP BY 1""")),
    Query("rotation_panel", "B6 W19 F12 F13", "symbol:s sector:s n:i session:d period:s history:i rs_skip:5 fwd_rs:5 di_gap:5 x_n:5 y_n:5 x_s:5 y_s:5 conviction:s", rotation_panel, with_tables("SELECT * FROM rotation")),
    Query("conviction_outcomes", "B6 G1", OUTCOME, conviction_outcomes, with_tables(outcome_sql(per_date_sql("conv_picks")))),
    Query("conviction_differences", "B6 G19", DIFF, conviction_differences, with_tables(diff_sql(per_date_sql("conv_picks"), "B no filter", True))),
    Query("conviction_changes", "U5", "n:i changed:b", conviction_changes, with_tables("""
SELECT n, list_sort(list(symbol) FILTER (rule = 'A conviction')) IS DISTINCT FROM list_sort(list(symbol) FILTER (rule = 'B no filter')) AS changed FROM conv_picks GROUP BY 1""")),
    Query("announcement_panel", "B7 J8", "symbol:s n:i session:d period:s rs_skip:5 fwd_rs:5 di_gap:5 ear:5", announcement_rows, with_tables("SELECT * FROM ear_rows")),
    Query("announcement_outcomes", "B7 K5", OUTCOME, announcement_outcomes, with_tables(outcome_sql(per_date_sql("ear_picks")))),
    Query("announcement_differences", "B7", DIFF, announcement_differences, with_tables(diff_sql(per_date_sql("ear_picks"), "B baseline"))),
    Query("quota_outcomes", "B8 K4", OUTCOME, quota_outcomes, with_tables(outcome_sql(per_date_sql("quota_picks")))),
    Query("quota_differences", "B8", DIFF, quota_differences, with_tables(diff_sql(per_date_sql("quota_picks"), "B no quotas"))),
    Query("residual_momentum", "B9 N22", "symbol:s n:i period:s rs_skip:5 resid_mom:4 pan:6 fwd_rs:5", extension_rows, with_tables("SELECT * FROM ext_fit")),
    Query("extension_differences", "B9 K5", DIFF, extension_differences, with_tables(diff_sql(per_date_sql("ext_picks"), "B baseline"))),
    Query("panel_true_range", "W18", "symbol:s n:i tr:6 atr:6", wide_range, with_tables("SELECT a.symbol, a.n, t.tr, a.y AS atr FROM atr_steps a JOIN tr_rows t ON t.symbol = a.symbol AND t.n = a.n WHERE seen >= 14")),
    Query("stop_rule_slots", "B10 W16", "n:i symbol:s rule:s held:6 stopped:6 exited:b", lambda spark, folder: stop_rule_paths(spark, folder)[0], with_tables("SELECT * FROM stop_slots")),
    Query("stop_rule_outcomes", "B10", "rule:s n:i period:s outcome:5 exits:i", stop_outcomes, with_tables("SELECT * FROM stop_dates")),
    Query("stop_rule_differences", "B10 G19", DIFF, stop_differences, with_tables(diff_sql("SELECT rule, n, period, outcome FROM stop_dates", "H hold"))),
    Query("universe_comparison", "B11 W11 U4", "universe:s n:i period:s names:i top:5 ic:6 fifth_spread:5", universe_comparison, with_tables(f"""
SELECT universe, n, period, count(*) AS names, CASE WHEN count(*) >= {TOP} THEN avg(fwd_rs) FILTER (hi <= {TOP}) END AS top, CASE WHEN count(*) >= 10 THEN corr(ra, rb) END AS ic,
  CASE WHEN count(*) >= 10 THEN avg(fwd_rs) FILTER (greatest(ceil((lo - 1) * 5 / (k - 1)), 1) = 5) - avg(fwd_rs) FILTER (greatest(ceil((lo - 1) * 5 / (k - 1)), 1) = 1) END AS fifth_spread FROM (
SELECT *, count(*) OVER (PARTITION BY universe, n) AS k, row_number() OVER (PARTITION BY universe, n ORDER BY rs_skip DESC, symbol) AS hi, row_number() OVER (PARTITION BY universe, n ORDER BY rs_skip, symbol) AS lo,
  {avg_rank_sql('rs_skip', 'universe, n')} AS ra, {avg_rank_sql('fwd_rs', 'universe, n')} AS rb FROM uni_rows) GROUP BY 1, 2, 3""")),
    Query("liquidity_bands", "B12 G17", "band:s stocks:i median_turnover:3 share_liquid:5", liquidity_bands, with_tables(
        f"SELECT {_BAND} AS band, count(*) AS stocks, quantile_cont(median_turnover, 0.5) AS median_turnover, avg(CASE WHEN median_turnover >= 6000 THEN 1.0 ELSE 0.0 END) AS share_liquid FROM liq GROUP BY 1")),
    Query("liquidity_correlation", "B12 G11", "ic:6 names:i", liquidity_correlation, with_tables(
        f"SELECT corr(ra, rb) AS ic, count(*) AS names FROM (SELECT {avg_rank_sql('market_cap', '1')} AS ra, {avg_rank_sql('median_turnover', '1')} AS rb FROM liq)")),
]
