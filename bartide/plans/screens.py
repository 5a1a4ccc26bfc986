"""Registered queries: screens, review tables, rankings, picks, result calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from bartide.functions.numbers import half_away
from bartide.operators import indicators as ind
from bartide.operators import screening as sc
from bartide.operators.ranking import with_positions
from bartide.plans.catalog import Query
from bartide.plans.market_sql import SYMBOL, define, offset_sql, spread_sql, with_tables
from bartide.session import cut_lineage
from bartide.sources import market as mk

AS_OF, EVALUATION_START = "2001-06-15", "2001-04-02"
FIELDS = ["market_cap", "roce", "opm", "debt_to_equity", "operating_cash_flow", "interest_coverage", "pledged_pct", "sales_growth_3yr"]
MINIMUMS = [("AFRICA", 2), ("ASIA", 1), ("EUROPE", 1)]
SIZE = 8


def stored_bars(spark, folder):
    """Weekly bars computed once: the queries here read them several times."""
    return cut_lineage(mk.weekly_bars(spark, folder))


def members(spark, folder):
    return mk.listings(spark, folder).select("symbol", "company", "sector")


def checked(spark, folder):
    rows = mk.fundamentals(spark, folder).join(mk.listings(spark, folder).select("symbol", "sector"), "symbol")
    return sc.with_checks(rows, mk.criteria(spark), FIELDS)


def criteria_checks(spark, folder):
    rows = checked(spark, folder).select("symbol", "sector", F.explode("checks").alias("c"))
    return rows.select("symbol", "sector", "c.ord", "c.field", "c.value", "c.passed")


def fundamental_screen(spark, folder):
    return checked(spark, folder).withColumn("thin_margin", sc.thin_margin_exception())


def sector_screens(spark, folder):
    bars = stored_bars(spark, folder)
    technicals = members(spark, folder).join(ind.technical_summary(bars, mk.benchmark(bars), dealt=mk.by_symbol(spark, folder, bars)), "symbol", "left")
    return sc.sector_screen(technicals, checked(spark, folder))


def review(spark, folder):
    bars = stored_bars(spark, folder)
    return sc.review_table(bars, mk.benchmark(bars), members(spark, folder), checked(spark, folder), min_turnover=0.5, gap_floor=0.3,
                           dealt=mk.by_symbol(spark, folder, bars))


def ordered_review(spark, folder):
    """Place of every symbol in the printed review: most passed checks first, then the lower sector rank, unranked ones last."""
    rows = cut_lineage(review(spark, folder).select("symbol", "passed_count", "sector_rank"))
    # both parts in one exact number, so that places are found without ordering all rows in one task
    order = F.col("passed_count").cast("double") * 2 ** 32 - F.coalesce(F.col("sector_rank").cast("double"), F.lit(2.0 ** 31))
    placed = with_positions(rows.withColumns({"all": F.lit(1), "order": order}), ["all"], "order", ["symbol"], "place")
    return placed.orderBy(F.desc("passed_count"), F.asc_nulls_last("sector_rank"), "symbol")


def ranking(spark, folder):
    minimums = spark.createDataFrame(MINIMUMS, "sector string, minimum int")
    return sc.selection_ranking(cut_lineage(review(spark, folder)), SIZE, minimums)


def meetings(spark, folder):
    """Board meetings as published, reduced to those about results."""
    rows = mk.table(spark, folder, "lineitem").where((F.col("l_linenumber") == 4) & (F.col("l_quantity") >= 40))
    purpose = F.when(F.col("l_partkey") % 3 == 0, "Fund Raising").otherwise("Financial Results")
    raw = rows.select(mk.symbol_of("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("bm_date"),
                      purpose.alias("bm_purpose"), F.concat(F.lit("To consider lot "), F.col("l_orderkey").cast("string")).alias("bm_desc"))
    return result_meetings(raw)


def result_meetings(raw):
    about = F.lower(F.concat_ws(" ", "bm_purpose", "bm_desc"))
    return (raw.where(about.contains("result")).select("symbol", F.to_date("bm_date", "dd-MMM-yyyy").alias("meeting"))
            .where(F.col("meeting").isNotNull()).distinct())


def result_calendar(spark, folder):
    return sc.result_dates(meetings(spark, folder), AS_OF, EVALUATION_START)


def due_soon(spark, folder):
    """Unreported results due within a week, split by whether a stop is held (the stock has positive net trades)."""
    dates = result_calendar(spark, folder).where((F.col("basis") != sc.REPORTED) & F.col("days_to_results").between(0, 7))
    signed = F.when(F.col("action") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = (mk.trades(spark, folder).where(F.col("session") <= F.lit(AS_OF).cast("date")).groupBy(F.col("instrument").alias("symbol"))
            .agg(F.sum(signed).alias("net")).where(F.col("net") > 0))
    return dates.join(held, "symbol", "left").withColumn("state", F.when(F.col("net").isNotNull(), "held").otherwise("reserve"))


def run_ups(spark, folder):
    bars = stored_bars(spark, folder)
    spread = ind.spreads(ind.paired_sessions(bars, mk.benchmark(bars)), {"10": 10, "63": 63})
    return sc.run_up_and_catalysts(members(spark, folder), spread, result_calendar(spark, folder), AS_OF)


def sweep(spark, folder):
    """All members but the picks, run-up and calendar beside the review columns, best fundamentals first."""
    table = cut_lineage(review(spark, folder))
    minimums = spark.createDataFrame(MINIMUMS, "sector string, minimum int")
    picks = sc.selection_ranking(table, SIZE, minimums).where("picked").select("symbol")
    info = sc.result_dates(meetings(spark, folder), AS_OF, EVALUATION_START)
    rest = table.join(picks, "symbol", "left_anti").join(info, "symbol", "left")
    return rest.withColumn("clean_candidate", F.coalesce(F.col("clean") & F.col("technically_attractive") & ~F.col("recent_spike"), F.lit(False)))


def consistency(spark, folder):
    """Assertion: the sweep (from the review's chained path) and a fresh 63-session strength agree; no rows when they do.

    The picks, which the sweep leaves out, and symbols ending in 07, which are shifted on purpose, are what it reports."""
    bars = stored_bars(spark, folder)
    fresh = ind.spreads(ind.paired_sessions(bars, mk.benchmark(bars)), {"63": 63})
    odd = fresh.withColumn("rs_63", F.when(F.substring("symbol", -2, 2) == "07", F.col("rs_63") + 0.02).otherwise(F.col("rs_63")))
    return sc.disagreements(sweep(spark, folder), odd, "symbol", "rs_63")


def tampered_review(spark, folder):
    """The review with faults put in on purpose: symbols ending in 03 are lost, in 05 doubled, and those in 07 changed in every compared column."""
    table = cut_lineage(review(spark, folder)).withColumn("passed_technical", F.col("technically_attractive"))
    ends = lambda tail: F.substring("symbol", -2, 2) == tail
    changed = {c: F.when(ends("07"), F.col(c) + 0.5).otherwise(F.col(c)) for c in SUMMARY_COLUMNS if c != "trend"}
    changed |= {"trend": F.when(ends("07"), "?").otherwise(F.col("trend")), "passed_technical": F.when(ends("07"), ~F.col("passed_technical")).otherwise(F.col("passed_technical"))}
    kept = table.where(~ends("03")).withColumns(changed)
    return cut_lineage(kept.unionByName(kept.where(ends("05"))))


def review_members(spark, folder):
    """Assertion: the review has one row for each constituent; what it reports are the faults put in."""
    return sc.membership_problems(tampered_review(spark, folder), members(spark, folder))


def output_agreement(spark, folder):
    """Assertion: technical summary and sector screens agree with the review in every shared column; what differs are the faults put in."""
    table = tampered_review(spark, folder).dropDuplicates(["symbol"])
    bars = stored_bars(spark, folder)
    summary = ind.technical_summary(bars, mk.benchmark(bars), dealt=mk.by_symbol(spark, folder, bars))
    screens = sector_screens(spark, folder)
    first = sc.column_agreement(summary, table, "symbol", dict.fromkeys(SUMMARY_COLUMNS, 1e-9) | {"trend": None}).withColumn("source", F.lit("technical summary"))
    second = sc.column_agreement(screens, table, "symbol", {"rs_63": 0.011, "passed_technical": None}).withColumn("source", F.lit("sector screens"))
    return first.unionByName(second)


def quality(spark, folder):
    rows = mk.fundamentals(spark, folder).join(members(spark, folder), "symbol")
    scored = sc.quality_score(rows, ["roce", "opm", "qtr_profit_yoy", "qtr_sales_yoy"], ["debt_to_equity"])
    return with_positions(scored, [], "score", ["symbol"], "position")


def universe(spark, folder):
    """Universe rule: listed, large enough, sectors and names on the exclusion list left out."""
    excluded = spark.createDataFrame([("Supplier#000000003",), ("Supplier#000000011",)], "company string")
    rows = mk.fundamentals(spark, folder).select("symbol", "market_cap").join(members(spark, folder), "symbol")
    return rows.where((F.col("market_cap") >= 300) & (F.col("sector") != "EUROPE")).join(excluded, "company", "left_anti")


def aliased(spark, folder):
    """Renamed symbols: old codes mapped to new ones before the rows are grouped."""
    renames = spark.createDataFrame([("Brand#4", "Brand#7"), ("Brand#9", "Brand#1")], "old string, new string")
    parts = mk.table(spark, folder, "part").select(F.col("p_brand").alias("old"), "p_retailprice")
    named = parts.join(renames, "old", "left").withColumn("brand", F.coalesce("new", "old"))
    return named.groupBy("brand").agg(F.count(F.lit(1)).alias("parts"), F.avg("p_retailprice").alias("mean_price"))


def trend_ok(spark, folder):
    bars = stored_bars(spark, folder)
    last = ind.last_oscillators(mk.by_symbol(spark, folder, bars))
    return last.withColumn("di_gap", half_away(F.col("plus_di") - F.col("minus_di"), 2)).where(F.col("di_gap") >= 2.0)


def point_in_time_caps(spark, folder):
    """Market value of every symbol at every session (today's value scaled by price) with rolling median turnover; the
    universe flag uses only what was known then."""
    from bartide.operators import rolling as rl
    from pyspark.sql import Window

    bars = mk.weekly_bars(spark, folder)
    caps = mk.fundamentals(spark, folder).select("symbol", "market_cap")
    whole = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bars.select("symbol", "session", "close", F.last("close").over(whole).alias("last"),
                       rl.rolling_median("turnover", 63, 40).alias("median_turnover"))
    valued = rows.join(caps, "symbol").withColumn("cap_then", F.col("market_cap") * F.col("close") / F.col("last"))
    return valued.withColumn("in_universe", F.coalesce((F.col("cap_then") >= 300) & (F.col("median_turnover") >= 4000), F.lit(False)))


def funnel(spark, folder):
    table = review(spark, folder)
    picked = sc.conviction("quadrant_market", "quadrant_sector").isin(sc.HIGH, sc.MODERATE)
    counts = table.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("market_cap") >= 300).alias("large"),
                       F.count_if(F.col("hard_pass")).alias("sound"), F.count_if("eligible").alias("eligible"),
                       F.count_if(F.col("eligible") & picked).alias("confirmed"))
    return counts.unpivot([], ["members", "large", "sound", "eligible", "confirmed"], "stage", "symbols")


# ---- the same in SQL ----
define("checks", """
SELECT symbol, sector, ord, field, label, hard, value, coalesce(CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold
  WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold END, false) AS passed
FROM (SELECT f.symbol, l.sector, c.ord, c.field, c.op, c.threshold, c.label, c.hard, CASE c.field WHEN 'market_cap' THEN market_cap WHEN 'roce' THEN roce
    WHEN 'opm' THEN opm WHEN 'debt_to_equity' THEN debt_to_equity WHEN 'operating_cash_flow' THEN operating_cash_flow
    WHEN 'interest_coverage' THEN interest_coverage WHEN 'pledged_pct' THEN pledged_pct WHEN 'sales_growth_3yr' THEN sales_growth_3yr END AS value
  FROM fund f JOIN listed l ON l.symbol = f.symbol JOIN criteria c ON c.sector = l.sector)""")
define("checked", """
SELECT c.*, CASE WHEN NOT has_opm THEN NULL ELSE only_opm AND coalesce(f.roce > 15, false) END AS thin_margin FROM (
SELECT symbol, sector, count(*) FILTER (passed) AS passed_count, count(*) AS criteria_total,
  coalesce(string_agg(CASE WHEN value IS NULL THEN label || ' (missing)' ELSE label END, '; ' ORDER BY ord) FILTER (NOT passed), '') AS failed_criteria,
  bool_and(passed) AS passes_screen, bool_and(passed OR NOT hard) AS hard_pass,
  coalesce(string_agg(label, '; ' ORDER BY ord) FILTER (NOT passed AND NOT hard), '') AS soft_fails,
  bool_or(field = 'opm') AS has_opm, bool_and(passed <> (field = 'opm')) AS only_opm
FROM checks GROUP BY 1, 2) c JOIN fund f ON f.symbol = c.symbol""")
define("technicals", f"""
SELECT l.symbol, l.company, l.sector, CASE WHEN t.total >= 5 THEN round_even(t.plus_di, 2) END AS plus_di, CASE WHEN t.total >= 5 THEN round_even(t.minus_di, 2) END AS minus_di,
  CASE WHEN t.total >= 5 THEN t.trend WHEN t.total IS NOT NULL THEN 'N/A (Insufficient Data)' END AS trend, CASE WHEN t.total >= 5 THEN s.rs END AS rs_63, t.total AS sessions
FROM listed l LEFT JOIN (SELECT * FROM tech WHERE rn = total) t ON t.symbol = l.symbol LEFT JOIN spread63 s ON s.symbol = l.symbol""")
define("judged", """
SELECT *, rs_63 > 2 AND coalesce(trend, '') LIKE 'Bullish%' AND rs_63 IS NOT NULL AS attractive_raw,
  concat_ws('; ', CASE WHEN rs_63 IS NULL THEN 'RS unavailable' WHEN rs_63 <= 2 THEN 'RS <= +2 pp' END,
    CASE WHEN coalesce(trend, 'None') NOT LIKE 'Bullish%' THEN 'trend ' || split_part(coalesce(trend, 'None'), ' (', 1) END) AS reason FROM technicals""")
define("spread63", spread_sql(63))
define("spread10", spread_sql(10))
define("path63", offset_sql(63))
define("path105", offset_sql(105))
define("momentum", """
SELECT symbol, CASE WHEN k = 10 THEN round_even(late - prev, 2) END AS rs_momentum FROM (SELECT symbol,
  avg(CASE WHEN d < 5 THEN rs END) AS late, avg(CASE WHEN d BETWEEN 10 AND 14 THEN rs END) AS prev,
  count(CASE WHEN d < 5 OR d BETWEEN 10 AND 14 THEN rs END) AS k FROM path63 GROUP BY 1)""")
define("sector_ends", """
SELECT p.symbol, l.sector, p.d, p.ret - avg(p.ret) OVER (PARTITION BY l.sector, p.d) AS vs FROM path63 p JOIN paired q ON q.symbol = p.symbol AND q.d = p.d
JOIN listed l ON l.symbol = p.symbol WHERE q.total >= 78 AND (p.d < 5 OR p.d BETWEEN 10 AND 14)""")
define("sector_rot", """
SELECT e.symbol, e.sector, round_even(max(CASE WHEN d = 0 THEN vs END), 2) AS vs_sector, CASE WHEN count(vs) = 10 THEN
  round_even(avg(CASE WHEN d < 5 THEN vs END) - avg(CASE WHEN d BETWEEN 10 AND 14 THEN vs END), 2) END AS sector_momentum FROM sector_ends e GROUP BY 1, 2""")


def quadrant_sql(s: str, m: str) -> str:
    return f"CASE WHEN {s} IS NULL OR {m} IS NULL THEN NULL WHEN {s} > 0 THEN CASE WHEN {m} > 0 THEN 'LEADING' ELSE 'WEAKENING' END WHEN {m} > 0 THEN 'IMPROVING' ELSE 'LAGGING' END"


define("review", f"""
SELECT *, coalesce(passed_count = criteria_total, false) AS clean, coalesce(abs(di_gap) < 0.3, false) AS thin_trend,
  coalesce(recent_share > 50, false) AS recent_spike, coalesce(hard_pass, false) AND coalesce(di_gap >= 0.3, false) AND coalesce(sessions >= 240, false) AND rs_select IS NOT NULL
    AND coalesce(median_turnover >= 0.5, false) AND coalesce(qtr_profit_yoy > 0 AND qtr_net_profit > 0, false) AS eligible,
  coalesce(passed_count = criteria_total AND quadrant_market = 'LEADING' AND quadrant_sector = 'LEADING' AND di_gap >= 0.3, false) AS full_standard FROM (
SELECT j.symbol, j.company, j.sector, c.passed_count, c.criteria_total, c.failed_criteria, c.hard_pass, c.soft_fails, c.thin_margin, f.market_cap, f.qtr_profit_yoy, f.qtr_net_profit,
  j.rs_63, j.trend, j.sessions, j.reason = '' AS technically_attractive, round(j.plus_di - j.minus_di, 2) AS di_gap, m.rs_momentum, s.rs AS rs_10,
  CASE WHEN j2.rs > 0 THEN round_even(s.rs / j2.rs * 100, 1) END AS recent_share, p.rs AS rs_select, t.median_turnover, r.vs_sector, r.sector_momentum,
  CASE WHEN r.vs_sector IS NOT NULL THEN rank() OVER (PARTITION BY j.sector ORDER BY r.vs_sector DESC NULLS LAST) END AS sector_rank,
  {quadrant_sql('j.rs_63', 'm.rs_momentum')} AS quadrant_market, {quadrant_sql('r.vs_sector', 'r.sector_momentum')} AS quadrant_sector
FROM judged j LEFT JOIN checked c ON c.symbol = j.symbol LEFT JOIN fund f ON f.symbol = j.symbol LEFT JOIN momentum m ON m.symbol = j.symbol
LEFT JOIN spread10 s ON s.symbol = j.symbol LEFT JOIN spread63 j2 ON j2.symbol = j.symbol LEFT JOIN (SELECT symbol, rs FROM path105 WHERE d = 21) p ON p.symbol = j.symbol
LEFT JOIN (SELECT symbol, round_even(quantile_cont(turnover, 0.5) / 100, 2) AS median_turnover FROM (SELECT symbol, turnover, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars)
  WHERE k <= 63 GROUP BY 1) t ON t.symbol = j.symbol LEFT JOIN sector_rot r ON r.symbol = j.symbol)""")
define("ranked", """
SELECT *, row_number() OVER (ORDER BY rs_select DESC, symbol) AS selection_rank, CASE WHEN quadrant_market IS NULL OR quadrant_sector IS NULL THEN NULL
  WHEN quadrant_market = 'LEADING' AND quadrant_sector = 'LEADING' THEN 'High'
  WHEN quadrant_market IN ('LEADING', 'IMPROVING') OR quadrant_sector IN ('LEADING', 'IMPROVING') THEN 'Moderate' ELSE 'Low' END AS conviction FROM review WHERE eligible""")
define("picks", f"""
SELECT symbol FROM (SELECT symbol, selection_rank, row_number() OVER (PARTITION BY sector ORDER BY selection_rank) <= coalesce(minimum, 0) AS must
  FROM ranked LEFT JOIN (VALUES {", ".join(str(m) for m in MINIMUMS)}) AS q(sector, minimum) USING (sector) WHERE conviction IN ('High', 'Moderate'))
ORDER BY must DESC, selection_rank LIMIT {SIZE}""")
define("ranking", f"""
SELECT r.*, p.symbol IS NOT NULL AS picked, CASE WHEN p.symbol IS NOT NULL THEN '' WHEN conviction IN ('High', 'Moderate') THEN 'not among the first {SIZE}'
  ELSE 'conviction too low' END AS why_not_picked FROM ranked r LEFT JOIN picks p ON p.symbol = r.symbol""")
define("meetings", f"""
SELECT DISTINCT {SYMBOL.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS meeting FROM lineitem WHERE l_linenumber = 4 AND l_quantity >= 40 AND l_partkey % 3 <> 0""")
define("result_dates", f"""
SELECT *, result_date - DATE '{AS_OF}' AS days_to_results FROM (SELECT *, CASE WHEN last_date >= DATE '{EVALUATION_START}' THEN last_date WHEN next_date IS NOT NULL THEN next_date ELSE prior_year_date + 364 END AS result_date,
  CASE WHEN last_date >= DATE '{EVALUATION_START}' THEN 'reported' WHEN next_date IS NOT NULL THEN 'announced' WHEN prior_year_date IS NOT NULL THEN 'estimate' ELSE 'unknown' END AS basis
FROM (SELECT symbol, min(meeting) FILTER (meeting >= DATE '{AS_OF}') AS next_date, max(meeting) FILTER (meeting < DATE '{AS_OF}') AS last_date,
  min(meeting) FILTER (year(meeting) = 2000 AND month(meeting) >= 10) AS prior_year_date FROM meetings GROUP BY 1))""")

SUMMARY_COLUMNS = ["current_price", "rsi", "adx", "rs_63", "support", "resistance", "trend"]
_SUMMED = """SELECT t.symbol, round_even(t.close, 2) AS current_price, round_even(rsi, 2) AS rsi, round_even(adx, 2) AS adx, s.rs AS rs_63, support, resistance, trend
  FROM tech t LEFT JOIN spread63 s ON s.symbol = t.symbol LEFT JOIN levels l ON l.symbol = t.symbol WHERE t.rn = t.total AND t.total >= 5"""
_ODD = "right(symbol, 2) = '07'"
AGREEMENT_SQL = " UNION ALL ".join(
    f"SELECT 'technical summary' AS source, '{c}' AS field, count(*) FILTER (right(symbol, 2) <> '03') AS pairs, count(*) FILTER ({_ODD}{'' if c == 'trend' else f' AND {c} IS NOT NULL'}) AS differing FROM summed"
    for c in SUMMARY_COLUMNS) + f""" UNION ALL SELECT 'sector screens', 'rs_63', count(*) FILTER (right(symbol, 2) <> '03'), count(*) FILTER ({_ODD} AND rs_63 IS NOT NULL) FROM judged
UNION ALL SELECT 'sector screens', 'passed_technical', count(*) FILTER (right(symbol, 2) <> '03'), count(*) FILTER ({_ODD}) FROM judged"""

REVIEW = ("symbol:s company:s sector:s passed_count:i criteria_total:i failed_criteria:s hard_pass:b soft_fails:s thin_margin:b trend:s sessions:i rs_63:2 rs_momentum:2 "
          "rs_10:2 recent_share:1 rs_select:2 median_turnover:2 vs_sector:2 sector_momentum:2 sector_rank:i quadrant_market:s quadrant_sector:s technically_attractive:b "
          "di_gap:2 thin_trend:b recent_spike:b clean:b eligible:b full_standard:b")

QUERIES = [
    Query("criteria_checks", "F8 D8 N16", "symbol:s sector:s ord:i field:s value:5 passed:b", criteria_checks, with_tables("SELECT * FROM checks")),
    Query("fundamental_screen", "F9 X5 D7", "symbol:s sector:s passed_count:i criteria_total:i failed_criteria:s passes_screen:b hard_pass:b soft_fails:s thin_margin:b",
          fundamental_screen, with_tables("SELECT * FROM checked")),
    Query("sector_screens", "Q1 F7 F10", "symbol:s company:s sector:s rs_63:2 trend:s passed_technical:b technical_reason:s passed_fundamental:b failed_criteria:s passes_both:b",
          sector_screens, with_tables("""
SELECT j.symbol, j.company, j.sector, rs_63, trend, reason = '' AS passed_technical, reason AS technical_reason, CASE WHEN reason = '' THEN coalesce(c.passes_screen, false) END AS passed_fundamental,
  CASE WHEN reason = '' THEN c.failed_criteria END AS failed_criteria, reason = '' AND coalesce(c.passes_screen, false) AS passes_both FROM judged j LEFT JOIN checked c ON c.symbol = j.symbol""")),
    Query("review_table", "Q2 Q3 Q7 F11 F12", REVIEW, review, with_tables("SELECT * FROM review")),
    Query("ordered_review", "K1 Q2", "symbol:s passed_count:i sector_rank:i place:i", ordered_review, with_tables(
        "SELECT symbol, passed_count, sector_rank, row_number() OVER (ORDER BY passed_count DESC, sector_rank ASC NULLS LAST, symbol) AS place FROM review")),
    Query("selection_ranking", "Q4 K3 F13 F20 U1 J11 X4", "symbol:s sector:s rs_select:2 selection_rank:i conviction:s picked:b why_not_picked:s", ranking, with_tables("SELECT * FROM ranking")),
    Query("result_calendar", "X20 S7 D13", "symbol:s next_date:d last_date:d prior_year_date:d result_date:d basis:s days_to_results:i", result_calendar, with_tables("SELECT * FROM result_dates")),
    Query("results_due_soon", "F22", "symbol:s result_date:d basis:s days_to_results:i state:s", due_soon, with_tables(f"""
SELECT d.symbol, result_date, basis, days_to_results, CASE WHEN h.net IS NOT NULL THEN 'held' ELSE 'reserve' END AS state FROM result_dates d LEFT JOIN (
  SELECT instrument, sum(CASE WHEN action = 'BUY' THEN quantity ELSE -quantity END) AS net FROM trades WHERE session <= DATE '{AS_OF}' GROUP BY 1 HAVING net > 0) h ON h.instrument = d.symbol
WHERE basis <> 'reported' AND days_to_results BETWEEN 0 AND 7""")),
    Query("run_up_and_catalysts", "Q5", "symbol:s rs_10:2 rs_63:2 recent_share:1 recent_spike:b next_date:d basis:s within_window:b", run_ups, with_tables(f"""
SELECT *, coalesce(recent_share > 50, false) AS recent_spike FROM (SELECT l.symbol, a.rs AS rs_10, b.rs AS rs_63, CASE WHEN b.rs > 0 THEN round_even(a.rs / b.rs * 100, 1) END AS recent_share,
  d.next_date, coalesce(d.basis, 'unknown') AS basis, d.next_date <= DATE '{AS_OF}' + 30 AS within_window
FROM listed l LEFT JOIN spread10 a ON a.symbol = l.symbol LEFT JOIN spread63 b ON b.symbol = l.symbol LEFT JOIN result_dates d ON d.symbol = l.symbol)""")),
    Query("candidate_sweep", "Q6 J10", "symbol:s sector:s passed_count:i rs_63:2 clean:b technically_attractive:b recent_spike:b sector_rank:i next_date:d basis:s clean_candidate:b", sweep, with_tables("""
SELECT r.*, d.next_date, d.basis, coalesce(clean AND technically_attractive AND NOT recent_spike, false) AS clean_candidate FROM review r LEFT JOIN result_dates d ON d.symbol = r.symbol
WHERE r.symbol NOT IN (SELECT symbol FROM picks)""")),
    Query("table_consistency", "J16 Q6", "symbol:s a:2 b:2", consistency, with_tables("""
SELECT coalesce(s.symbol, f.symbol) AS symbol, s.rs_63 AS a, f.rs AS b FROM (SELECT symbol, rs_63 FROM review WHERE symbol NOT IN (SELECT symbol FROM picks)) s
FULL JOIN (SELECT symbol, rs + CASE WHEN right(symbol, 2) = '07' THEN 0.02 ELSE 0 END AS rs FROM spread63) f ON f.symbol = s.symbol
WHERE abs(s.rs_63 - f.rs) > 0.011 OR (s.rs_63 IS NULL) <> (f.rs IS NULL)""")),
    Query("review_members", "Q7", "symbol:s problem:s rows:i", review_members, with_tables("""
SELECT symbol, CASE WHEN right(symbol, 2) = '03' THEN 'missing' ELSE 'repeated' END AS problem, CASE WHEN right(symbol, 2) = '03' THEN 0 ELSE 2 END AS rows FROM listed WHERE right(symbol, 2) IN ('03', '05')""")),
    Query("output_agreement", "Q7 J16", "source:s field:s pairs:i differing:i", output_agreement, with_tables(AGREEMENT_SQL, summed=_SUMMED)),
    Query("quality_score", "Q9 W9", "symbol:s score:6 position:i", quality, with_tables("""
SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS position FROM (SELECT symbol, (coalesce(roce_r, 0.5) + coalesce(opm_r, 0.5) + coalesce(p_r, 0.5) + coalesce(s_r, 0.5) + coalesce(d_r, 0.5)) / 5 AS score
FROM (SELECT symbol, """ + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {o}{c} NULLS LAST) + (count({c}) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END AS {a}"
        for c, a, o in (("roce", "roce_r", ""), ("opm", "opm_r", ""), ("qtr_profit_yoy", "p_r", ""), ("qtr_sales_yoy", "s_r", ""), ("debt_to_equity", "d_r", "-")))
        + " FROM fund))")),
    Query("universe_rule", "F3 S9 U4", "symbol:s company:s sector:s market_cap:4", universe, with_tables("""
SELECT l.symbol, company, sector, market_cap FROM listed l JOIN fund f ON f.symbol = l.symbol WHERE market_cap >= 300 AND sector <> 'EUROPE' AND company NOT IN ('Supplier#000000003', 'Supplier#000000011')""")),
    Query("symbol_aliases", "F4", "brand:s parts:i mean_price:4", aliased, """
SELECT CASE p_brand WHEN 'Brand#4' THEN 'Brand#7' WHEN 'Brand#9' THEN 'Brand#1' ELSE p_brand END AS brand, count(*) AS parts, avg(p_retailprice) AS mean_price FROM part GROUP BY 1"""),
    Query("trend_confirmed", "Q8", "symbol:s di_gap:2", trend_ok, with_tables(
        "SELECT symbol, round(plus_di - minus_di, 2) AS di_gap FROM tech WHERE rn = total AND round(plus_di - minus_di, 2) >= 2.0")),
    Query("point_in_time_universe", "Q10", "symbol:s session:d cap_then:4 median_turnover:3 in_universe:b", point_in_time_caps, with_tables("""
SELECT *, coalesce(cap_then >= 300 AND median_turnover >= 4000, false) AS in_universe FROM (SELECT b.symbol, b.session, f.market_cap * b.close / last_value(b.close) OVER (PARTITION BY b.symbol ORDER BY b.session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cap_then,
  CASE WHEN count(turnover) OVER w >= 40 THEN quantile_cont(turnover, 0.5) OVER w END AS median_turnover FROM bars b JOIN fund f ON f.symbol = b.symbol
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))""")),
    Query("selection_funnel", "G22", "stage:s symbols:i", funnel, with_tables("""
SELECT 'members' AS stage, count(*) AS symbols FROM review UNION ALL SELECT 'large', count(*) FILTER (market_cap >= 300) FROM review UNION ALL SELECT 'sound', count(*) FILTER (hard_pass) FROM review
UNION ALL SELECT 'eligible', count(*) FILTER (eligible) FROM review UNION ALL SELECT 'confirmed', count(*) FILTER (conviction IN ('High', 'Moderate')) FROM ranked""")),
]
