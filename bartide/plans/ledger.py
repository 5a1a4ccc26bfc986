"""Registered queries: ledgers, daily values, replacement plans, attribution, rates of return."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.functions import text
from bartide.functions.numbers import group_rupees
from bartide.operators import indicators as ind
from bartide.operators import ledger as lg
from bartide.operators import options as op
from bartide.operators import risk as rk
from bartide.operators import screening as sc
from bartide.operators.ranking import with_positions
from bartide.plans import options as option_plans

from bartide.plans import risk as risk_plans

from bartide.plans.catalog import Query
from bartide.plans.market_sql import define, with_tables
from bartide.plans.risk import PERF_SQL, VALUE_SQL, var_sql
from bartide.session import cut_lineage, once
from bartide.sources import market as mk

PRINCIPAL, SLEEVE = 1e7, 0.97
START = "2001-06-04"  # first day of the ledger that the replacement rule looks at
STOP_DAY, STOP_SHARE = "2001-08-06", 0.985
TRIGGER = 0.5
CONVICTION = 0.72  # least quality score of a reserve stock
TREND_GAP = 2.0  # least lead of upward over downward movement
# fixed values: the watch list and its display order
WATCHED = ("SYM0000000005", "SYM0000000002", "SYM0000000009", "SYM0000000000", "SYM0000000007")


def trades(spark, folder):
    return mk.trades(spark, folder)


@once
def stored_trades(spark, folder):
    """The ledger, for queries that read it in several places."""
    return trades(spark, folder)


def recent(spark, folder):
    return trades(spark, folder).where(F.col("session") >= F.lit(START).cast("date"))


def net_positions(spark, folder):
    rows = lg.net_positions(trades(spark, folder))
    return rows.withColumn("state", F.when(lg.is_option(), "option").when(F.col("net") > 0, "held").otherwise("short"))


def oversold(spark, folder):
    return lg.oversold(trades(spark, folder))


def parked(spark, folder):
    return lg.parked_proceeds(trades(spark, folder))


def instrument_parts(spark, folder):
    rows = trades(spark, folder).select("ref", "instrument", text.option_parts("instrument").alias("o"))
    return rows.where(F.col("o").isNotNull()).select("ref", "o.expiry", "o.strike", "o.kind")


def trade_sentences(spark, folder):
    """Every trade written as a sentence and read back; prices keep two decimals."""
    said = F.format_string("%s %.0f %s @ %.2f (1 lots)", "action", "quantity", "instrument", F.round("price", 2))
    rows = trades(spark, folder).select("ref", said.alias("said")).withColumn("t", text.trade_parts("said"))
    return rows.select("ref", "t.action", "t.quantity", "t.instrument", "t.price")


def grouped_amounts(spark, folder):
    return mk.table(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"), group_rupees(F.col("o_totalprice") * 1000).alias("amount"))


def problems(spark, folder):
    """Ledger rows with injected faults: every 50th order writes a bad date, every 60th a zero quantity, and so on."""
    rows = mk.table(spark, folder, "lineitem").where(F.col("l_linenumber") == 1)
    key = F.col("l_orderkey")
    raw = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ref"),
        F.when(key % 50 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date_text"),
        F.when(key % 70 == 0, "HOLD").when(F.col("l_returnflag") == "R", "sell").otherwise("BUY").alias("action"),
        F.when(key % 60 == 0, 0.5).otherwise(F.col("l_quantity")).alias("quantity"), F.when(key % 80 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(key % 90 == 0, " ").otherwise(mk.symbol_of("l_suppkey")).alias("instrument"))
    return lg.row_problems(raw).select("ref", "problem")


def normal_ledger(spark, folder):
    rows = trades(spark, folder).withColumns({"action": F.concat(F.lit(" "), F.lower("action")), "instrument": F.concat("instrument", F.lit(" "))})
    return lg.normalised(rows.withColumn("note", F.when(F.col("note") != "", F.col("note"))), "ref")


def fingerprints(spark, folder):
    rows = trades(spark, folder).withColumns({"units": F.col("quantity").cast("long"), "cents": F.round(F.col("price") * 100).cast("long")})
    return lg.fingerprint(rows, ["portfolio"], ["session", "instrument", "action", "ref", "note", "units", "cents"]).withColumn("digest", F.col("digest").cast("string"))


def market_frames(spark, folder):
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    return bars, cut_lineage(mk.numbered_calendar(bars))


def marks(rows, calendar):
    """Settlement marks: the mean option price on every second week; on the others none is published."""
    return (rows.where(lg.is_option() & (F.weekofyear("session") % 2 == 0)).groupBy("session", "instrument").agg(F.avg("price").alias("settle"))
            .join(calendar, "session").drop("session"))


def daily(spark, folder):
    bars, calendar = market_frames(spark, folder)
    rows = stored_trades(spark, folder)
    return lg.daily_values(rows, bars, calendar, mk.factor_levels(spark, folder, bars), marks(rows, calendar), PRINCIPAL)


def roll_counts(spark, folder):
    rows = trades(spark, folder).withColumn("o", text.option_parts("instrument")).where(F.col("o").isNotNull() & (F.col("action") == "BUY"))
    return lg.roll_count(rows.select("portfolio", "session", F.col("o.strike").alias("strike")))


def last_closes(bars):
    return bars.groupBy(F.col("symbol").alias("instrument")).agg(F.max_by("close", "session").alias("close"))


def stops(bars):
    """Stops set earlier: a share of the close of that day."""
    before = bars.where(F.col("session") <= F.lit(STOP_DAY).cast("date"))
    return before.groupBy(F.col("symbol").alias("instrument")).agg((F.max_by("close", "session") * STOP_SHARE).alias("stop"))


def positions_of(rows, bars):
    return lg.current_positions(rows, last_closes(bars), stops(bars))


def positions(spark, folder):
    return positions_of(recent(spark, folder), cut_lineage(mk.weekly_bars(spark, folder)))


def headline_of(spark, folder):
    bars, calendar = market_frames(spark, folder)
    rows = stored_trades(spark, folder)
    values = lg.daily_values(rows, bars, calendar, mk.factor_levels(spark, folder, bars), marks(rows, calendar), PRINCIPAL)
    return lg.headline(values, positions_of(rows, bars))


def headline(spark, folder):
    rows = headline_of(spark, folder)
    years = F.datediff("as_of", "snapshot") / F.lit(365.0)
    flows = F.array(F.struct(F.lit(0.0).alias("years"), F.lit(-PRINCIPAL).alias("amount")), F.struct(years.alias("years"), F.col("total").alias("amount")))
    return rows.withColumn("xirr_pct", F.when(F.col("days") >= 1, rk.rate_of_return(flows) * 100))


def money_weighted(spark, folder):
    """Rate of return of each ledger from all its dated flows and the final holdings."""
    bars, calendar = market_frames(spark, folder)
    rows = stored_trades(spark, folder)
    # one flow per session: bounded by the calendar
    flows = rows.groupBy("portfolio", "session").agg((-F.sum(lg.signed() * F.col("price"))).alias("amount"))
    last = daily(spark, folder).groupBy("portfolio").agg(F.max("session").alias("session"), F.max_by(F.col("stocks") + F.col("options"), "n").alias("amount"))
    both = flows.unionByName(last).groupBy("portfolio", "session").agg(F.sum("amount").alias("amount"))
    start = F.min("session").over(Window.partitionBy("portfolio"))
    dated = both.withColumn("years", F.datediff("session", start) / F.lit(365.0))
    listed = dated.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("years", "amount"))).alias("flows"))
    return listed.withColumn("xirr_pct", rk.rate_of_return(F.col("flows"), 60) * 100)


def opening_trades(spark, folder):
    """The ledger's first rows: whole shares of each weight at the first session on or after the start date."""
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    first = bars.where(F.col("session") >= F.lit(START).cast("date")).agg(F.min("session").alias("session"))
    rows = mk.books(bars).join(bars.join(first, "session", "left_semi").select("symbol", "session", "close"), "symbol")
    return rows.select("portfolio", "session", F.col("symbol").alias("instrument"), F.lit("BUY").alias("action"),
                       F.floor(F.col("weight") * PRINCIPAL * SLEEVE / F.col("close")).alias("quantity"), F.round("close", 2).alias("price"),
                       F.format_string("snapshot: %.2f%% of the equity sleeve at the close", F.col("weight") * 100).alias("note"))


def plan_of(spark, folder):
    """Replacement plan of every portfolio: stopped stocks and parked cash buy reserve stocks, else top up what rises."""
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    rows = cut_lineage(recent(spark, folder))
    held = cut_lineage(positions_of(rows, bars))
    sold = lg.sold_stocks(rows)
    ranked = sc.quality_score(mk.fundamentals(spark, folder), ["roce", "opm", "qtr_sales_yoy"], ["debt_to_equity"])
    # the reserve list: every symbol of enough conviction, best first
    reserve = with_positions(ranked.where(F.col("score") >= CONVICTION).withColumn("all", F.lit(1)), ["all"], "score", ["symbol"], "rank")
    reserve = cut_lineage(reserve)  # queue, plan and top-up read these tables several times each
    taken = held.select("portfolio", "instrument").unionByName(sold).distinct()
    parked_cash = lg.parked_proceeds(rows)
    sources = cut_lineage(lg.sources_of_cash(held, sold, parked_cash))
    queue = lg.reserve_queue(rows.select("portfolio").distinct(), reserve, taken, sources)
    value = held.join(sold, ["portfolio", "instrument"], "left_anti").groupBy("portfolio").agg(F.sum("value").alias("_v"))
    extra = parked_cash.groupBy("portfolio").agg(F.sum("parked").alias("_p"))
    cap = value.join(extra, "portfolio", "full_outer").select("portfolio", (0.35 * (F.coalesce("_v", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0)))).alias("cap"))
    rising = (held.where(~F.col("stop_breached")).join(sold, ["portfolio", "instrument"], "left_anti")
              .join(mk.books(bars).select(F.col("symbol").alias("instrument"), "weight"), "instrument"))
    # only holdings in an upward trend are topped up
    last = ind.last_oscillators(mk.by_symbol(spark, folder, bars))
    trend = last.where(F.col("plus_di") - F.col("minus_di") >= TREND_GAP).select(F.col("symbol").alias("instrument"))
    rising = cut_lineage(rising.join(trend, "instrument", "left_semi"))
    holdings = rising.join(cap, "portfolio").select("portfolio", F.col("instrument").alias("buy"), "weight", "value", "cap")
    return lg.replacement_plan(sources, queue, holdings, last_closes(bars)), bars


def replacement_plan(spark, folder):
    return plan_of(spark, folder)[0]


def replacement_trades(spark, folder):
    plan, bars = plan_of(spark, folder)
    fills = bars.groupBy(F.col("symbol").alias("instrument")).agg(F.max_by("open", "session").alias("fill"))
    return lg.plan_trades(cut_lineage(plan), fills)


def alerts(spark, folder):
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    return lg.alert_rows(headline_of(spark, folder), positions_of(recent(spark, folder), bars), replacement_plan(spark, folder))


def attribution_stocks_of(spark, folder):
    bars, calendar = market_frames(spark, folder)
    every = stored_trades(spark, folder)
    stock_trades = every.where(~lg.is_option())
    held = risk_plans.members(spark, folder)
    fx = risk_plans.factors(spark, folder).select("session", F.col("market_ret").alias("m"))
    cutoff = F.col("session") <= F.lit("2000-12-31").cast("date")
    betas = rk.latest_betas(held.where(cutoff), fx, "symbol").select(F.col("symbol").alias("instrument"), "beta")
    theme = rk.equal_weight_return(held).withColumn("all", F.lit(1)).withColumnRenamed("universe_ret", "ret")
    theme_beta = rk.latest_betas(theme.where(cutoff), fx, "all").select(F.col("beta").alias("_tb"))
    moves = (fx.join(theme, "session", "left").join(theme_beta).join(calendar, "session")
             .select("n", F.col("m").alias("market_ret"), F.coalesce(F.col("ret") - F.col("_tb") * F.col("m"), F.lit(0.0)).alias("theme_ret")))
    starts = every.groupBy("portfolio").agg(F.min("session").alias("start"))
    return lg.split_pnl(lg.holding_spans(stock_trades, calendar), lg.price_spans(bars, calendar), moves, betas, stock_trades, calendar, starts)


def attribution_stocks(spark, folder):
    rows = attribution_stocks_of(spark, folder)
    return rows.withColumn("return_pct", F.col("pnl") / F.nullif(F.col("invested"), F.lit(0.0)) * 100)


def attribution(spark, folder):
    values = daily(spark, folder)
    return lg.attribution(values, attribution_stocks_of(spark, folder), stored_trades(spark, folder).where(lg.is_option()), PRINCIPAL)


def value_paths(spark, folder):
    """Each book held from session 250 on at its own weights and at equal weights."""
    bars, calendar = market_frames(spark, folder)
    books = mk.books(bars)
    equal = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("portfolio"))
    name = F.col("portfolio").cast("string")
    both = books.select(F.concat(F.lit("own "), name).alias("timeline"), F.col("symbol").alias("instrument"), "weight").unionByName(
        books.select(F.concat(F.lit("equal "), name).alias("timeline"), F.col("symbol").alias("instrument"), equal.alias("weight")))
    return lg.value_paths(both, lg.filled_prices(bars, calendar), 250, PRINCIPAL, SLEEVE).join(calendar, "n")


def sector_allocation(spark, folder):
    """Value of the open positions by sector per portfolio, with cash and options from the last valuation."""
    rows = stored_trades(spark, folder)
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    held = positions_of(rows, bars).join(mk.listings(spark, folder).select(F.col("symbol").alias("instrument"), "sector"), "instrument")
    stocks = held.groupBy("portfolio", F.concat("sector", F.lit(" stocks")).alias("part")).agg(F.sum("value").alias("value"))
    head = headline_of(spark, folder)
    other = head.select("portfolio", F.inline(F.array(F.struct(F.lit("options").alias("part"), F.col("options").alias("value")),
                                                     F.struct(F.lit("cash").alias("part"), F.col("cash").alias("value")))))
    return stocks.unionByName(other)


def at_risk(spark, folder):
    """Quarterly risk-free hurdle and rupees at risk to the stops per portfolio."""
    rows = positions(spark, folder).groupBy("portfolio").agg(F.sum("at_risk").alias("at_risk"))
    return rows.withColumn("hurdle", F.lit(PRINCIPAL) * (F.pow(F.lit(1.0555), F.lit(0.25)) - 1))


def held_books(spark, folder):
    """One row per portfolio for the put rules: value, cash, held core put and the new put of the same expiry."""
    head = headline_of(spark, folder).select("portfolio", "pnl_pct", "stocks", "cash")
    base = option_plans.needs(spark, folder).select("portfolio", "underlying", F.col("down_ratio").alias("hedge_ratio")).join(head, "portfolio")
    chain = mk.option_chain(spark, folder).where((F.col("kind") == "PE") & (F.col("oi") > 0))
    spot = chain.groupBy("underlying").agg(F.max("spot").alias("spot"))
    core = option_plans.core_puts(spark, folder).select("portfolio", "underlying", "expiry", F.col("strike").alias("held_strike"), F.col("units").alias("held_units"))
    rows = base.join(spot, "underlying").join(core, ["portfolio", "underlying"], "left")
    now = chain.select("underlying", "expiry", F.col("strike").alias("held_strike"), F.col("settle").alias("held_price"))
    rows = rows.join(now, ["underlying", "expiry", "held_strike"], "left")
    fresh = op.liquid(chain, ["underlying", "expiry"]).groupBy("underlying", "expiry").agg(
        F.min_by(F.struct("strike", "settle"), F.struct(F.abs(F.col("strike") - F.col("spot") * 0.95), "strike")).alias("_n"))
    fresh = fresh.select("underlying", "expiry", F.col("_n.strike").alias("new_strike"), F.col("_n.settle").alias("new_price"))
    rolls = roll_counts(spark, folder)
    return rows.join(fresh, ["underlying", "expiry"], "left").join(rolls, "portfolio", "left").fillna(0, subset=["rolls"])


def roll_plan(spark, folder):
    return op.roll_plan(held_books(spark, folder), option_plans.LOT, TRIGGER, max_rolls=6)


def drift_plan(spark, folder):
    rolled = cut_lineage(roll_plan(spark, folder)).withColumnRenamed("status", "roll_status")
    return op.drift_plan(rolled.drop("cash_sufficient"), option_plans.LOT, band_lots=3.0)


def live_metrics(spark, folder):
    """Window metrics of the valued ledgers themselves, flows between stocks and cash included."""
    rows = daily(spark, folder)
    order = Window.partitionBy("portfolio").orderBy("n")
    moved = rows.select("portfolio", "session", *[(F.col(c) / F.lag(c).over(order) - 1).alias(n) for c, n in (("total", "p"), ("market_value", "m"), ("fund_value", "rf"))])
    return rk.window_metrics(moved.withColumn("period", F.lit("live")))


def horizon_moves(spark, folder):
    """Typical move of every symbol over 63 sessions, scaled to the 21 left."""
    from bartide.functions.numbers import horizon_scaled

    rows = ind.volatility(ind.session_returns(mk.weekly_bars(spark, folder)))
    full = rows.withColumn("move63", F.col("session_vol") * F.sqrt(F.lit(63.0)) * 100)
    return full.withColumn("move21", horizon_scaled("move63", F.lit(21)))


def watched(spark, folder):
    """Closes of a fixed list of symbols in its own display order."""
    listed = spark.createDataFrame([(mk_name, k + 1) for k, mk_name in enumerate(WATCHED)], "symbol string, place int")
    rows = last_closes(mk.weekly_bars(spark, folder)).withColumnRenamed("instrument", "symbol")
    return rows.join(listed, "symbol").join(mk.listings(spark, folder), "symbol").orderBy("place")


def hedged_var(spark, folder):
    """Value at risk of every book with and without the index position its open options stand for, side by side; a book whose
    legs can't all be priced has no hedged figures."""
    held = cut_lineage(risk_plans.positions(spark, folder).select("portfolio", "symbol", "session", "ret", "x"))
    base = held.select("portfolio", "symbol", "x").distinct().groupBy("portfolio").agg(F.sum("x").alias("value"))
    index = risk_plans.factors(spark, folder).select("session", F.col("large_ret").alias("ret"))
    deltas = option_plans.delta_positions(spark, folder).where(F.col("delta_inr").isNotNull()).select("portfolio", F.col("delta_inr").alias("x"))
    hedge = held.select("portfolio", "session").distinct().join(index, "session").join(deltas, "portfolio").withColumn("symbol", F.lit("INDEX"))
    plain = rk.value_at_risk(rk.complete_sessions(held, 200), 12, base)
    priced = held.join(deltas.select("portfolio"), "portfolio", "left_semi")
    hedged = rk.value_at_risk(rk.complete_sessions(priced.unionByName(hedge.select(priced.columns)), 200), 12, base)
    names = ["parametric_95", "historical_95", "cvar_95"]
    return plain.select("portfolio", *names).join(hedged.select("portfolio", *[F.col(c).alias(f"{c}_hedged") for c in names]), "portfolio", "left")


# ---- the same in SQL ----
define("tr", """
SELECT t.*, c.n, CASE WHEN action = 'BUY' THEN quantity ELSE -quantity END AS q, instrument LIKE 'INDEX %' AS opt FROM trades t JOIN cal c ON c.session = t.session""")
define("flows", "SELECT portfolio, instrument, opt, n, sum(q) AS flow FROM tr GROUP BY ALL")
define("hpath", """
SELECT s.portfolio, s.instrument, s.opt, c.n, sum(coalesce(f.flow, 0)) OVER (PARTITION BY s.portfolio, s.instrument ORDER BY c.n) AS quantity
FROM (SELECT portfolio, instrument, opt, min(n) AS lo FROM flows GROUP BY ALL) s JOIN cal c ON c.n >= s.lo LEFT JOIN flows f ON f.portfolio = s.portfolio AND f.instrument = s.instrument AND f.n = c.n""")
define("px", """
SELECT s.symbol AS instrument, c.n, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
FROM (SELECT symbol, min(n) AS lo FROM numbered GROUP BY 1) s JOIN cal c ON c.n >= s.lo LEFT JOIN numbered b ON b.symbol = s.symbol AND b.n = c.n""")
define("opt_marks", "SELECT n, instrument, avg(price) AS settle FROM tr WHERE opt AND weekofyear(session) % 2 = 0 GROUP BY 1, 2")
define("opt_value", """
SELECT portfolio, n, sum(quantity * coalesce(mark, first_price)) AS options FROM (SELECT h.portfolio, h.n, h.quantity, f.first_price,
  last_value(CASE WHEN h.quantity <> 0 THEN m.settle END IGNORE NULLS) OVER (PARTITION BY h.portfolio, h.instrument ORDER BY h.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark
FROM hpath h LEFT JOIN opt_marks m ON m.instrument = h.instrument AND m.n = h.n JOIN (SELECT portfolio, instrument, arg_min(price, (session, ref)) AS first_price FROM tr GROUP BY 1, 2) f ON f.portfolio = h.portfolio AND f.instrument = h.instrument
WHERE h.opt) GROUP BY 1, 2""")
define("book_days", """
SELECT s.portfolio, c.n, c.session, f.rate, f.market, coalesce(sp.spent, 0) AS spent, s.lo FROM (SELECT portfolio, min(n) AS lo FROM tr GROUP BY 1) s JOIN cal c ON c.n >= s.lo JOIN factors f ON f.session = c.session
LEFT JOIN (SELECT portfolio, n, sum(q * price) AS spent FROM tr GROUP BY 1, 2) sp ON sp.portfolio = s.portfolio AND sp.n = c.n""")
define("cash_path", """
SELECT portfolio, n, rate, 1e7 - spent AS cash FROM book_days WHERE n = lo
UNION ALL SELECT d.portfolio, d.n, d.rate, c.cash * d.rate / c.rate - d.spent FROM cash_path c JOIN book_days d ON d.portfolio = c.portfolio AND d.n = c.n + 1""")
define("daily", """
SELECT *, stocks + options + cash AS total, stocks + options + cash - 1e7 AS pnl, ((stocks + options + cash) / 1e7 - 1) * 100 AS pnl_pct FROM (
SELECT d.portfolio, d.n, d.session, coalesce(s.v, 0) AS stocks, coalesce(o.options, 0) AS options, c.cash, 1e7 * d.market / first_value(d.market) OVER w AS market_value, 1e7 * d.rate / first_value(d.rate) OVER w AS fund_value
FROM book_days d JOIN cash_path c ON c.portfolio = d.portfolio AND c.n = d.n LEFT JOIN (SELECT h.portfolio, h.n, sum(h.quantity * p.price) AS v FROM hpath h JOIN px p ON p.instrument = h.instrument AND p.n = h.n WHERE NOT h.opt GROUP BY 1, 2) s
  ON s.portfolio = d.portfolio AND s.n = d.n LEFT JOIN opt_value o ON o.portfolio = d.portfolio AND o.n = d.n WINDOW w AS (PARTITION BY d.portfolio ORDER BY d.n))""")
define("last_close", "SELECT symbol AS instrument, arg_max(close, session) AS close, arg_max(open, session) AS fill FROM bars GROUP BY 1")
define("stop_rows", f"SELECT symbol AS instrument, arg_max(close, session) * {STOP_SHARE} AS stop FROM bars WHERE session <= DATE '{STOP_DAY}' GROUP BY 1")


def positions_sql(source: str) -> str:
    return f"""SELECT *, shares * close AS value, shares * (close - avg_cost) AS pnl, (close / avg_cost - 1) * 100 AS pnl_pct, greatest(close - stop, 0) * shares AS at_risk, coalesce(close <= stop, false) AS stop_breached,
  coalesce(stop < close AND close <= stop * 1.03, false) AS near_stop, (close / stop - 1) * 100 AS above_stop_pct FROM (
SELECT t.*, c.close, s.stop FROM (SELECT portfolio, instrument, sum(q) AS shares, sum(quantity * price) FILTER (action = 'BUY') / sum(quantity) FILTER (action = 'BUY') AS avg_cost, min(session) FILTER (action = 'BUY') AS first_buy,
  max(session) FILTER (action = 'SELL') AS last_sell FROM {source} WHERE NOT opt GROUP BY 1, 2 HAVING sum(q) > 0) t JOIN last_close c ON c.instrument = t.instrument LEFT JOIN stop_rows s ON s.instrument = t.instrument)"""


define("rtr", f"SELECT * FROM tr WHERE session >= DATE '{START}'")
define("open_pos", positions_sql("tr"))
define("recent_pos", positions_sql("rtr"))
define("head", """
SELECT e.*, s.at_risk, coalesce(s.breached, '') AS breached, coalesce(s.near, '') AS near, s.best, s.worst, e.as_of - e.snapshot AS days, total - market_value AS vs_market, total - fund_value AS vs_fund FROM (
SELECT portfolio, min(session) AS snapshot, max(session) AS as_of, """ + ", ".join(f"arg_max({c}, n) AS {c}" for c in ("total", "pnl", "pnl_pct", "market_value", "fund_value", "stocks", "options", "cash")) + """ FROM daily GROUP BY 1) e
LEFT JOIN (SELECT portfolio, sum(at_risk) AS at_risk, string_agg(instrument, ', ' ORDER BY instrument) FILTER (stop_breached) AS breached, string_agg(instrument, ', ' ORDER BY instrument) FILTER (near_stop) AS near,
  arg_max(instrument, (pnl_pct, instrument)) AS best, arg_min(instrument, (pnl_pct, instrument)) AS worst FROM open_pos GROUP BY 1) s ON s.portfolio = e.portfolio""")
define("sold", "SELECT DISTINCT portfolio, instrument FROM rtr WHERE action = 'SELL' AND NOT opt")


def parked_sql(source: str) -> str:
    return f"""SELECT portfolio, instrument, sum(quantity * price) AS parked FROM {source} t WHERE action = 'SELL' AND contains(note, 'proceeds parked in the liquid ETF')
  AND NOT EXISTS (SELECT 1 FROM {source} r WHERE r.portfolio = t.portfolio AND contains(r.note, 'redeploys ' || t.instrument || '''s parked proceeds')) GROUP BY 1, 2"""


define("parked_now", parked_sql("rtr"))
define("reserve_list", """
SELECT symbol, row_number() OVER (ORDER BY score DESC, symbol) AS rk FROM (SELECT symbol, (coalesce(a, 0.5) + coalesce(b, 0.5) + coalesce(c, 0.5) + coalesce(d, 0.5)) / 4 AS score FROM (SELECT symbol, """
       + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {o}{c} NULLS LAST) + (count({c}) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END AS {a}"
                   for c, a, o in (("roce", "a", ""), ("opm", "b", ""), ("qtr_sales_yoy", "c", ""), ("debt_to_equity", "d", "-")))
       + f" FROM fund)) WHERE score >= {CONVICTION}")
define("cash_sources", """
SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY source DESC, sell) AS k FROM (
SELECT portfolio, instrument AS sell, 'stop' AS source, value AS proceeds, shares, close, stop FROM recent_pos p WHERE stop_breached AND NOT EXISTS (SELECT 1 FROM sold s WHERE s.portfolio = p.portfolio AND s.instrument = p.instrument)
UNION ALL SELECT portfolio, instrument, 'parked', parked, 0, NULL, NULL FROM parked_now)""")
define("rqueue", """
SELECT p.portfolio, r.symbol AS buy, r.rk AS buy_rank, row_number() OVER (PARTITION BY p.portfolio ORDER BY r.rk) AS k FROM (SELECT DISTINCT portfolio FROM rtr) p CROSS JOIN reserve_list r
WHERE NOT EXISTS (SELECT 1 FROM sold s WHERE s.portfolio = p.portfolio AND s.instrument = r.symbol) AND NOT EXISTS (SELECT 1 FROM recent_pos h WHERE h.portfolio = p.portfolio AND h.instrument = r.symbol)""")
define("caps", """
SELECT p.portfolio, 0.35 * (coalesce(v.v, 0) + coalesce(k.v, 0)) AS cap FROM (SELECT DISTINCT portfolio FROM rtr) p LEFT JOIN (SELECT h.portfolio, sum(value) AS v FROM recent_pos h ANTI JOIN sold s ON s.portfolio = h.portfolio AND s.instrument = h.instrument GROUP BY 1) v
ON v.portfolio = p.portfolio LEFT JOIN (SELECT portfolio, sum(parked) AS v FROM parked_now GROUP BY 1) k ON k.portfolio = p.portfolio""")
define("risers", """
SELECT h.portfolio, h.instrument AS buy, b.weight, greatest(c.cap - h.value, 0) AS room FROM recent_pos h JOIN books b ON b.symbol = h.instrument JOIN caps c ON c.portfolio = h.portfolio
ANTI JOIN sold s ON s.portfolio = h.portfolio AND s.instrument = h.instrument WHERE NOT h.stop_breached
AND h.instrument IN (SELECT symbol FROM tech WHERE rn = total AND plus_di - minus_di >= 2.0)""")
define("open_cash", """
SELECT *, sum(proceeds) OVER (PARTITION BY portfolio ORDER BY k) AS hi FROM (SELECT s.* FROM cash_sources s LEFT JOIN rqueue q ON q.portfolio = s.portfolio AND q.k = s.k WHERE q.buy IS NULL)""")
# water level by bisection on the sum of min(room, level x weight): independent of the sorted form
define("water", """
SELECT portfolio, k, which, total, 0.0::DOUBLE AS lo, 1e12::DOUBLE AS hi, 0 AS step FROM (SELECT portfolio, k, 'to' AS which, hi AS total FROM open_cash UNION ALL SELECT portfolio, k, 'from', hi - proceeds FROM open_cash)
UNION ALL SELECT w.portfolio, w.k, w.which, w.total, CASE WHEN f.filled < w.total THEN (w.lo + w.hi) / 2 ELSE w.lo END, CASE WHEN f.filled < w.total THEN w.hi ELSE (w.lo + w.hi) / 2 END, w.step + 1
FROM water w JOIN LATERAL (SELECT sum(least(r.room, (w.lo + w.hi) / 2 * r.weight)) AS filled FROM risers r WHERE r.portfolio = w.portfolio) f ON true WHERE w.step < 100""")
define("topups", """
SELECT portfolio, sell, buy, amount / proceeds AS alloc FROM (SELECT c.portfolio, c.sell, c.proceeds, r.buy, least(r.room, t.hi * r.weight) - least(r.room, f.hi * r.weight) AS amount FROM open_cash c
JOIN water t ON t.portfolio = c.portfolio AND t.k = c.k AND t.which = 'to' AND t.step = 100 JOIN water f ON f.portfolio = c.portfolio AND f.k = c.k AND f.which = 'from' AND f.step = 100 JOIN risers r ON r.portfolio = c.portfolio) WHERE amount > 1e-3""")
define("rplan", """
SELECT *, proceeds - sum(buy_inr) OVER (PARTITION BY portfolio, sell) AS cash_left FROM (SELECT p.*, c.close AS buy_close, coalesce(floor(proceeds * alloc / c.close), 0) AS buy_shares, coalesce(floor(proceeds * alloc / c.close) * c.close, 0) AS buy_inr FROM (
SELECT s.portfolio, s.sell, s.source, s.proceeds, s.shares, s.close, s.stop, 'reserve' AS kind, q.buy, q.buy_rank, 1.0::DOUBLE AS alloc FROM cash_sources s JOIN rqueue q ON q.portfolio = s.portfolio AND q.k = s.k
UNION ALL SELECT s.portfolio, s.sell, s.source, s.proceeds, s.shares, s.close, s.stop, CASE WHEN t.buy IS NULL THEN 'parked' ELSE 'top-up' END, t.buy, NULL, coalesce(t.alloc, 0) FROM open_cash s LEFT JOIN topups t ON t.portfolio = s.portfolio AND t.sell = s.sell
WHERE t.buy IS NOT NULL OR s.source = 'stop') p LEFT JOIN last_close c ON c.instrument = p.buy)""")
define("theme_days", "SELECT session, avg(ret) AS ret FROM rets GROUP BY 1")
define("stock_beta", """
SELECT symbol, CASE WHEN count(*) > 20 THEN covar_samp(ret, m) / var_samp(m) END AS beta FROM (SELECT r.symbol, r.ret, f.market_ret AS m FROM rets r JOIN fx f ON f.session = r.session WHERE r.session <= DATE '2000-12-31'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r.session DESC) <= 245) GROUP BY 1""")
define("theme_beta", """
SELECT covar_samp(ret, m) / var_samp(m) AS tb FROM (SELECT t.ret, f.market_ret AS m FROM theme_days t JOIN fx f ON f.session = t.session WHERE t.session <= DATE '2000-12-31' QUALIFY row_number() OVER (ORDER BY t.session DESC) <= 245)""")
define("book_moves", """
SELECT c.n, f.market_ret, coalesce(t.ret - b.tb * f.market_ret, 0) AS theme_ret FROM fx f JOIN cal c ON c.session = f.session LEFT JOIN theme_days t ON t.session = f.session CROSS JOIN theme_beta b""")
define("attr", """
SELECT *, pnl - market_part AS specific_part, pnl - market_part - theme_part AS picks_part FROM (SELECT i.portfolio, i.instrument, i.invested, coalesce(p.pnl, 0) + coalesce(f.fill, 0) AS pnl, coalesce(p.market_part, 0) AS market_part, coalesce(p.theme_part, 0) AS theme_part FROM (
SELECT portfolio, instrument, coalesce(sum(quantity * price) FILTER (action = 'BUY'), 0) AS invested FROM tr WHERE NOT opt GROUP BY 1, 2) i LEFT JOIN (
SELECT h.portfolio, h.instrument, sum(h.quantity * (p1.price - p0.price)) AS pnl, coalesce(sum(h.quantity * p0.price * m.market_ret * b.beta), 0) AS market_part, sum(h.quantity * p0.price * m.theme_ret) AS theme_part
FROM hpath h JOIN px p0 ON p0.instrument = h.instrument AND p0.n = h.n JOIN px p1 ON p1.instrument = h.instrument AND p1.n = h.n + 1 JOIN book_moves m ON m.n = h.n + 1 LEFT JOIN stock_beta b ON b.symbol = h.instrument WHERE NOT h.opt GROUP BY 1, 2) p
  ON p.portfolio = i.portfolio AND p.instrument = i.instrument LEFT JOIN (SELECT t.portfolio, t.instrument, sum(t.q * (p.price - t.price)) AS fill FROM tr t JOIN px p ON p.instrument = t.instrument AND p.n = t.n
  JOIN (SELECT portfolio, min(n) AS lo FROM tr GROUP BY 1) s ON s.portfolio = t.portfolio WHERE NOT t.opt AND t.n > s.lo GROUP BY 1, 2) f ON f.portfolio = i.portfolio AND f.instrument = i.instrument)""")
define("roll_counts", """
SELECT portfolio, count(*) FILTER (top > prev) AS rolls FROM (SELECT portfolio, top, max(top) OVER (PARTITION BY portfolio ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
FROM (SELECT portfolio, session, max(CAST(split_part(instrument, ' ', 3) AS DOUBLE)) AS top FROM tr WHERE opt AND action = 'BUY' GROUP BY 1, 2)) GROUP BY 1""")
define("put_side", "SELECT * FROM chain WHERE kind = 'PE' AND oi > 0")
define("hbooks", """
SELECT b.*, pr.settle AS held_price, nw.strike AS new_strike, nw.settle AS new_price, coalesce(r.rolls, 0) AS rolls FROM (SELECT n.portfolio, n.underlying, n.down_ratio AS hedge_ratio, h.pnl_pct, h.stocks, h.cash, s.spot, k.expiry, k.strike AS held_strike, k.units AS held_units
FROM needs n JOIN head h ON h.portfolio = n.portfolio JOIN (SELECT underlying, max(spot) AS spot FROM put_side GROUP BY 1) s ON s.underlying = n.underlying LEFT JOIN core k ON k.portfolio = n.portfolio AND k.underlying = n.underlying) b
LEFT JOIN put_side pr ON pr.underlying = b.underlying AND pr.expiry = b.expiry AND pr.strike = b.held_strike
LEFT JOIN (SELECT p.* FROM put_side p JOIN (SELECT underlying, expiry, quantile_cont(oi, 0.5) AS mid FROM put_side GROUP BY 1, 2) m ON m.underlying = p.underlying AND m.expiry = p.expiry WHERE p.oi >= m.mid
  QUALIFY row_number() OVER (PARTITION BY p.underlying, p.expiry ORDER BY abs(p.strike - p.spot * 0.95), p.strike) = 1) nw ON nw.underlying = b.underlying AND nw.expiry = b.expiry
LEFT JOIN roll_counts r ON r.portfolio = b.portfolio""")
define("rolled", f"""
SELECT *, CASE WHEN status = 'waiting' THEN {TRIGGER} - pnl_pct END AS gap_pp, buy_cost - sell_value AS net_cost, cash >= buy_cost - sell_value AS cash_sufficient FROM (SELECT *,
  CASE WHEN status IN ('TRIGGERED', 'covered') THEN CASE WHEN higher THEN coalesce(held_units, 0) * coalesce(held_price, 0) ELSE 0 END END AS sell_value,
  CASE WHEN status IN ('TRIGGERED', 'covered') THEN CASE WHEN higher THEN lots * 50 * new_price ELSE greatest(extra, 0) * held_price END END AS buy_cost,
  CASE WHEN status = 'TRIGGERED' THEN printf('BUY %.0f INDEX %s %.0f PE @ %.2f', CAST(CASE WHEN higher THEN lots * 50 ELSE extra END AS DOUBLE), CAST(expiry AS VARCHAR), CASE WHEN higher THEN new_strike ELSE held_strike END, CASE WHEN higher THEN new_price ELSE held_price END) END AS trade
FROM (SELECT *, CASE WHEN rolls >= 6 THEN 'done' WHEN pnl_pct < {TRIGGER} THEN 'waiting' WHEN new_strike IS NULL THEN 'no prices' WHEN higher OR extra > 0 THEN 'TRIGGERED' ELSE 'covered' END AS status
FROM (SELECT *, lots * 50 - coalesce(held_units, 0) AS extra, new_strike > coalesce(held_strike, 0) AS higher FROM (SELECT *, greatest(1, round_even(hedge_ratio * stocks / (spot * 50), 0)) AS lots FROM hbooks))))""")

define("book_delta", "SELECT portfolio, CASE WHEN count(iv) = count(*) THEN sum(units * delta * spot) END AS delta_inr FROM legs_g GROUP BY 1")
define("hpos", """
SELECT portfolio, symbol, session, ret, x FROM pos SEMI JOIN (SELECT portfolio FROM book_delta WHERE delta_inr IS NOT NULL) d USING (portfolio)
UNION ALL SELECT s.portfolio, 'INDEX', s.session, f.large_ret, d.delta_inr FROM (SELECT DISTINCT portfolio, session FROM pos) s JOIN fx f ON f.session = s.session JOIN book_delta d ON d.portfolio = s.portfolio WHERE d.delta_inr IS NOT NULL""")

QUERIES = [
    Query("hedged_value_at_risk", "R22", "portfolio:i parametric_95:2 historical_95:2 cvar_95:2 parametric_95_hedged:2 historical_95_hedged:2 cvar_95_hedged:2", hedged_var, with_tables(
        f"SELECT a.portfolio, a.parametric_95, a.historical_95, a.cvar_95, b.parametric_95 AS parametric_95_hedged, b.historical_95 AS historical_95_hedged, b.cvar_95 AS cvar_95_hedged FROM ({var_sql('var_days', 'var_parts', VALUE_SQL)}) a LEFT JOIN ({var_sql('hvar_days', 'hvar_parts', VALUE_SQL)}) b ON b.portfolio = a.portfolio")),
    Query("net_positions", "L1 G2", "portfolio:i instrument:s net:2 state:s", net_positions, with_tables("""
SELECT portfolio, instrument, net, CASE WHEN instrument LIKE 'INDEX %' THEN 'option' WHEN net > 0 THEN 'held' ELSE 'short' END AS state FROM (SELECT portfolio, instrument, sum(q) AS net FROM tr GROUP BY 1, 2) WHERE net <> 0""")),
    Query("oversold_stocks", "F15", "portfolio:i instrument:s net:2", oversold, with_tables("SELECT portfolio, instrument, sum(q) AS net FROM tr WHERE NOT opt GROUP BY 1, 2 HAVING sum(q) < 0")),
    Query("parked_proceeds", "L1 X4", "portfolio:i instrument:s parked:2", parked, with_tables(parked_sql("tr"))),
    Query("option_instruments", "X1", "ref:s expiry:d strike:2 kind:s", instrument_parts, with_tables("""
SELECT ref, split_part(instrument, ' ', 2) AS expiry, CAST(split_part(instrument, ' ', 3) AS DOUBLE) AS strike, split_part(instrument, ' ', 4) AS kind FROM tr WHERE opt""")),
    Query("trade_sentences", "X2", "ref:s action:s quantity:i instrument:s price:2", trade_sentences, with_tables("SELECT ref, action, quantity, instrument, round(price, 2) AS price FROM tr")),
    Query("grouped_amounts", "X6", "orderkey:i amount:s", grouped_amounts, """
SELECT o_orderkey AS orderkey, regexp_replace(CASE WHEN length(t) > 3 THEN reverse(regexp_replace(reverse(left(t, length(t) - 3)), '(..)', '\\1,', 'g')) || ',' || right(t, 3) ELSE t END, '^,', '') AS amount
FROM (SELECT o_orderkey, CAST(CAST(round_even(o_totalprice * 1000, 0) AS BIGINT) AS VARCHAR) AS t FROM orders)"""),
    Query("ledger_problems", "F15", "ref:s problem:s", problems, """
SELECT ref, unnest(list_filter([CASE WHEN k % 50 = 0 THEN 'bad_date' END, CASE WHEN k % 70 = 0 THEN 'bad_action' END, CASE WHEN k % 60 = 0 THEN 'bad_quantity' END,
  CASE WHEN k % 80 = 0 THEN 'bad_price' END, CASE WHEN k % 90 = 0 THEN 'no_instrument' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT l_orderkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref FROM lineitem WHERE l_linenumber = 1)"""),
    Query("normalised_ledger", "F16", "portfolio:i line:i session:d instrument:s action:s quantity:i note:s", normal_ledger, with_tables(
        "SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY session, ref) AS line FROM tr")),
    Query("ledger_fingerprints", "X23", "portfolio:i rows:i digest:s", fingerprints, with_tables("""
SELECT portfolio, count(*) AS rows, sum(CAST(CAST('0x' || left(sha1(concat_ws('|', CAST(session AS VARCHAR), instrument, action, ref, note, CAST(CAST(quantity AS BIGINT) AS VARCHAR), CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR))), 15) AS BIGINT) AS HUGEINT)) AS digest FROM tr GROUP BY 1""")),
    Query("roll_counts", "W17", "portfolio:i rolls:i", roll_counts, with_tables("SELECT * FROM roll_counts")),
    Query("daily_values", "L2 J5 W5", "portfolio:i session:d stocks:2 options:2 cash:2 total:2 pnl:2 pnl_pct:4 market_value:2 fund_value:2", daily, with_tables("SELECT * FROM daily")),
    Query("current_positions", "L3 G23 J7", "portfolio:i instrument:s shares:2 avg_cost:4 close:4 value:2 pnl:2 pnl_pct:4 stop:4 at_risk:2 stop_breached:b near_stop:b above_stop_pct:4 first_buy:d last_sell:d", positions, with_tables("SELECT * FROM recent_pos")),
    Query("portfolio_headline", "L4 G24", "portfolio:i snapshot:d as_of:d days:i total:2 pnl:2 pnl_pct:4 vs_market:2 vs_fund:2 xirr_pct:4 stocks:2 options:2 cash:2 at_risk:2 breached:s near:s best:s worst:s", headline, with_tables(
        "SELECT *, (pow(total / 1e7, 365.0 / days) - 1) * 100 AS xirr_pct FROM head")),
    Query("money_weighted_returns", "X15", "portfolio:i xirr_pct:3", money_weighted, with_tables("""
SELECT portfolio, (lo + hi) / 2 * 100 AS xirr_pct FROM bisect WHERE step = 60 UNION ALL SELECT portfolio, NULL FROM listed_flows WHERE NOT ok""",
        dated="""SELECT portfolio, session, sum(amount) AS amount FROM (SELECT portfolio, session, -sum(q * price) AS amount FROM tr GROUP BY 1, 2 UNION ALL
          SELECT portfolio, max(session), arg_max(stocks + options, n) FROM daily GROUP BY 1) GROUP BY 1, 2""",
        listed_flows="""SELECT *, list_sum(list_transform(fl, lambda f: f.amount / pow(1 - 0.9999, f.years))) * list_sum(list_transform(fl, lambda f: f.amount / pow(101.0, f.years))) <= 0 AS ok FROM (
          SELECT portfolio, list({'years': (session - lo) / 365.0::DOUBLE, 'amount': amount} ORDER BY session) AS fl FROM (SELECT *, min(session) OVER (PARTITION BY portfolio) AS lo FROM dated) GROUP BY 1)""",
        bisect="""SELECT portfolio, fl, -0.9999::DOUBLE AS lo, 100.0::DOUBLE AS hi, list_sum(list_transform(fl, lambda f: f.amount / pow(1 - 0.9999, f.years))) AS at_lo, 0 AS step FROM listed_flows WHERE ok
          UNION ALL SELECT portfolio, fl, CASE WHEN at_lo * v <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN at_lo * v <= 0 THEN (lo + hi) / 2 ELSE hi END, CASE WHEN at_lo * v <= 0 THEN at_lo ELSE v END, step + 1
          FROM (SELECT *, list_sum(list_transform(fl, lambda f: f.amount / pow(1 + (lo + hi) / 2, f.years))) AS v FROM bisect WHERE step < 60)""")),
    Query("opening_trades", "L5 L13 X16", "portfolio:i session:d instrument:s action:s quantity:i price:2 note:s", opening_trades, with_tables(f"""
SELECT b.portfolio, r.session, b.symbol AS instrument, 'BUY' AS action, floor(b.weight * {PRINCIPAL} * {SLEEVE} / r.close) AS quantity, round(r.close, 2) AS price, printf('snapshot: %.2f%% of the equity sleeve at the close', b.weight * 100) AS note
FROM books b JOIN bars r ON r.symbol = b.symbol WHERE r.session = (SELECT min(session) FROM bars WHERE session >= DATE '{START}')""")),
    Query("replacement_plan", "L6 L7", "portfolio:i sell:s source:s proceeds:2 kind:s buy:s buy_rank:i alloc:6 buy_close:4 buy_shares:i buy_inr:2 cash_left:2", replacement_plan, with_tables("SELECT * FROM rplan")),
    Query("replacement_trades", "L8", "portfolio:i instrument:s action:s quantity:i price:2 note:s", replacement_trades, with_tables("""
SELECT DISTINCT portfolio, sell AS instrument, 'SELL' AS action, shares AS quantity, round(sell_px, 2) AS price, printf('sold under its stop of %.2f', stop) || CASE WHEN kind = 'parked' THEN '; proceeds parked in the liquid ETF' ELSE '' END AS note FROM filled WHERE source = 'stop'
UNION ALL SELECT portfolio, buy, 'BUY', floor(got * alloc / buy_px), round(buy_px, 2), CASE WHEN source = 'parked' THEN 'redeploys ' || sell || '''s parked proceeds: ' ELSE '' END || CASE WHEN kind = 'reserve' THEN 'for ' || sell || ', place ' || buy_rank || ' of the reserve list'
  ELSE 'adds to the holding from the sale of ' || sell || '; reserve list used up' END FROM filled WHERE floor(got * alloc / buy_px) > 0""",
        filled="""SELECT p.*, coalesce(s.fill, p.close) AS sell_px, coalesce(b.fill, p.buy_close) AS buy_px, CASE WHEN p.source = 'parked' THEN p.proceeds ELSE p.shares * coalesce(s.fill, p.close) END AS got
          FROM rplan p LEFT JOIN last_close s ON s.instrument = p.sell LEFT JOIN last_close b ON b.instrument = p.buy""")),
    Query("alert_rows", "L12", "portfolio:i kind:s subject:s detail:s", alerts, with_tables("""
SELECT portfolio, CASE WHEN max(source) = 'parked' THEN 'redeploy' ELSE 'stop hit' END AS kind, sell AS subject, max(kind) AS detail FROM rplan GROUP BY portfolio, sell
UNION ALL SELECT portfolio, 'near stop', instrument, printf('%.1f', above_stop_pct) FROM recent_pos WHERE near_stop
UNION ALL SELECT portfolio, 'best', best, '' FROM head WHERE best IS NOT NULL UNION ALL SELECT portfolio, 'worst', worst, '' FROM head WHERE worst IS NOT NULL""")),
    Query("attribution_stocks", "L9 G3", "portfolio:i instrument:s invested:2 pnl:2 market_part:2 theme_part:2 specific_part:2 picks_part:2 return_pct:4", attribution_stocks, with_tables(
        "SELECT *, CASE WHEN invested <> 0 THEN pnl / invested * 100 END AS return_pct FROM attr")),
    Query("attribution_summary", "L10", "portfolio:i total_pnl:2 benchmark_pnl:2 gap:2 exposure:2 selection:2 theme:2 picks:2 hedge:2 cash:2", attribution, with_tables("""
SELECT *, total_pnl - benchmark_pnl AS gap, mp - benchmark_pnl AS exposure, total_pnl - sp - hedge AS cash FROM (SELECT d.portfolio, d.total - 1e7 AS total_pnl, d.market_value - 1e7 AS benchmark_pnl, a.sp, a.mp, a.selection, a.theme, a.picks, coalesce(o.premium, 0) + d.options AS hedge
FROM (SELECT portfolio, arg_max(total, n) AS total, arg_max(market_value, n) AS market_value, arg_max(options, n) AS options FROM daily GROUP BY 1) d
JOIN (SELECT portfolio, sum(pnl) AS sp, sum(market_part) AS mp, sum(specific_part) AS selection, sum(theme_part) AS theme, sum(picks_part) AS picks FROM attr GROUP BY 1) a ON a.portfolio = d.portfolio
LEFT JOIN (SELECT portfolio, -sum(q * price) AS premium FROM tr WHERE opt GROUP BY 1) o ON o.portfolio = d.portfolio)""")),
    Query("timeline_values", "L11", "timeline:s session:d value:2", value_paths, with_tables(f"""
SELECT h.timeline, c.session, sum(h.shares * p.price) + any_value(k.cash) AS value FROM h JOIN px p ON p.instrument = h.symbol AND p.n >= 250 JOIN cal c ON c.n = p.n JOIN (SELECT timeline, {PRINCIPAL} - sum(shares * entry) AS cash FROM h GROUP BY 1) k ON k.timeline = h.timeline GROUP BY 1, 2""",
        h=f"""SELECT w.timeline, w.symbol, p.price AS entry, floor(w.weight * {PRINCIPAL} * {SLEEVE} / p.price) AS shares FROM (SELECT 'own ' || portfolio AS timeline, symbol, weight FROM books UNION ALL
          SELECT 'equal ' || portfolio, symbol, 1.0 / count(*) OVER (PARTITION BY portfolio) FROM books) w JOIN px p ON p.instrument = w.symbol AND p.n = 250""")),
    Query("sector_allocation", "G21", "portfolio:i part:s value:2", sector_allocation, with_tables("""
SELECT portfolio, sector || ' stocks' AS part, sum(value) AS value FROM open_pos p JOIN listed l ON l.symbol = p.instrument GROUP BY 1, 2 UNION ALL SELECT portfolio, 'options', options FROM head UNION ALL SELECT portfolio, 'cash', cash FROM head""")),
    Query("at_risk_to_stops", "G26 X10", "portfolio:i at_risk:2 hurdle:2", at_risk, with_tables("SELECT portfolio, sum(at_risk) AS at_risk, 1e7 * (pow(1.0555, 0.25) - 1) AS hurdle FROM recent_pos GROUP BY 1")),
    Query("live_metrics", "R17", "portfolio:i sessions:i return_pct:4 benchmark_pct:4 sharpe:4 jensen_pct:4 max_drawdown:6 up_capture:4 tracking_error:6", live_metrics, with_tables(
        PERF_SQL.replace("perf_windows", "live_windows"), live_windows="""
SELECT * FROM (SELECT portfolio, 'live' AS win, session, total / lag(total) OVER w - 1 AS p, market_value / lag(market_value) OVER w - 1 AS m, fund_value / lag(fund_value) OVER w - 1 AS rf FROM daily WINDOW w AS (PARTITION BY portfolio ORDER BY n)) WHERE p IS NOT NULL""")),
    Query("horizon_moves", "G27", "symbol:s move63:5 move21:5", horizon_moves, with_tables("""
SELECT symbol, stddev_samp(ret) * sqrt(63.0) * 100 AS move63, stddev_samp(ret) * sqrt(21.0) * 100 AS move21 FROM (SELECT symbol, close / prev_close - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars WHERE prev_close > 0)
WHERE k <= 252 GROUP BY 1""")),
    Query("watch_list", "F19 J3", "place:i symbol:s company:s sector:s close:4", watched, with_tables(
        "SELECT w.place, w.symbol, l.company, l.sector, c.close FROM (VALUES " + ", ".join(f"('{s}', {k + 1})" for k, s in enumerate(WATCHED))
        + ") AS w(symbol, place) JOIN last_close c ON c.instrument = w.symbol JOIN listed l ON l.symbol = w.symbol")),
    Query("put_roll_plan", "H10", "portfolio:i status:s lots:i rolls:i gap_pp:4 sell_value:2 buy_cost:2 net_cost:2 trade:s cash_sufficient:b", roll_plan, with_tables("SELECT * FROM rolled")),
    Query("hedge_drift_plan", "H11", "portfolio:i status:s lots_held:4 lots_needed:4 change:i trade_value:2 cash_sufficient:b", drift_plan, with_tables("""
SELECT portfolio, status, lots_held, lots_needed, change, abs(change) * held_price AS trade_value, (change <= 0) OR (cash >= abs(change) * held_price) AS cash_sufficient FROM (
SELECT *, CASE WHEN status = 'REBALANCE' THEN greatest(CAST(trunc((greatest(1, round_even(lots_needed, 0)) - lots_held) * 50) AS BIGINT), -CAST(held_units AS BIGINT)) END AS change FROM (
SELECT * EXCLUDE (status), CASE WHEN held_units IS NULL THEN 'no puts' WHEN status IN ('TRIGGERED', 'no prices') THEN 'see profit lock' WHEN abs(lots_needed - lots_held) < 3 THEN 'in band' WHEN held_price IS NULL OR NOT held_price > 0 THEN 'no prices' ELSE 'REBALANCE' END AS status
FROM (SELECT *, held_units / 50 AS lots_held, hedge_ratio * stocks / (spot * 50) AS lots_needed FROM rolled)))""")),
]
