"""Registered queries: regressions, covariances, value at risk, weights, performance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.operators import indicators as ind
from bartide.operators import risk as rk
from bartide.operators import universe as un
from bartide.operators import weights as wt
from bartide.operators.rolling import back
from bartide.plans import prices
from bartide.plans import weights_sql as ws
from bartide.plans.catalog import Query
from bartide.plans.indicators import stops_frame, stops_sql
from bartide.plans.market_sql import define, with_tables
from bartide.session import cut_as_dealt, cut_lineage, once
from bartide.sources import market as mk

RISK_FREE = 0.0555
WINDOWS = [("all", "1995-01-01", "2001-12-31"), ("2000", "2000-01-01", "2000-12-31"), ("last", "2001-04-02", "2001-12-31")]
PRINCIPAL, SLEEVE = 1e7, 0.97
UNIVERSE_TILTS, UNIVERSE_CAP = (0.0, 0.25, 1.0), 0.25


@once
def members(spark, folder):
    """Returns of every book member; computed once, read by several branches of a query."""
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    return rk.member_returns(bars, mk.numbered_calendar(bars), mk.books(bars))


@once
def factors(spark, folder):
    return prices.factor_table(spark, folder)


def portfolio_return(spark, folder):
    return rk.portfolio_returns(members(spark, folder))


def universe_return(spark, folder):
    return rk.equal_weight_return(members(spark, folder))


def single_index(spark, folder):
    return rk.single_index(rk.with_portfolios(members(spark, folder)), factors(spark, folder))


def multi_factor(spark, folder):
    return rk.multi_factor(rk.with_portfolios(members(spark, folder)), factors(spark, folder))


def capm(spark, folder):
    return rk.capm(single_index(spark, folder), RISK_FREE)


def autocorrelation(spark, folder):
    return rk.autocorrelation(rk.with_portfolios(members(spark, folder)))


def hedge_betas(spark, folder):
    return rk.hedge_betas(portfolio_return(spark, folder), factors(spark, folder))


def sector_index_returns(spark, folder):
    """Returns of the sector indices on their filled levels."""
    levels = prices.bridged(spark, folder).select(F.col("index_name").alias("benchmark"), "session", F.col("filled").alias("v"))
    return levels.select("benchmark", "session", (F.col("v") / F.nullif(back("v", 1, key="benchmark"), F.lit(0.0)) - 1).alias("bench_ret"))


def exposures(spark, folder):
    """Exposure of every book to each sector index, the best fit first."""
    rows = rk.exposures(portfolio_return(spark, folder), sector_index_returns(spark, folder))
    place = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.round("r_squared", 9).desc_nulls_last(), "benchmark"))  # a row per index
    return rows.withColumn("place", place).withColumn("best", F.col("place") == 1)


def spread_model(spark, folder):
    """Portfolio on market, universe minus market and large minus market over the last 245 common sessions."""
    held = members(spark, folder)
    rows = (rk.portfolio_returns(held).join(factors(spark, folder).select("session", "market_ret", "large_ret"), "session")
            .join(rk.equal_weight_return(held), "session")
            .select("portfolio", "session", F.col("ret").alias("p"), F.col("market_ret").alias("market"),
                    (F.col("universe_ret") - F.col("market_ret")).alias("universe"), (F.col("large_ret") - F.col("market_ret")).alias("size")))
    kept = rk.latest_sessions(rows.dropna(), ["portfolio"], 245)
    both = kept.groupBy("portfolio").agg(F.corr("universe", "size").alias("corr_universe_size"))
    return rk.ols(kept, ["portfolio"], "p", ["market", "universe", "size"]).join(both, "portfolio")


def stock_betas(spark, folder):
    index = factors(spark, folder).select("session", F.col("large_ret").alias("m"))
    return rk.latest_betas(members(spark, folder), index, "symbol")


def covariance(spark, folder):
    return rk.pairwise_covariance(rk.latest_sessions(members(spark, folder), ["symbol"], 252))


def risk_shares(spark, folder):
    held = members(spark, folder)
    cov = rk.pairwise_covariance(rk.latest_sessions(held, ["symbol"], 252))
    return rk.risk_shares(cov, held.select("portfolio", "symbol", "weight").distinct())


def positions(spark, folder):
    """Rupee positions of each book: its weights on the equity sleeve."""
    return members(spark, folder).withColumn("x", F.col("weight") * PRINCIPAL * SLEEVE)


def var_summary(spark, folder):
    held = positions(spark, folder)
    base = held.select("portfolio", "symbol", "x").distinct().groupBy("portfolio").agg(F.sum("x").alias("value"))
    return rk.value_at_risk(rk.complete_sessions(held, 200), 12, base)


def var_components(spark, folder):
    return rk.components(rk.complete_sessions(positions(spark, folder), 200))


def performance_rows(spark, folder):
    fx = factors(spark, folder).select("session", F.col("market_ret").alias("m"), F.col("rate_ret").alias("rf"))
    return portfolio_return(spark, folder).withColumnRenamed("ret", "p").join(fx, "session")


def performance(spark, folder):
    return rk.window_metrics(rk.in_windows(performance_rows(spark, folder), WINDOWS))


def growth_paths(spark, folder):
    rows = performance_rows(spark, folder)
    running = Window.partitionBy("portfolio").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("portfolio", "session", *[(100 * F.product(1 + F.col(c)).over(running)).alias(f"{c}_path") for c in ("p", "m", "rf")])


def selection_beta(spark, folder):
    """Beta of each book over the last 245 sessions up to a date, in excess of the rate."""
    fx = factors(spark, folder).select("session", "rate_ret", F.col("mkt_excess").alias("m"))
    rows = portfolio_return(spark, folder).where(F.col("session") <= F.lit("2000-12-31").cast("date"))
    kept = rk.latest_sessions(rows, ["portfolio"], 245).join(fx, "session").withColumn("y", F.col("ret") - F.col("rate_ret"))
    return rk.ols(kept, ["portfolio"], "y", ["m"]).select("portfolio", "n", F.col("b_m").alias("beta"))


def inverse_vol(spark, folder):
    return wt.inverse_volatility(members(spark, folder))


def rebalance_covariance(spark, folder, every: int = 52, lookback: int = 156):
    """Covariance of each book at every rebalance date over its trailing sessions: a row joins each window it is in."""
    held = members(spark, folder)
    first = F.ceil(F.col("n") / every).cast("int")
    last = F.floor((F.col("n") + lookback - 1) / every).cast("int")
    keyed = held.where(last >= first).withColumn("rebalance", F.explode(F.sequence(first, last)))
    keyed = keyed.withColumn("portfolio", F.struct("portfolio", "rebalance"))
    cov = rk.pairwise_covariance(keyed)
    return wt.gathered(cov).select(F.col("portfolio.portfolio").alias("portfolio"), F.col("portfolio.rebalance").alias("rebalance"), "symbols", "cov")


def equal_risk(spark, folder):
    """Bounded equal-risk weights of every book at every rebalance date, equal weights where a covariance is missing."""
    books = rebalance_covariance(spark, folder)
    return wt.spread_out(books.withColumn("weights", wt.equal_risk_column(F.col("cov"), 0.05, 0.25)), ["portfolio", "rebalance"])


def minimum_variance(spark, folder):
    books = rebalance_covariance(spark, folder)
    return wt.spread_out(books.withColumn("weights", wt.minimum_variance_column(F.col("cov"), 0.05, 0.25)), ["portfolio", "rebalance"])


def moments(spark, folder):
    """One row per book: symbols, covariance, annual means and the mean rate."""
    held = members(spark, folder)
    books = wt.gathered(rk.pairwise_covariance(held))
    means = held.groupBy("portfolio", "symbol").agg((F.avg("ret") * 252).alias("m")).groupBy("portfolio").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("symbol", "m"))), lambda s: s["m"]).alias("mu"))
    rate = factors(spark, folder).agg((F.avg("rate_ret") * 252).alias("rf"))
    return books.join(means, "portfolio").join(rate)  # a single row of totals


def frontier(spark, folder):
    """Long-only frontier: one row per book and tilt, solved where the row lives."""
    tilts = F.array(F.lit(0.0), *[F.lit(0.01 * 5000 ** (k / 39)) for k in range(40)])
    rows = moments(spark, folder).select("*", F.explode(tilts).alias("tilt"))
    solved = rows.withColumn("weights", wt.frontier_column(F.col("cov"), F.col("mu"), F.col("tilt")))
    return wt.weight_statistics(solved, ["portfolio", "tilt"], "weights")


def weight_comparison(spark, folder):
    """Statistics of equal, equal-risk, minimum-variance, bounded and tangency weights of each book."""
    cov, mu = F.col("cov"), F.col("mu")
    rows = cut_lineage(moments(spark, folder).withColumns({
        "equal": F.transform("symbols", lambda _: 1.0 / F.size("symbols")), "equal_risk": wt.equal_risk_column(cov, 0.05, 0.25),
        "minimum_variance": wt.minimum_variance_column(cov), "bounded_variance": wt.minimum_variance_column(cov, 0.05, 0.25),
        "tangency": wt.tangency_column(cov, mu, F.col("rf"))}))
    names = ["equal", "equal_risk", "minimum_variance", "bounded_variance", "tangency"]
    tall = rows.select("portfolio", "cov", "mu", "rf", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("w")) for n in names])))
    return wt.weight_statistics(tall, ["portfolio", "rule"], "w")


def universe_members(spark, folder):
    """`members` from bars that hold what returns and books read and stay dealt by symbol, for studies of all symbols that read nothing else."""
    bars = cut_as_dealt(mk.close_bars(spark, folder))
    return rk.member_returns(bars, F.broadcast(mk.numbered_calendar(bars)), mk.books(bars))


def universe_covariance(spark, folder):
    """Covariance of every pair of symbols, whatever their books."""
    return un.universe_covariance(cut_lineage(rk.latest_sessions(universe_members(spark, folder), ["symbol"], 252).select("symbol", "session", "ret")))


def universe_weights(spark, folder):
    """One book of every symbol: minimum variance, two points of the frontier and equal risk."""
    return un.universe_weights(universe_members(spark, folder).select("symbol", "session", "ret"), UNIVERSE_TILTS, 0.0, UNIVERSE_CAP)


def equal_statistics(spark, folder):
    rows = moments(spark, folder).withColumn("equal", F.transform("symbols", lambda _: 1.0 / F.size("symbols")))
    return wt.weight_statistics(rows, ["portfolio"], "equal")


def risk_summary(spark, folder):
    """Per holding: price, volatility, mean return, weight, shares, amount, ATR and stop."""
    bars = cut_lineage(mk.weekly_bars(spark, folder))
    books = mk.books(bars)
    levels = ind.support_resistance(bars).select("symbol", "current_price", "support", "resistance")
    rows = (books.select("portfolio", "symbol", "weight").join(levels, "symbol").join(ind.average_true_range(bars), "symbol")
            .join(ind.volatility(ind.session_returns(bars)), "symbol"))
    stop, method = ind.atr_stop("current_price", "atr", "support", multiple=1.5)
    shares = F.floor(F.col("weight") * PRINCIPAL * SLEEVE / F.col("current_price"))
    out = rows.withColumns({"stop": stop, "method": method, "shares": shares})
    return out.withColumns({"invested": F.col("shares") * F.col("current_price"),
                            "stop_below_pct": (F.col("current_price") - F.col("stop")) / F.col("current_price") * 100})


def full_summary(spark, folder):
    """The risk summary with each holding's share of the book's variance and its stop trailed against the one set before."""
    share = risk_shares(spark, folder).select("portfolio", "symbol", F.col("share").alias("risk_share"))
    trailed = stops_frame(spark, folder).select("symbol", F.col("stop_old").alias("previous_stop"), F.col("final_stop").alias("trailed_stop"), F.col("final_method").alias("trailed_by"))
    return risk_summary(spark, folder).join(share, ["portfolio", "symbol"], "left").join(trailed, "symbol", "left")


def reward_risk(spark, folder):
    """Upside of one standard deviation over 63 sessions against the distance to the stop, per holding and per book."""
    rows = risk_summary(spark, folder)
    up = F.col("annual_vol") * 100 * F.sqrt(F.lit(63 / 252))
    stock = rows.select("portfolio", "symbol", up.alias("upside_pct"), F.col("stop_below_pct").alias("downside_pct"), F.col("invested").alias("value"),
                        ((F.col("resistance") / F.col("current_price") - 1) * 100).alias("first_hurdle_pct"))
    stock = stock.withColumns({"upside_inr": F.col("value") * F.col("upside_pct") / 100, "downside_inr": F.col("value") * F.col("downside_pct") / 100})
    book = stock.groupBy("portfolio").agg(F.sum("value").alias("value"), F.sum("upside_inr").alias("upside_inr"), F.sum("downside_inr").alias("downside_inr"))
    book = book.select("portfolio", F.lit("PORTFOLIO").alias("symbol"), (F.col("upside_inr") / F.col("value") * 100).alias("upside_pct"),
                       (F.col("downside_inr") / F.col("value") * 100).alias("downside_pct"), "value", F.lit(None).cast("double").alias("first_hurdle_pct"),
                       "upside_inr", "downside_inr")
    # the book's own typical move, smaller than the sum of its members'; no ratio to the loss of all stops at once
    own = portfolio_return(spark, folder).groupBy("portfolio").agg((F.stddev_samp("ret") * F.sqrt(F.lit(63.0)) * 100).alias("upside_pct"))
    apart = book.select("portfolio", "value").join(own, "portfolio").select(
        "portfolio", F.lit("DIVERSIFIED").alias("symbol"), "upside_pct", "value", (F.col("value") * F.col("upside_pct") / 100).alias("upside_inr"))
    both = stock.unionByName(book).unionByName(apart, allowMissingColumns=True)
    return both.withColumns({"reward_risk": F.when(F.col("downside_inr") > 0, F.col("upside_inr") / F.nullif(F.col("downside_inr"), F.lit(0.0))),
                             "loss_at_stop_pct": F.col("downside_inr") / PRINCIPAL * 100})


# ---- the same in SQL ----
define("rets", """
SELECT r.symbol, suppkey // 8 AS portfolio, weight, session, n, ret FROM (SELECT symbol, session, n, CASE WHEN n - lag(n) OVER w = 1 THEN close / lag(close) OVER w - 1 END AS ret
  FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY n)) r JOIN books b ON b.symbol = r.symbol WHERE ret IS NOT NULL""")
define("port", "SELECT portfolio, session, sum(weight * ret) / sum(weight) AS ret FROM rets GROUP BY 1, 2")
define("series", "SELECT 'stock' AS kind, symbol AS entity, session, ret FROM rets UNION ALL SELECT 'portfolio', CAST(portfolio AS VARCHAR), session, ret FROM port")
define("fx", """
SELECT * FROM (SELECT session, market / lag(market) OVER w - 1 AS market_ret, large / lag(large) OVER w - 1 AS large_ret, bond / lag(bond) OVER w - 1 AS bond_ret,
  rate / lag(rate) OVER w - 1 AS rate_ret, crude / lag(crude) OVER w - 1 AS crude_ret, market / lag(market) OVER w - rate / lag(rate) OVER w AS mkt_excess
FROM (SELECT factors.*, f.close AS crude FROM factors ASOF LEFT JOIN foreign_closes f ON f.day < factors.session) WINDOW w AS (ORDER BY session)) WHERE rate_ret IS NOT NULL""")
define("excess", "SELECT s.kind, s.entity, s.session, s.ret - f.rate_ret AS y, f.mkt_excess, f.crude_ret, f.bond_ret FROM series s JOIN fx f ON f.session = s.session")
define("index_fit", """
SELECT kind, entity, count(*) AS n, regr_slope(y, mkt_excess) AS b, regr_intercept(y, mkt_excess) AS a, regr_r2(y, mkt_excess) AS r2, var_samp(y) AS yv, var_samp(mkt_excess) AS mv,
  avg(mkt_excess) AS mm, regr_sxx(y, mkt_excess) AS sxx, regr_syy(y, mkt_excess) AS syy FROM excess GROUP BY 1, 2""")
define("single_idx", """
SELECT kind, entity, n AS observations, a * 252 * 100 AS alpha_annual_pct, a / sqrt(s2 * (1 / n + mm * mm / sxx)) AS alpha_t, round_even(b, 3) AS beta, sqrt(s2 / sxx) AS beta_se, r2 AS r_squared,
  sqrt(yv * 252) * 100 AS total_vol_pct, sqrt(b * b * mv * 252) * 100 AS systematic_vol_pct, sqrt(greatest(yv * 252 - b * b * mv * 252, 0)) * 100 AS unsystematic_vol_pct
FROM (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM index_fit WHERE n > 4)""")


DET = {
    "s11": "regr_sxx(y, x1)", "s22": "regr_sxx(y, x2)", "s33": "regr_sxx(y, x3)", "s12": "regr_sxy(x1, x2)", "s13": "regr_sxy(x1, x3)", "s23": "regr_sxy(x2, x3)",
    "g1": "regr_sxy(y, x1)", "g2": "regr_sxy(y, x2)", "g3": "regr_sxy(y, x3)", "syy": "regr_syy(y, x1)", "m1": "avg(x1)", "m2": "avg(x2)", "m3": "avg(x3)", "my": "avg(y)", "n": "count(*)"}
THREE = "SELECT {by}, " + ", ".join(f"{e} AS {k}" for k, e in DET.items()) + " FROM ({source}) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL GROUP BY ALL"
# eliminate x1, then x2: the usual 3 x 3 elimination on centred sums
ELIMINATED = """
SELECT *, a3 AS b3, (t2 - u23 * a3) / u22 AS b2, (g1 - s12 * ((t2 - u23 * a3) / u22) - s13 * a3) / s11 AS b1 FROM (
SELECT *, (t3 - u23 * t2 / u22) / (u33 - u23 * u23 / u22) AS a3, u33 - u23 * u23 / u22 AS w33 FROM (
SELECT *, s22 - s12 * s12 / s11 AS u22, s23 - s12 * s13 / s11 AS u23, s33 - s13 * s13 / s11 AS u33, g2 - s12 * g1 / s11 AS t2, g3 - s13 * g1 / s11 AS t3 FROM ({three})))"""


def three_factor_sql(source: str, by: str) -> str:
    inner = ELIMINATED.format(three=THREE.format(by=by, source=source))
    return f"""SELECT *, 1 - sse / syy AS r2, 1 - (sse / syy) * (n - 1) / (n - 4) AS adj_r2, b3 / sqrt(sse / (n - 4) / w33) AS t3_stat,
  b1 / sqrt(sse / (n - 4) * (s22 * s33 - s23 * s23) / det) AS t1, b2 / sqrt(sse / (n - 4) * (s11 * s33 - s13 * s13) / det) AS t2_stat,
  my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, 1 - g1 * g1 / s11 / syy AS miss1 FROM (
  SELECT *, syy - b1 * g1 - b2 * g2 - b3 * g3 AS sse, s11 * u22 * w33 AS det FROM ({inner})) WHERE n > 6"""


define("pos", "SELECT *, weight * 1e7 * 0.97 AS x FROM rets")
define("var_days", """
SELECT portfolio, session, pnl FROM (SELECT p.portfolio, p.session, sum(x * ret) AS pnl, count(*) AS k, any_value(s.k) AS size FROM pos p JOIN (SELECT portfolio, count(DISTINCT symbol) AS k FROM rets GROUP BY 1) s ON s.portfolio = p.portfolio
GROUP BY 1, 2) WHERE k = size QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY session DESC) <= 200""")
define("var_parts", """
SELECT portfolio, symbol, x, standalone, marginal, x * marginal AS component, x * marginal / sum(x * marginal) OVER (PARTITION BY portfolio) * 100 AS share_pct FROM (
SELECT d.portfolio, p.symbol, max(p.x) AS x, 1.6449 * stddev_samp(p.ret) * abs(max(p.x)) AS standalone, 1.6449 * covar_samp(p.ret, d.pnl) / stddev_samp(d.pnl) AS marginal
FROM var_days d JOIN pos p ON p.portfolio = d.portfolio AND p.session = d.session GROUP BY 1, 2)""")


def var_sql(days: str, parts: str, value: str) -> str:
    return f"""SELECT q.portfolio, q.sessions, v.value, 1.6449 * sigma AS parametric_95, 2.3263 * sigma AS parametric_99, 1.6449 * sigma * sqrt(12.0) AS parametric_95_horizon, -q95 AS historical_95, -q99 AS historical_99,
  cvar_95, cvar_99, alone - 1.6449 * sigma AS diversification, 1.6449 * sigma / v.value * 100 AS parametric_95_pct
FROM (SELECT portfolio, count(*) AS sessions, stddev_samp(pnl) AS sigma, quantile_cont(pnl, 0.05) AS q95, quantile_cont(pnl, 0.01) AS q99 FROM {days} GROUP BY 1) q
JOIN (SELECT d.portfolio, -avg(pnl) FILTER (pnl <= a) AS cvar_95, -avg(pnl) FILTER (pnl <= b) AS cvar_99 FROM {days} d JOIN (SELECT portfolio, quantile_cont(pnl, 0.05) AS a, quantile_cont(pnl, 0.01) AS b FROM {days} GROUP BY 1) t
  ON t.portfolio = d.portfolio GROUP BY 1) c ON c.portfolio = q.portfolio
JOIN (SELECT portfolio, sum(standalone) AS alone FROM {parts} GROUP BY 1) s ON s.portfolio = q.portfolio JOIN ({value}) v ON v.portfolio = q.portfolio"""


VALUE_SQL = "SELECT portfolio, sum(x) AS value FROM (SELECT DISTINCT portfolio, symbol, x FROM pos) GROUP BY 1"
define("hvar_days", """
SELECT portfolio, session, pnl FROM (SELECT p.portfolio, p.session, sum(x * ret) AS pnl, count(*) AS k, any_value(s.k) AS size FROM hpos p JOIN (SELECT portfolio, count(DISTINCT symbol) AS k FROM hpos GROUP BY 1) s ON s.portfolio = p.portfolio
GROUP BY 1, 2) WHERE k = size QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY session DESC) <= 200""")
define("hvar_parts", """
SELECT d.portfolio, p.symbol, 1.6449 * stddev_samp(p.ret) * abs(max(p.x)) AS standalone FROM hvar_days d JOIN hpos p ON p.portfolio = d.portfolio AND p.session = d.session GROUP BY 1, 2""")
define("tail252", "SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) <= 252")
define("cov252", """
SELECT a.portfolio, a.symbol AS i, b.symbol AS j, count(*) AS overlap, CASE WHEN count(*) >= 60 THEN covar_samp(a.ret, b.ret) * 252 END AS cov
FROM tail252 a JOIN tail252 b ON b.portfolio = a.portfolio AND b.session = a.session GROUP BY 1, 2, 3""")
define("perf", "SELECT p.portfolio, p.session, p.ret AS p, f.market_ret AS m, f.rate_ret AS rf FROM port p JOIN fx f ON f.session = p.session")
define("perf_windows", "SELECT w.label AS win, p.* FROM perf p JOIN (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in WINDOWS)
       + ") AS w(label, lo, hi) ON p.session BETWEEN w.lo AND w.hi")
PERF_SQL = """
SELECT portfolio, win AS period, sessions, (gp - 1) * 100 AS return_pct, (gm - 1) * 100 AS benchmark_pct, sp, beta, max_drawdown, market_drawdown, up_capture, down_capture, tracking_error,
  (rp - rfa) / sp AS sharpe, (rm - rfa) / sm AS market_sharpe, (rp - rfa) / beta * 100 AS treynor_pct, (rfa + (rp - rfa) / sp * sm) * 100 AS m2_pct, (rp - (rfa + beta * (rm - rfa))) * 100 AS jensen_pct,
  ((gp - 1) - ((gf - 1) + beta * (gm - gf))) * 100 AS jensen_period_pp, (rp - rfa) / dsp AS sortino, active * 252 / tracking_error AS information_ratio,
  (pow(gp, 365.0 / (hi - (lo - CASE isodow(lo) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END))) - 1) * 100 AS xirr_pct
FROM (SELECT *, pow(gp, 252.0 / sessions) - 1 AS rp, pow(gm, 252.0 / sessions) - 1 AS rm, pow(gf, 252.0 / sessions) - 1 AS rfa FROM (
SELECT portfolio, win, count(*) AS sessions, min(session) AS lo, max(session) AS hi, product(1 + p) AS gp, product(1 + m) AS gm, product(1 + rf) AS gf, stddev_samp(p) * sqrt(252.0) AS sp, stddev_samp(m) * sqrt(252.0) AS sm,
  covar_samp(p - rf, m - rf) / var_samp(m - rf) AS beta, stddev_samp(CASE WHEN p < 0 THEN p END) * sqrt(252.0) AS dsp, min(dp) AS max_drawdown, min(dm) AS market_drawdown,
  avg(p) FILTER (m > 0) / avg(m) FILTER (m > 0) AS up_capture, avg(p) FILTER (m < 0) / avg(m) FILTER (m < 0) AS down_capture, stddev_samp(p - m) * sqrt(252.0) AS tracking_error, avg(p - m) AS active
FROM (SELECT *, cp / max(cp) OVER (PARTITION BY portfolio, win ORDER BY session) - 1 AS dp, cm / max(cm) OVER (PARTITION BY portfolio, win ORDER BY session) - 1 AS dm FROM (
  SELECT *, product(1 + p) OVER w AS cp, product(1 + m) OVER w AS cm FROM perf_windows WINDOW w AS (PARTITION BY portfolio, win ORDER BY session))) GROUP BY 1, 2))"""
define("lag_rows", "SELECT *, " + ", ".join(f"lag(ret, {k}) OVER w AS l{k}" for k in range(1, 6))
       + ", (row_number() OVER w - 1) // 5 AS blk FROM series WINDOW w AS (PARTITION BY kind, entity ORDER BY session)")
define("bridged", """
SELECT l.index_name, l.session, r.filled FROM lv l JOIN rec r ON r.index_name = l.index_name AND r.k = l.k""")
define("lv", "SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY session) AS k FROM index_levels")
define("rec", """SELECT index_name, k, price, level AS filled FROM lv WHERE k = 1
  UNION ALL SELECT l.index_name, l.k, l.price, CASE WHEN l.level IS NULL THEN CASE WHEN r.filled IS NOT NULL AND l.price IS NOT NULL AND r.price > 0 THEN r.filled * l.price / r.price END ELSE l.level END
  FROM rec r JOIN lv l ON l.index_name = r.index_name AND l.k = r.k + 1""")
define("risk_sum", f"""
SELECT *, (current_price - stop) / current_price * 100 AS stop_below_pct, shares * current_price AS invested FROM (
SELECT b.portfolio, b.symbol, b.weight, l.current_price, l.support, l.resistance, a.atr, v.annual_vol, v.annual_mean, floor(b.weight * {PRINCIPAL} * {SLEEVE} / l.current_price) AS shares,
  CASE WHEN a.atr > 0 AND (CASE WHEN near THEN l.support - 0.25 * a.atr ELSE base END) > 0 THEN CASE WHEN near THEN l.support - 0.25 * a.atr ELSE base END END AS stop,
  CASE WHEN a.atr IS NULL OR a.atr <= 0 OR (CASE WHEN near THEN l.support - 0.25 * a.atr ELSE base END) <= 0 THEN 'unavailable' WHEN near THEN 'support' ELSE 'atr' END AS method
FROM books b JOIN (SELECT l0.*, l0.current_price - 1.5 * a0.atr AS base, l0.support >= l0.current_price - 1.5 * a0.atr - a0.atr AND l0.support < l0.current_price - 1.5 * a0.atr AS near
  FROM levels l0 JOIN last_atr a0 ON a0.symbol = l0.symbol) l ON l.symbol = b.symbol JOIN last_atr a ON a.symbol = b.symbol
JOIN (SELECT symbol, stddev_samp(ret) * sqrt(252.0) AS annual_vol, avg(ret) * 252 AS annual_mean FROM (SELECT symbol, close / prev_close - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars WHERE prev_close > 0)
  WHERE k <= 252 GROUP BY 1) v ON v.symbol = b.symbol)""")
define("rr_stock", """
SELECT portfolio, symbol, annual_vol * 100 * sqrt(63 / 252) AS upside_pct, stop_below_pct AS downside_pct, invested AS value, (resistance / current_price - 1) * 100 AS first_hurdle_pct,
  invested * annual_vol * sqrt(63 / 252) AS upside_inr, invested * stop_below_pct / 100 AS downside_inr FROM risk_sum""")

SHARES_SQL = """
SELECT portfolio, symbol, weight, weight * mg / sum(weight * mg) OVER (PARTITION BY portfolio) AS share FROM (SELECT c.portfolio, c.i AS symbol, any_value(bi.weight) AS weight, sum(c.cov * bj.weight) AS mg
FROM cov252 c JOIN books bi ON bi.symbol = c.i JOIN books bj ON bj.symbol = c.j GROUP BY 1, 2)"""
# books in SQL: covariances at the rebalance dates, and over all sessions with means and the rate
REBALANCED = {
    "rkeyed": """SELECT portfolio || '-' || rebalance AS k, portfolio, rebalance, symbol, session, ret FROM (
      SELECT *, unnest(generate_series(CAST(ceil(n / 52.0) AS INTEGER), CAST(floor((n + 155) / 52.0) AS INTEGER))) AS rebalance FROM rets)""",
    "rcells": "SELECT a.k, a.symbol AS i, b.symbol AS j, CASE WHEN count(*) >= 60 THEN covar_samp(a.ret, b.ret) * 252 END AS cov FROM rkeyed a JOIN rkeyed b ON b.k = a.k AND b.session = a.session GROUP BY 1, 2, 3",
    "rmat": ws.MATRICES.format(cells="rcells")}
WEIGHTS_SQL = """
SELECT CAST(split_part(k, '-', 1) AS BIGINT) AS portfolio, CAST(split_part(k, '-', 2) AS BIGINT) AS rebalance, unnest(symbols) AS symbol,
  unnest(coalesce(w, list_transform(symbols, lambda x: 1.0::DOUBLE / n))) AS weight, w IS NOT NULL AS solved FROM rmat LEFT JOIN solution USING (k)"""
MOMENTS = {
    "acells": "SELECT CAST(a.portfolio AS VARCHAR) AS k, a.symbol AS i, b.symbol AS j, CASE WHEN count(*) >= 60 THEN covar_samp(a.ret, b.ret) * 252 END AS cov FROM rets a JOIN rets b ON b.portfolio = a.portfolio AND b.session = a.session GROUP BY 1, 2, 3",
    "amat": ws.MATRICES.format(cells="acells"),
    "moments": """SELECT amat.*, mu, rf FROM amat JOIN (SELECT CAST(portfolio AS VARCHAR) AS k, list(m ORDER BY symbol) AS mu FROM (SELECT portfolio, symbol, avg(ret) * 252 AS m FROM rets GROUP BY 1, 2) GROUP BY 1) USING (k)
      CROSS JOIN (SELECT avg(rate_ret) * 252 AS rf FROM fx)"""}
# one book of all symbols: a missing return counts as the symbol's mean
UNIVERSE = {
    "ustats": "SELECT symbol, avg(ret) AS mean FROM rets GROUP BY 1 HAVING count(*) >= 60 AND var_samp(ret) > 0",
    "ucentred": "SELECT r.symbol, r.session, r.ret - u.mean AS x FROM rets r JOIN ustats u ON u.symbol = r.symbol",
    "ucells": """SELECT 'all' AS k, i, j, coalesce(s, 0.0) / (days - 1) * 252 AS cov FROM (SELECT a.symbol AS i, b.symbol AS j FROM ustats a, ustats b)
      LEFT JOIN (SELECT a.symbol AS i, b.symbol AS j, sum(a.x * b.x) AS s FROM ucentred a JOIN ucentred b ON b.session = a.session GROUP BY 1, 2) USING (i, j)
      CROSS JOIN (SELECT count(DISTINCT session) AS days FROM ucentred)""",
    "umat": ws.MATRICES.format(cells="ucells"),
    "ubook": "SELECT * FROM umat CROSS JOIN (SELECT list(mean * 252 ORDER BY symbol) AS mu FROM ustats)"}
FLAT = "SELECT *, list_transform(mu, lambda v: 0.0::DOUBLE) AS t FROM moments"

QUERIES = [
    Query("portfolio_returns", "R1", "portfolio:i session:d ret:8", portfolio_return, with_tables("SELECT * FROM port")),
    Query("universe_returns", "R12", "session:d universe_ret:8", universe_return, with_tables("SELECT session, avg(ret) AS universe_ret FROM rets GROUP BY 1")),
    Query("single_index_table", "R3 R2 J4", "kind:s entity:s observations:i alpha_annual_pct:4 alpha_t:4 beta:3 beta_se:5 r_squared:6 total_vol_pct:4 systematic_vol_pct:4 unsystematic_vol_pct:4",
          single_index, with_tables("SELECT * FROM single_idx")),
    Query("multi_factor_table", "R4 G15", "kind:s entity:s n:i b_mkt_excess:5 t_mkt_excess:4 b_crude_ret:5 t_crude_ret:4 b_bond_ret:5 t_bond_ret:4 r2:6 adj_r2:6 r2_gain_pp:4", multi_factor, with_tables(
        "SELECT kind, entity, n, b1 AS b_mkt_excess, t1 AS t_mkt_excess, b2 AS b_crude_ret, t2_stat AS t_crude_ret, b3 AS b_bond_ret, t3_stat AS t_bond_ret, r2, adj_r2, (r2 - (1 - miss1)) * 100 AS r2_gain_pp FROM ("
        + three_factor_sql("SELECT kind, entity, y, mkt_excess AS x1, crude_ret AS x2, bond_ret AS x3 FROM excess", "kind, entity") + ")")),
    Query("capm_table", "R5", "kind:s entity:s beta:3 expected_pct:5 expected_3m_pct:5", capm, with_tables(f"""
SELECT kind, entity, beta, ({RISK_FREE} + beta * 7.08 / 100) * 100 AS expected_pct, (pow(1 + {RISK_FREE} + beta * 7.08 / 100, 0.25) - 1) * 100 AS expected_3m_pct FROM single_idx""")),
    Query("autocorrelation_table", "R6 W14 G7 G4", "kind:s entity:s observations:i ar1_phi:5 ar1_t:4 rho_1:5 rho_2:5 rho_3:5 rho_4:5 rho_5:5 significance_bound:5 significant_lags:s ljung_box_q:4 predictable:b weekly_rho_1:5",
          autocorrelation, with_tables("""
SELECT s.*, f.ar1_phi, f.ar1_t, w.weekly_rho_1, 1.96 / sqrt(observations) AS significance_bound, observations * (observations + 2) * (rho_1 ** 2 / (observations - 1) + rho_2 ** 2 / (observations - 2) + rho_3 ** 2 / (observations - 3) + rho_4 ** 2 / (observations - 4) + rho_5 ** 2 / (observations - 5)) AS ljung_box_q,
  ljung_box_q > 11.07 AS predictable, concat_ws(', ', """ + ", ".join(f"CASE WHEN abs(rho_{k}) > 1.96 / sqrt(observations) THEN '{k}' END" for k in range(1, 6)) + """) AS significant_lags
FROM (SELECT kind, entity, count(*) AS observations, """ + ", ".join(f"corr(ret, l{k}) AS rho_{k}" for k in range(1, 6)) + """ FROM lag_rows GROUP BY 1, 2) s
JOIN (SELECT kind, entity, regr_slope(ret, l1) AS ar1_phi, regr_slope(ret, l1) / sqrt(regr_syy(ret, l1) * (1 - regr_r2(ret, l1)) / (regr_count(ret, l1) - 2) / regr_sxx(ret, l1)) AS ar1_t FROM lag_rows GROUP BY 1, 2) f ON f.kind = s.kind AND f.entity = s.entity
JOIN (SELECT kind, entity, corr(r, prev) AS weekly_rho_1 FROM (SELECT kind, entity, r, lag(r) OVER (PARTITION BY kind, entity ORDER BY blk) AS prev FROM (SELECT kind, entity, blk, product(1 + ret) - 1 AS r FROM lag_rows GROUP BY 1, 2, 3)) GROUP BY 1, 2) w ON w.kind = s.kind AND w.entity = s.entity
WHERE observations >= 30""")),
    Query("hedge_betas", "R8 G14", "portfolio:i observations:i hedge_ratio:5 effectiveness:6 downside_beta:5 tail_beta:5 tail_beta_se:5 tail_days:i cutoff:7", hedge_betas, with_tables("""
SELECT r.portfolio, count(*) AS observations, regr_slope(ret, m) AS hedge_ratio, regr_r2(ret, m) AS effectiveness, regr_slope(ret, m) FILTER (m < 0) AS downside_beta, regr_slope(ret, m) FILTER (m <= cutoff) AS tail_beta,
  sqrt(regr_syy(ret, m) FILTER (m <= cutoff) * (1 - regr_r2(ret, m) FILTER (m <= cutoff)) / (count(*) FILTER (m <= cutoff) - 2) / regr_sxx(ret, m) FILTER (m <= cutoff)) AS tail_beta_se, count(*) FILTER (m <= cutoff) AS tail_days, any_value(cutoff) AS cutoff
FROM hb r JOIN (SELECT portfolio, quantile_cont(m, 0.1) AS cutoff FROM hb GROUP BY 1) c ON c.portfolio = r.portfolio GROUP BY 1""",
        hb="SELECT p.portfolio, p.session, p.ret, f.large_ret AS m FROM port p JOIN fx f ON f.session = p.session WHERE large_ret IS NOT NULL")),
    Query("index_exposures", "R9 K10", "portfolio:i benchmark:s days:i beta:5 r_squared:6 benchmark_return_pct:4 place:i best:b", exposures, with_tables("""
SELECT *, row_number() OVER w AS place, row_number() OVER w = 1 AS best FROM (SELECT portfolio, benchmark, count(*) AS days, covar_samp(ret, b) / var_samp(b) AS beta, corr(ret, b) ** 2 AS r_squared, (product(1 + b) - 1) * 100 AS benchmark_return_pct FROM (
SELECT p.portfolio, x.index_name AS benchmark, p.ret, x.b FROM port p JOIN (SELECT index_name, session, filled / lag(filled) OVER (PARTITION BY index_name ORDER BY session) - 1 AS b FROM bridged) x ON x.session = p.session WHERE b IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY portfolio, benchmark ORDER BY p.session DESC) <= 245) GROUP BY 1, 2 HAVING count(*) >= 60) WINDOW w AS (PARTITION BY portfolio ORDER BY round(r_squared, 9) DESC NULLS LAST, benchmark)""")),
    Query("spread_factor_model", "R10", "portfolio:i n:i b_const:7 b_market:5 t_market:4 b_universe:5 t_universe:4 b_size:5 t_size:4 r2:6 corr_universe_size:5", spread_model, with_tables(
        "SELECT f.portfolio, n, b0 AS b_const, b1 AS b_market, t1 AS t_market, b2 AS b_universe, t2_stat AS t_universe, b3 AS b_size, t3_stat AS t_size, r2, c.c AS corr_universe_size FROM ("
        + three_factor_sql("SELECT * FROM sm", "portfolio") + ") f JOIN (SELECT portfolio, corr(x2, x3) AS c FROM sm GROUP BY 1) c ON c.portfolio = f.portfolio",
        sm="""SELECT p.portfolio, p.ret AS y, market_ret AS x1, u.u - market_ret AS x2, large_ret - market_ret AS x3 FROM port p JOIN fx f ON f.session = p.session JOIN (SELECT session, avg(ret) AS u FROM rets GROUP BY 1) u ON u.session = p.session
          QUALIFY row_number() OVER (PARTITION BY p.portfolio ORDER BY p.session DESC) <= 245""")),
    Query("stock_betas", "R11 G6", "symbol:s days:i beta:5", stock_betas, with_tables("""
SELECT symbol, count(*) AS days, CASE WHEN count(*) > 20 THEN covar_samp(ret, m) / var_samp(m) END AS beta FROM (SELECT r.symbol, r.ret, f.large_ret AS m FROM rets r JOIN fx f ON f.session = r.session WHERE large_ret IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r.session DESC) <= 245) GROUP BY 1""")),
    Query("pairwise_covariance", "R13 J13", "portfolio:i i:s j:s overlap:i cov:8", covariance, with_tables("SELECT * FROM cov252")),
    Query("risk_contributions", "R14", "portfolio:i symbol:s weight:6 share:6", risk_shares, with_tables(SHARES_SQL)),
    Query("value_at_risk", "R15 G9 G10", "portfolio:i sessions:i value:2 parametric_95:2 parametric_99:2 parametric_95_horizon:2 historical_95:2 historical_99:2 cvar_95:2 cvar_99:2 diversification:2 parametric_95_pct:5",
          var_summary, with_tables(var_sql("var_days", "var_parts", VALUE_SQL))),
    Query("var_components", "R15", "portfolio:i symbol:s x:2 standalone:2 marginal:7 component:2 share_pct:4", var_components, with_tables("SELECT * FROM var_parts")),
    Query("window_metrics", "R16", "portfolio:i period:s sessions:i return_pct:4 benchmark_pct:4 sp:6 beta:5 sharpe:5 market_sharpe:5 treynor_pct:4 m2_pct:4 jensen_pct:4 jensen_period_pp:4 sortino:5 max_drawdown:6 market_drawdown:6 up_capture:5 down_capture:5 tracking_error:6 information_ratio:5 xirr_pct:4",
          performance, with_tables(PERF_SQL)),
    Query("growth_paths", "R18 W5", "portfolio:i session:d p_path:4 m_path:4 rf_path:4", growth_paths, with_tables(
        "SELECT portfolio, session, 100 * product(1 + p) OVER w AS p_path, 100 * product(1 + m) OVER w AS m_path, 100 * product(1 + rf) OVER w AS rf_path FROM perf WINDOW w AS (PARTITION BY portfolio ORDER BY session)")),
    Query("selection_beta", "R21", "portfolio:i n:i beta:5", selection_beta, with_tables("""
SELECT portfolio, count(*) AS n, regr_slope(y, mkt_excess) AS beta FROM (SELECT p.portfolio, p.ret - f.rate_ret AS y, f.mkt_excess FROM (SELECT * FROM port WHERE session <= DATE '2000-12-31' QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY session DESC) <= 245) p
JOIN fx f ON f.session = p.session) GROUP BY 1 HAVING count(*) > 4""")),
    Query("inverse_volatility_weights", "M1", "portfolio:i symbol:s vol:7 weight:7", inverse_vol, with_tables("""
SELECT portfolio, symbol, vol, (1 / vol) / sum(1 / vol) OVER (PARTITION BY portfolio) AS weight FROM (SELECT portfolio, symbol, stddev_samp(ret) AS vol FROM rets GROUP BY 1, 2)""")),
    Query("equal_risk_weights", "M2", "portfolio:i rebalance:i symbol:s weight:6 solved:b", equal_risk, with_tables(
        WEIGHTS_SQL, **REBALANCED, **ws.level_contributions("solution", "SELECT *, list_transform(c, lambda r: 0.0::DOUBLE) AS t FROM rmat", 0.05, 0.25))),
    Query("minimum_variance_weights", "M3", "portfolio:i rebalance:i symbol:s weight:6 solved:b", minimum_variance, with_tables(
        WEIGHTS_SQL, **REBALANCED, **ws.pair_descent("solution", "SELECT *, list_transform(c, lambda r: 0.0::DOUBLE) AS t FROM rmat", 0.05, 0.25))),
    Query("efficient_frontier", "M4", "portfolio:i tilt:5 volatility_pct:4 mean_return_pct:4 sharpe:4 effective_names:3 largest_weight_pct:3 names_above_1pct:i", frontier, with_tables(
        ws.statistics("(SELECT m.*, s.tilt, v.w FROM tilted s JOIN solution v USING (k) JOIN moments m ON m.k = s.book)", "k AS key, book AS portfolio, tilt").replace("k AS key, book AS portfolio", "CAST(k AS BIGINT) AS portfolio"),
        **MOMENTS, tilted="SELECT book || '-' || x AS k, book, c, usable, tilt, list_transform(mu, lambda v: v * tilt) AS t FROM (SELECT k AS book, *, unnest(range(-1, 40)) AS x, CASE WHEN x < 0 THEN 0.0 ELSE 0.01 * pow(5000, x / 39.0::DOUBLE) END AS tilt FROM moments)",
        **ws.pair_descent("solution", "SELECT * FROM tilted", 0.0, 1.0))),
    Query("weight_comparison", "M4 R19 G20", "portfolio:i rule:s volatility_pct:4 mean_return_pct:4 sharpe:4 effective_names:3 largest_weight_pct:3 names_above_1pct:i", weight_comparison, with_tables(
        ws.statistics("(SELECT m.*, r.rule, r.w FROM rules r JOIN moments m USING (k))", "CAST(k AS BIGINT) AS portfolio, rule"), **MOMENTS,
        rules="""SELECT k, 'equal' AS rule, list_transform(mu, lambda v: 1.0::DOUBLE / len(mu)) AS w FROM moments UNION ALL SELECT k, 'equal_risk', w FROM erc UNION ALL SELECT k, 'minimum_variance', w FROM mv
          UNION ALL SELECT k, 'bounded_variance', w FROM bmv UNION ALL SELECT k, 'tangency', w FROM tangency""",
        **ws.level_contributions("erc", FLAT, 0.05, 0.25), **ws.pair_descent("mv", FLAT, 0.0, 1.0), **ws.pair_descent("bmv", FLAT, 0.05, 0.25),
        **ws.best_ratio("tangency", "SELECT *, list_transform(mu, lambda v: v - rf) AS t FROM moments"))),
    Query("universe_covariance", "R13 J13", "i:s j:s overlap:i cov:8", universe_covariance, with_tables("""
SELECT a.symbol AS i, b.symbol AS j, count(*) AS overlap, CASE WHEN count(*) >= 60 THEN covar_samp(a.ret, b.ret) * 252 END AS cov FROM tail252 a JOIN tail252 b ON b.session = a.session AND a.symbol <= b.symbol GROUP BY 1, 2""")),
    Query("universe_weights", "M2 M3 M4", "rule:s symbol:s weight:5 solved:b", universe_weights, with_tables(f"""
SELECT rule, unnest(symbols) AS symbol, unnest(coalesce(w, list_transform(symbols, lambda x: NULL::DOUBLE))) AS weight, w IS NOT NULL AS solved FROM (
  SELECT 'equal_risk' AS rule, symbols, w FROM umat LEFT JOIN uerc USING (k)
  UNION ALL SELECT rule, symbols, w FROM utilted t JOIN umat m ON m.k = 'all' LEFT JOIN usolution s ON s.k = t.k)""",
        **UNIVERSE, utilted="SELECT tilt AS k, c, usable, 'tilt_' || tilt AS rule, list_transform(mu, lambda v: v * CAST(tilt AS DOUBLE)) AS t FROM ubook, (VALUES "
        + ", ".join(f"('{t:g}')" for t in UNIVERSE_TILTS) + ") AS v(tilt)",
        **ws.pair_descent("usolution", "SELECT * FROM utilted", 0.0, UNIVERSE_CAP, 20000), 
        uerc=ws.even_contributions("SELECT k, c, n FROM umat WHERE usable"))),
    Query("equal_weight_statistics", "R19 G20", "portfolio:i volatility_pct:4 mean_return_pct:4 sharpe:4 effective_names:3 largest_weight_pct:3 names_above_1pct:i", equal_statistics, with_tables("""
SELECT m.portfolio, sd * 100 AS volatility_pct, mu * 100 AS mean_return_pct, (mu - r.rf) / sd AS sharpe, k AS effective_names, 100.0 / k AS largest_weight_pct, CASE WHEN 1.0 / k > 0.01 THEN k ELSE 0 END AS names_above_1pct
FROM (SELECT portfolio, avg(m) AS mu, count(*) AS k FROM (SELECT portfolio, symbol, avg(ret) * 252 AS m FROM rets GROUP BY 1, 2) GROUP BY 1) m
JOIN (SELECT portfolio, sqrt(avg(c)) AS sd FROM (SELECT a.portfolio, a.symbol, b.symbol AS s2, covar_samp(a.ret, b.ret) * 252 AS c FROM rets a JOIN rets b ON b.portfolio = a.portfolio AND b.session = a.session GROUP BY 1, 2, 3) GROUP BY 1) s ON s.portfolio = m.portfolio
CROSS JOIN (SELECT avg(rate_ret) * 252 AS rf FROM fx) r""")),
    Query("risk_summary", "R20 L5", "portfolio:i symbol:s current_price:4 annual_vol:6 annual_mean:6 weight:6 shares:i invested:2 atr:5 stop:5 stop_below_pct:4 method:s risk_share:6 previous_stop:5 trailed_stop:5 trailed_by:s", full_summary, with_tables(f"""
SELECT r.*, c.share AS risk_share, t.stop_old AS previous_stop, t.final_stop AS trailed_stop, t.final_method AS trailed_by FROM risk_sum r LEFT JOIN ({SHARES_SQL}) c ON c.portfolio = r.portfolio AND c.symbol = r.symbol
LEFT JOIN ({stops_sql()}) t ON t.symbol = r.symbol""")),
    Query("reward_risk_table", "R7", "portfolio:i symbol:s upside_pct:4 downside_pct:4 value:2 first_hurdle_pct:4 upside_inr:2 downside_inr:2 reward_risk:4 loss_at_stop_pct:5", reward_risk, with_tables("""
SELECT *, upside_inr / downside_inr AS reward_risk, downside_inr / 1e7 * 100 AS loss_at_stop_pct FROM (SELECT * FROM rr_stock UNION ALL
SELECT portfolio, 'PORTFOLIO', sum(upside_inr) / sum(value) * 100, sum(downside_inr) / sum(value) * 100, sum(value), NULL, sum(upside_inr), sum(downside_inr) FROM rr_stock GROUP BY portfolio
UNION ALL SELECT portfolio, 'DIVERSIFIED', up, NULL, value, NULL, value * up / 100, NULL FROM (SELECT portfolio, sum(value) AS value FROM rr_stock GROUP BY 1) JOIN (SELECT portfolio, stddev_samp(ret) * sqrt(63.0) * 100 AS up FROM port GROUP BY 1) USING (portfolio))""")),
]
