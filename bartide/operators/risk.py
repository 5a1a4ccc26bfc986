"""Portfolio returns, regressions by moments, covariances, value at risk and performance metrics.

Everything is keyed by portfolio (or symbol), so one job covers all of them. A group holds at most one row per session
and member, which the calendar and the book size bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.functions.numbers import TRADING_DAYS, half_even
from bartide.operators.rolling import adjacent_return, by_symbol, so_far

# fixed values: normal quantiles of the two confidence levels and the Ljung-Box 5% value for 5 lags
Z_95, Z_99 = 1.6449, 2.3263
LJUNG_BOX_5 = 11.07


def member_returns(bars: DataFrame, calendar: DataFrame, books: DataFrame) -> DataFrame:
    """(portfolio, symbol, weight, session, n, ret): one-session returns that never span a missed session."""
    priced = bars.select("symbol", "session", "close").join(calendar, "session")
    returns = priced.withColumn("ret", adjacent_return()).where(F.col("ret").isNotNull()).drop("close")
    return returns.join(books.select("portfolio", "symbol", "weight"), "symbol")


def portfolio_returns(members: DataFrame) -> DataFrame:
    """(portfolio, session, ret): weights renormalised over the members that traded."""
    known = F.col("ret").isNotNull()
    return members.groupBy("portfolio", "session").agg(
        (F.sum(F.col("weight") * F.col("ret")) / F.nullif(F.sum(F.when(known, F.col("weight"))), F.lit(0.0))).alias("ret"))


def equal_weight_return(members: DataFrame) -> DataFrame:
    return members.groupBy("session").agg(F.avg("ret").alias("universe_ret"))


def with_portfolios(members: DataFrame) -> DataFrame:
    """(kind, entity, session, ret): every symbol and every portfolio as one series each."""
    stocks = members.select(F.lit("stock").alias("kind"), F.col("symbol").alias("entity"), "session", "ret")
    whole = portfolio_returns(members).select(F.lit("portfolio").alias("kind"), F.col("portfolio").cast("string").alias("entity"), "session", "ret")
    return stocks.unionByName(whole)


def latest_sessions(rows: DataFrame, by: Sequence[str], count: int, order: str = "session") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_k", place).where(F.col("_k") <= count).drop("_k")


# ---- ordinary least squares from second moments --------------------------------------------------------------------

def _minor(m, i, j):
    return [[v for c, v in enumerate(row) if c != j] for r, row in enumerate(m) if r != i]


def _det(m):
    if len(m) == 1:
        return m[0][0]
    parts = [m[0][j] * _det(_minor(m, 0, j)) for j in range(len(m))]
    total = parts[0]
    for j, part in enumerate(parts[1:], 1):
        total = total - part if j % 2 else total + part
    return total


def _inverse(m) -> list[list]:
    """Inverse of a small symmetric matrix of Columns by cofactors."""
    size, det = len(m), F.nullif(_det(m), F.lit(0.0))
    if size == 1:
        return [[1 / det]]
    return [[(1 if (i + j) % 2 == 0 else -1) * _det(_minor(m, j, i)) / det for j in range(size)] for i in range(size)]


def ols(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], tag: str = "", where: Column | None = None) -> DataFrame:
    """Least squares with intercept per group: n, coefficients b_<x>, standard errors se_<x>, t_<x>, r2, adj_r2,
    resid_var, y_var. Rows with any missing value are left out; a sample of n <= k + 2 has no coefficients.

    One partial aggregate of centred second moments; the solve of the (at most 4 x 4) normal equations is a Column.
    """
    names = [y, *xs]
    used = rows.dropna(subset=names)
    if where is not None:
        used = used.where(where)
    n = F.count(F.lit(1))
    aggregates = [n.alias("n")] + [F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]
    aggregates += [F.covar_pop(names[i], names[j]).alias(f"_s{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    moments = used.groupBy(*by).agg(*aggregates)
    size, k = len(xs), len(xs) + 1
    n = F.col("n")
    scatter = [[n * F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(1, k)] for i in range(1, k)]
    inverse = _inverse(scatter)
    solved = moments.withColumns({f"_v{i}_{j}": inverse[i][j] for i in range(size) for j in range(i, size)})

    def inv(i, j):
        return F.col(f"_v{min(i, j)}_{max(i, j)}")

    def total(parts):
        out = F.lit(0.0)
        for p in parts:
            out = out + p
        return out

    solved = solved.withColumns({f"_b{i}": total(inv(i, j) * n * F.col(f"_s0_{j + 1}") for j in range(size)) for i in range(size)})
    syy = n * F.col("_s0_0")
    sse = syy - total(F.col(f"_b{i}") * n * F.col(f"_s0_{i + 1}") for i in range(size))
    enough = n > k + 2
    solved = solved.withColumns({"_sse": sse, "_sigma2": F.when(enough, sse / F.nullif(n - k, F.lit(0)))})
    const = F.col("_m0") - total(F.col(f"_b{i}") * F.col(f"_m{i + 1}") for i in range(size))
    spread = 1 / n + total(F.col(f"_m{i + 1}") * inv(i, j) * F.col(f"_m{j + 1}") for i in range(size) for j in range(size))
    out = {"b_const": const, "se_const": F.sqrt(F.greatest(F.col("_sigma2") * spread, F.lit(0.0)))}
    for i, x in enumerate(xs):
        out[f"b_{x}"] = F.col(f"_b{i}")
        out[f"se_{x}"] = F.sqrt(F.greatest(F.col("_sigma2") * inv(i, i), F.lit(0.0)))
    out["r2"] = F.when(syy > 0, 1 - F.col("_sse") / F.nullif(syy, F.lit(0.0)))
    out["resid_var"], out["y_var"] = F.col("_sse") / F.nullif(n - 1, F.lit(0)), syy / F.nullif(n - 1, F.lit(0))
    fitted = solved.withColumns(out)
    more = {f"t_{x}": F.col(f"b_{x}") / F.nullif(F.col(f"se_{x}"), F.lit(0.0)) for x in ["const", *xs]}
    more["adj_r2"] = 1 - (1 - F.col("r2")) * (n - 1) / F.nullif(n - k, F.lit(0))
    results = [*out, *more]
    fitted = fitted.withColumns(more)
    return fitted.select(*by, F.col("n").alias(f"n{tag}"), *[F.when(F.col("n") > k + 2, F.col(c)).alias(f"{c}{tag}") for c in results])


def single_index(series: DataFrame, factors: DataFrame) -> DataFrame:
    """Alpha, beta, fit and variance split per entity against the market's excess return."""
    rows = series.join(factors.select("session", "rate_ret", "mkt_excess"), "session").withColumn("y", F.col("ret") - F.col("rate_ret"))
    by = ["kind", "entity"]
    fit = ols(rows, by, "y", ["mkt_excess"]).where(F.col("b_mkt_excess").isNotNull())
    # on the rows with a missing series value the market does not count either
    market = rows.dropna(subset=["y", "mkt_excess"]).groupBy(*by).agg(F.var_samp("mkt_excess").alias("_mv"))
    total, systematic = F.col("y_var") * TRADING_DAYS, F.pow("b_mkt_excess", F.lit(2)) * F.col("_mv") * TRADING_DAYS
    return fit.join(market, by).select(
        *by, F.col("n").alias("observations"), (F.col("b_const") * TRADING_DAYS * 100).alias("alpha_annual_pct"),
        F.col("t_const").alias("alpha_t"), half_even("b_mkt_excess", 3).alias("beta"), F.col("se_mkt_excess").alias("beta_se"),
        F.col("r2").alias("r_squared"), (F.sqrt(total) * 100).alias("total_vol_pct"), (F.sqrt(systematic) * 100).alias("systematic_vol_pct"),
        (F.sqrt(F.greatest(total - systematic, F.lit(0.0))) * 100).alias("unsystematic_vol_pct"))


def multi_factor(series: DataFrame, factors: DataFrame, xs: Sequence[str] = ("mkt_excess", "crude_ret", "bond_ret")) -> DataFrame:
    """Several factors against the single index on the same rows."""
    rows = (series.join(factors.select("session", "rate_ret", *xs), "session").withColumn("y", F.col("ret") - F.col("rate_ret"))
            .dropna(subset=["y", *xs]))
    by = ["kind", "entity"]
    multi, single = ols(rows, by, "y", xs), ols(rows, by, "y", xs[:1], tag="_1")
    both = multi.join(single, by).where(F.col(f"b_{xs[0]}").isNotNull() & F.col(f"b_{xs[0]}_1").isNotNull())
    return both.withColumn("r2_gain_pp", (F.col("r2") - F.col("r2_1")) * 100)


def capm(single: DataFrame, risk_free: float, premium_pct: float = 7.08) -> DataFrame:
    annual = F.lit(risk_free) + F.col("beta") * premium_pct / 100
    return single.select("kind", "entity", "beta", (annual * 100).alias("expected_pct"),
                         ((F.pow(1 + annual, F.lit(0.25)) - 1) * 100).alias("expected_3m_pct"))


def autocorrelation(series: DataFrame, lags: int = 5, block: int = 5, min_rows: int = 30) -> DataFrame:
    """AR(1), autocorrelations, Ljung-Box Q and the lag-1 correlation of non-overlapping compounded blocks."""
    by = ("kind", "entity")
    window = by_symbol(by)
    rows = series.where(F.col("ret").isNotNull())
    lagged = rows.withColumns({f"lag{k}": F.lag("ret", k).over(window) for k in range(1, lags + 1)}
                              | {"_blk": F.floor((F.row_number().over(window) - 1) / block)})
    stats = lagged.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), *[F.corr("ret", f"lag{k}").alias(f"rho_{k}") for k in range(1, lags + 1)])
    fit = ols(lagged, by, "ret", ["lag1"]).select(*by, F.col("b_lag1").alias("ar1_phi"), F.col("t_lag1").alias("ar1_t"))
    blocks = lagged.groupBy(*by, "_blk").agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    paired = blocks.withColumn("before", F.lag("r").over(by_symbol(by, "_blk")))
    weekly = paired.groupBy(*by).agg(F.corr("r", "before").alias("weekly_rho_1"), F.count(F.lit(1)).alias("_blocks"))
    n = F.col("observations")
    q = sum((F.pow(f"rho_{k}", F.lit(2)) / F.nullif(n - k, F.lit(0)) for k in range(1, lags + 1)), F.lit(0.0)) * n * (n + 2)
    bound = 1.96 / F.sqrt("observations")
    marks = F.concat_ws(", ", *[F.when(F.abs(f"rho_{k}") > bound, str(k)) for k in range(1, lags + 1)])
    joined = stats.join(fit, list(by)).join(weekly, list(by)).where(n >= min_rows)
    return joined.withColumns({"significance_bound": bound, "significant_lags": marks, "ljung_box_q": q,
                               "weekly_bound": 1.96 / F.sqrt("_blocks")}).withColumn("predictable", F.col("ljung_box_q") > LJUNG_BOX_5)


def hedge_betas(portfolio: DataFrame, factors: DataFrame, index: str = "large_ret", tail: float = 0.10) -> DataFrame:
    """Minimum-variance hedge ratio with its fit, downside beta and tail beta (index at or below its quantile)."""
    rows = portfolio.join(factors.select("session", F.col(index).alias("m")), "session").dropna(subset=["ret", "m"])
    # at most one row per session in a portfolio
    cutoff = rows.groupBy("portfolio").agg(F.percentile("m", F.lit(tail)).alias("cutoff"))
    marked = rows.join(cutoff, "portfolio")
    full = ols(marked, ["portfolio"], "ret", ["m"]).select("portfolio", F.col("n").alias("observations"), F.col("b_m").alias("hedge_ratio"), F.col("r2").alias("effectiveness"))
    down = ols(marked, ["portfolio"], "ret", ["m"], where=F.col("m") < 0).select("portfolio", F.col("b_m").alias("downside_beta"))
    worst = ols(marked, ["portfolio"], "ret", ["m"], where=F.col("m") <= F.col("cutoff")).select(
        "portfolio", F.col("b_m").alias("tail_beta"), F.col("se_m").alias("tail_beta_se"), F.col("n").alias("tail_days"))
    return full.join(down, "portfolio").join(worst, "portfolio").join(cutoff, "portfolio")


def exposures(portfolio: DataFrame, benchmarks: DataFrame, window: int = 245, min_rows: int = 60) -> DataFrame:
    """Beta and fit of every portfolio on every benchmark over their last common sessions."""
    rows = portfolio.join(benchmarks, "session").dropna(subset=["ret", "bench_ret"])
    kept = latest_sessions(rows, ["portfolio", "benchmark"], window)
    return kept.groupBy("portfolio", "benchmark").agg(
        F.count(F.lit(1)).alias("days"), (F.covar_samp("ret", "bench_ret") / F.var_samp("bench_ret")).alias("beta"),
        F.pow(F.corr("ret", "bench_ret"), F.lit(2)).alias("r_squared"), ((F.product(1 + F.col("bench_ret")) - 1) * 100).alias("benchmark_return_pct")
    ).where(F.col("days") >= min_rows)


def latest_betas(series: DataFrame, index: DataFrame, key: str, window: int = 245, more_than: int = 20) -> DataFrame:
    """Beta of each series on the index over its last common sessions, null for short histories."""
    rows = series.join(index.select("session", "m"), "session").dropna(subset=["ret", "m"])
    stats = latest_sessions(rows, [key], window).groupBy(key).agg(
        F.count(F.lit(1)).alias("days"), (F.covar_samp("ret", "m") / F.nullif(F.var_samp("m"), F.lit(0.0))).alias("beta"))
    return stats.withColumn("beta", F.when(F.col("days") > more_than, F.col("beta")))


# ---- covariance, contributions, value at risk ----------------------------------------------------------------------

def pairwise_covariance(members: DataFrame, min_rows: int = 60, sessions: int = TRADING_DAYS) -> DataFrame:
    """(portfolio, i, j, cov, overlap): annualised covariance of each ordered pair of a book's members, both orders and
    the diagonal, null with too few common sessions. A self-join by book and session forms each pair once."""
    one = members.select("portfolio", "session", F.col("symbol").alias("i"), F.col("ret").alias("_x"))
    other = members.select("portfolio", "session", F.col("symbol").alias("j"), F.col("ret").alias("_y"))
    pairs = one.join(other, ["portfolio", "session"]).where("i <= j").groupBy("portfolio", "i", "j").agg(
        F.count(F.lit(1)).alias("overlap"), (F.covar_samp("_x", "_y") * sessions).alias("_cov"))
    half = pairs.select("portfolio", "i", "j", "overlap", F.when(F.col("overlap") >= min_rows, F.col("_cov")).alias("cov"))
    mirrored = half.select("portfolio", "overlap", "cov", F.inline(F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
                                                                   .otherwise(F.array(F.struct("i", "j")))))
    return mirrored.select("portfolio", "i", "j", "overlap", "cov")


def risk_shares(covariance: DataFrame, weights: DataFrame, weight: str = "weight") -> DataFrame:
    """(portfolio, symbol, weight, share): each weight's share of the portfolio variance, summing to 1."""
    other = weights.select("portfolio", F.col("symbol").alias("j"), F.col(weight).alias("_wj"))
    marginal = covariance.join(other, ["portfolio", "j"]).groupBy("portfolio", F.col("i").alias("symbol")).agg(
        F.sum(F.col("cov") * F.col("_wj")).alias("_marginal"))
    rows = weights.join(marginal, ["portfolio", "symbol"]).withColumn("_part", F.col(weight) * F.col("_marginal"))
    return rows.withColumn("share", F.col("_part") / F.sum("_part").over(Window.partitionBy("portfolio"))).drop("_marginal", "_part")


def complete_sessions(positions: DataFrame, window: int = 245) -> DataFrame:
    """(portfolio, session, held, pnl): P&L of today's positions on each of the last sessions where all of them have a
    return; `held` keeps the short list of members."""
    sizes = positions.groupBy("portfolio").agg(F.countDistinct("symbol").alias("_size"))
    per_day = positions.where(F.col("ret").isNotNull()).groupBy("portfolio", "session").agg(
        F.count(F.lit(1)).alias("_present"), F.sum(F.col("x") * F.col("ret")).alias("pnl"),
        F.collect_list(F.struct("symbol", "x", "ret")).alias("held"))
    return latest_sessions(per_day.join(sizes, "portfolio").where(F.col("_present") == F.col("_size")), ["portfolio"], window).drop("_present", "_size")


def value_at_risk(days: DataFrame, horizon: int, base: DataFrame) -> DataFrame:
    """Parametric and historical VaR and expected shortfall at 95% and 99%, with the diversification benefit.

    The quadratic form x'Cx is the variance of the P&L series, so no matrix is formed."""
    stats = days.groupBy("portfolio").agg(
        F.stddev_samp("pnl").alias("sigma"), F.percentile("pnl", F.lit(0.05)).alias("_q95"), F.percentile("pnl", F.lit(0.01)).alias("_q99"),
        F.count(F.lit(1)).alias("sessions"))
    tails = days.join(stats, "portfolio").groupBy("portfolio").agg(
        (-F.avg(F.when(F.col("pnl") <= F.col("_q95"), F.col("pnl")))).alias("cvar_95"),
        (-F.avg(F.when(F.col("pnl") <= F.col("_q99"), F.col("pnl")))).alias("cvar_99"))
    alone = components(days).groupBy("portfolio").agg(F.sum("standalone").alias("_alone"))
    out = stats.join(tails, "portfolio").join(alone, "portfolio").join(base, "portfolio")
    return out.select(
        "portfolio", "sessions", "value", (Z_95 * F.col("sigma")).alias("parametric_95"), (Z_99 * F.col("sigma")).alias("parametric_99"),
        (Z_95 * F.col("sigma") * float(horizon) ** 0.5).alias("parametric_95_horizon"), (-F.col("_q95")).alias("historical_95"),
        (-F.col("_q99")).alias("historical_99"), "cvar_95", "cvar_99", (F.col("_alone") - Z_95 * F.col("sigma")).alias("diversification"),
        (Z_95 * F.col("sigma") / F.col("value") * 100).alias("parametric_95_pct"))


def components(days: DataFrame) -> DataFrame:
    """Standalone, marginal and component 95% VaR per position; components add up to the portfolio's."""
    rows = days.select("portfolio", "pnl", F.inline("held"))
    parts = rows.groupBy("portfolio", "symbol").agg(
        F.max("x").alias("x"), F.stddev_samp("ret").alias("_sd"), F.covar_samp("ret", "pnl").alias("_c"), F.stddev_samp("pnl").alias("_sigma"))
    marginal = Z_95 * F.col("_c") / F.nullif(F.col("_sigma"), F.lit(0.0))
    out = parts.select("portfolio", "symbol", "x", (Z_95 * F.col("_sd") * F.abs("x")).alias("standalone"), marginal.alias("marginal"),
                       (F.col("x") * marginal).alias("component"))
    return out.withColumn("share_pct", F.col("component") / F.sum("component").over(Window.partitionBy("portfolio")) * 100)


# ---- performance ---------------------------------------------------------------------------------------------------

def rate_of_return(flows: Column, steps: int = 100) -> Column:
    """Annual rate at which dated flows (array of struct(years, amount)) are worth nothing: bisection in (-99.99%,
    10000%); null without a change of sign."""
    def worth(rate):
        return F.aggregate(flows, F.lit(0.0), lambda acc, f: acc + f["amount"] / F.pow(1 + rate, f["years"]))

    low, high = F.lit(-0.9999), F.lit(100.0)
    start = F.struct(low.alias("lo"), high.alias("hi"), worth(low).alias("at_lo"))

    def halve(state, _):
        mid = (state["lo"] + state["hi"]) / 2
        value = worth(mid)
        left = state["at_lo"] * value <= 0
        return F.struct(F.when(left, state["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(state["hi"]).alias("hi"),
                        F.when(left, state["at_lo"]).otherwise(value).alias("at_lo"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(worth(low) * worth(high) <= 0, found)


def in_windows(rows: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Each row once per named window (label, first day, last day) it falls into: a short literal list, no join."""
    spans = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for label, a, b in windows])
    inside = F.filter(spans, lambda w: (F.col("session") >= w["a"]) & (F.col("session") <= w["b"]))
    return rows.select("*", F.explode(inside).alias("_w")).withColumn("period", F.col("_w.label")).drop("_w")


def window_metrics(rows: DataFrame, by: Sequence[str] = ("portfolio", "period")) -> DataFrame:
    """Return, risk and risk-adjusted metrics of p against m with risk-free rf, per group."""
    by = list(by)
    used = rows.dropna(subset=["p", "m", "rf"])
    running = so_far(tuple(by))
    paths = used.withColumns({"_gp": F.product(1 + F.col("p")).over(running), "_gm": F.product(1 + F.col("m")).over(running)})
    # the peak starts at the first return's level
    paths = paths.withColumns({"_dp": F.col("_gp") / F.max("_gp").over(running) - 1, "_dm": F.col("_gm") / F.max("_gm").over(running) - 1})
    p, m, rf = F.col("p"), F.col("m"), F.col("rf")
    year = float(TRADING_DAYS)
    up, down = m > 0, m < 0
    stats = paths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.min("session").alias("start"), F.max("session").alias("end"),
        F.product(1 + p).alias("gp"), F.product(1 + m).alias("gm"), F.product(1 + rf).alias("gf"),
        (F.stddev_samp("p") * year ** 0.5).alias("sp"), (F.stddev_samp("m") * year ** 0.5).alias("sm"),
        (F.covar_samp(p - rf, m - rf) / F.nullif(F.var_samp(m - rf), F.lit(0.0))).alias("beta"),
        (F.stddev_samp(F.when(p < 0, p)) * year ** 0.5).alias("dsp"), F.min("_dp").alias("max_drawdown"), F.min("_dm").alias("market_drawdown"),
        (F.avg(F.when(up, p)) / F.nullif(F.avg(F.when(up, m)), F.lit(0.0))).alias("up_capture"),
        (F.avg(F.when(down, p)) / F.nullif(F.avg(F.when(down, m)), F.lit(0.0))).alias("down_capture"),
        (F.stddev_samp(p - m) * year ** 0.5).alias("tracking_error"), F.avg(p - m).alias("_active"))
    annual = {f"{a}": F.pow(F.col(g), year / F.col("sessions")) - 1 for a, g in (("rp", "gp"), ("rm", "gm"), ("rfa", "gf"))}
    out = stats.withColumns(annual)
    excess = F.col("rp") - F.col("rfa")

    def over(top, bottom):
        return top / F.nullif(F.col(bottom), F.lit(0.0))

    weekday_before = F.date_sub("start", F.when(F.weekday("start") == 0, 3).when(F.weekday("start") == 6, 2).otherwise(1))
    years = F.datediff(F.col("end"), weekday_before) / F.lit(365.0)
    return out.withColumns({
        "return_pct": (F.col("gp") - 1) * 100, "benchmark_pct": (F.col("gm") - 1) * 100, "simple_annual_pct": (F.col("gp") - 1) * year / F.col("sessions") * 100,
        "sharpe": over(excess, "sp"), "market_sharpe": over(F.col("rm") - F.col("rfa"), "sm"), "treynor_pct": over(excess, "beta") * 100,
        "m2_pct": (F.col("rfa") + over(excess, "sp") * F.col("sm")) * 100,
        "jensen_pct": (F.col("rp") - (F.col("rfa") + F.col("beta") * (F.col("rm") - F.col("rfa")))) * 100,
        "jensen_period_pp": ((F.col("gp") - 1) - ((F.col("gf") - 1) + F.col("beta") * (F.col("gm") - F.col("gf")))) * 100,
        "sortino": over(excess, "dsp"), "information_ratio": F.when(F.col("tracking_error") > 0, over(F.col("_active") * year, "tracking_error")),
        # one flow in and one out: the internal rate has a closed form
        "xirr_pct": (F.pow("gp", 1 / F.nullif(years, F.lit(0.0))) - 1) * 100})
