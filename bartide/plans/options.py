"""Registered queries: chains, implied volatility, Greeks, hedge plans, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from bartide.operators import options as op
from bartide.operators import risk as rk
from bartide.plans import risk as risk_plans
from bartide.plans.catalog import Query
from bartide.plans.market_sql import define, with_tables
from bartide.session import cut_lineage, once
from bartide.sources import market as mk

RATE, LOT, VALUE, PRINCIPAL = 0.0555, 50, 9.7e6, 1e7
HORIZON = "2001-12-10"
UNITS = 9000.0


@once
def chain(spark, folder):
    return op.with_vol(mk.option_chain(spark, folder), RATE)


def expiry_settlement(spark, folder):
    """The chain on the December expiry day, when its settlement column carries the index."""
    day = F.lit("2001-12-28").cast("date")
    rows = mk.option_chain(spark, folder).withColumn("trade_date", day)
    return op.settled_on_expiry(rows.withColumn("settle", F.when(F.col("expiry") == day, F.col("spot")).otherwise(F.col("settle"))))


def chosen_expiry(spark, folder):
    return op.first_expiry(mk.option_chain(spark, folder), "2002-01-15")


def nearest(spark, folder):
    picks = op.nearest_strikes(chain(spark, folder), op.STRIKE_TARGETS, ("underlying", "expiry"))
    return picks.select("underlying", "expiry", "spot", *[F.col(f"{n}.strike").alias(n) for n in op.STRIKE_TARGETS], F.col("m5.price").alias("m5_price"))


def needs(spark, folder):
    """(portfolio, underlying, value, hedge_ratio, down_ratio) from the hedge regressions."""
    betas = risk_plans.hedge_betas(spark, folder)
    return betas.select("portfolio", mk.hedge_underlying("portfolio").alias("underlying"), F.lit(VALUE).alias("value"),
                        F.col("hedge_ratio"), F.greatest("downside_beta", "hedge_ratio").alias("down_ratio"))


def candidates(spark, folder):
    rows = mk.option_chain(spark, folder)
    near = rows.join(op.first_expiry(rows, HORIZON), ["underlying", "expiry"], "left_semi")
    books = needs(spark, folder)
    return op.put_candidates(near, books.withColumn("hedge_ratio", F.col("down_ratio")).drop("down_ratio"), LOT, PRINCIPAL)


def hedge_plan(spark, folder):
    """One row per portfolio: put picked, lots, cost, futures lots for a full hedge and their margin."""
    put = op.tail_put(cut_lineage(candidates(spark, folder)))
    rows = put.drop("hedge_ratio", "value", "underlying").join(needs(spark, folder), "portfolio")
    future = F.col("spot") * 1.01
    exact = F.col("hedge_ratio") * F.col("value") / (future * LOT)
    return rows.withColumns({"future_lots_exact": exact, "future_lots": F.bround(exact)}).withColumns(
        {"future_notional": F.col("future_lots") * future * LOT, "margin": F.col("future_lots") * future * LOT * 0.12,
         "cash_after": PRINCIPAL - F.col("value") - F.col("cost")})


def crash_table(spark, folder):
    return op.crash_scenarios(hedge_plan(spark, folder), LOT)


def legs(spark, folder):
    return op.open_legs(mk.option_trades(spark, folder), "2001-11-05")


def priced_legs(spark, folder):
    return op.matched(legs(spark, folder), chain(spark, folder))


def core_puts(spark, folder):
    return op.core_put(legs(spark, folder), ["portfolio", "underlying"])


def delta_positions(spark, folder):
    return op.delta_position(priced_legs(spark, folder), RATE)


def greeks(spark, folder):
    return op.book_greeks(priced_legs(spark, folder).where(F.col("iv").isNotNull()), RATE)


def stock_delta(spark, folder):
    """Rupees per 1% index move of the stocks of each book: value x beta."""
    held = risk_plans.members(spark, folder)
    index = risk_plans.factors(spark, folder).select("session", F.col("large_ret").alias("m"))
    beta = rk.latest_betas(held, index, "symbol").select("symbol", "beta")
    value = held.select("portfolio", "symbol", (F.col("weight") * VALUE).alias("value")).distinct()
    return value.join(beta, "symbol").groupBy("portfolio").agg(F.sum(F.col("value") * F.col("beta")).alias("stock_delta"))


def sensitivity(spark, folder):
    return op.sensitivity(priced_legs(spark, folder).where(F.col("iv").isNotNull()), stock_delta(spark, folder), RATE, HORIZON)


def books(spark, folder):
    """(portfolio, underlying, held): each portfolio on its hedge index, with the core put where it is priced."""
    held = op.matched(core_puts(spark, folder).withColumn("kind", F.lit("PE")), chain(spark, folder)).where(F.col("iv").isNotNull())
    leg = F.struct("kind", "strike", F.col("settle").alias("price"), "iv", "expiry")
    base = risk_plans.portfolio_return(spark, folder).select("portfolio").distinct().withColumn("underlying", mk.hedge_underlying("portfolio"))
    return base.join(held.select("portfolio", "underlying", leg.alias("held")), ["portfolio", "underlying"], "left")


def strategy_plans(spark, folder):
    rows = cut_lineage(chain(spark, folder))
    table = op.strategies(books(spark, folder), rows, op.first_expiry(rows, HORIZON))
    spot = rows.groupBy("underlying").agg(F.max("spot").alias("spot"))
    return cut_lineage(table.join(spot, "underlying").withColumn("value", F.lit(VALUE)))


def strategy_legs(spark, folder):
    rows = strategy_plans(spark, folder).select("portfolio", "strategy", F.explode_outer("legs").alias("leg"))
    return rows.select("portfolio", "strategy", "leg.kind", "leg.strike", "leg.expiry", "leg.price", "leg.iv", "leg.qty")


def scenarios(spark, folder):
    """The book's own history, scaled from one session to the horizon: one scenario per session."""
    scale = F.sqrt(F.lit(5.0))
    fx = risk_plans.factors(spark, folder).select("session", (F.col("large_ret") * scale).alias("index_ret"))
    rows = risk_plans.portfolio_return(spark, folder).withColumn("stock_ret", F.col("ret") * scale)
    return rows.join(fx, "session").select("portfolio", F.col("session").alias("scenario"), "index_ret", "stock_ret")


def strategy_table(spark, folder):
    plans = strategy_plans(spark, folder)
    results = cut_lineage(op.scenario_results(plans, scenarios(spark, folder), UNITS, HORIZON, RATE))
    return op.recommended(op.evaluated(results, plans, UNITS, HORIZON, RATE))


def strategy_buckets(spark, folder):
    return op.outcome_buckets(op.scenario_results(strategy_plans(spark, folder), scenarios(spark, folder), UNITS, HORIZON, RATE))


def bucket_pivot(spark, folder):
    """Mean P&L per outcome bucket, one column per strategy family."""
    family = F.element_at(F.split("strategy", " "), 1)
    rows = strategy_buckets(spark, folder).withColumn("family", family)
    names = ["Keep", "No", "Protective", "Put", "Collar"]
    return rows.groupBy("bucket").pivot("family", names).agg(F.avg("mean_pnl"))


def payoff(spark, folder):
    plans = op.move_grid(strategy_plans(spark, folder), [k / 2 for k in range(-20, 13)])
    level = F.col("spot") * (1 + F.col("move_pct") / 100)
    value = op.exploded_value(plans, ["portfolio", "strategy", "move_pct", "value"], level, HORIZON, RATE, "_unit")
    beta = needs(spark, folder).select("portfolio", "hedge_ratio", "down_ratio")
    move = F.col("move_pct")
    stock = F.col("value") * F.when(move < 0, F.col("down_ratio")).otherwise(F.col("hedge_ratio")) * move / 100
    return value.join(beta, "portfolio").withColumn("pnl", stock + UNITS * F.col("_unit"))


def below_probability(spark, folder):
    """Probability of ending below each listed put strike at the horizon, at the at-the-money volatility."""
    rows = chain(spark, folder)
    atm = op.nearest_strikes(rows, {"atm": 1.0}, ("underlying", "expiry")).select("underlying", "expiry", F.col("atm.iv").alias("iv_atm"))
    strikes = rows.where(F.col("kind") == "PE").select("underlying", "expiry", "strike", "spot", "trade_date").distinct()
    t = op.years_to(F.lit(HORIZON).cast("date"), "trade_date")
    found = op.with_probability_below(strikes.join(atm, ["underlying", "expiry"]), "_p", "spot", "strike", "iv_atm", t)
    return found.withColumn("probability", F.col("_p") * 100)


# ---- the same in SQL ----

def cdf_sql(x: str) -> str:
    a = f"abs({x})"

    def poly(coefficients):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {a} + {c!r})"
        return out
    far = f"(0.65 + {a})"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k} / {far})"
    tail = f"(CASE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * CAST({poly(op.CDF_TOP)} AS DOUBLE) / {poly(op.CDF_BOTTOM)} ELSE exp(-{a} * {a} / 2) / ({far} * 2.506628274631) END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)".replace(" 0.0352624965998911 ", " 0.0352624965998911::DOUBLE ")


def priced_sql(source: str, spot: str, strike: str, t: str, vol: str, kind: str, out: str, tag: str = "") -> str:
    """Rows of `source` with the option value as column `out`."""
    c1, c2 = cdf_sql(f"bs_d1{tag}"), cdf_sql(f"bs_d2{tag}")
    call = f"(bs_s{tag} * {c1} - bs_k{tag} * bs_disc{tag} * {c2})"
    return f"""SELECT * EXCLUDE (bs_s{tag}, bs_k{tag}, bs_v{tag}, bs_t{tag}, bs_kind{tag}, bs_live{tag}, bs_disc{tag}, bs_d1{tag}, bs_d2{tag}),
  CASE WHEN bs_live{tag} THEN CASE WHEN bs_kind{tag} = 'PE' THEN {call} - bs_s{tag} + bs_k{tag} * bs_disc{tag} ELSE {call} END
    ELSE greatest(CASE WHEN bs_kind{tag} = 'PE' THEN bs_k{tag} - bs_s{tag} ELSE bs_s{tag} - bs_k{tag} END, 0.0) END AS {out}
FROM (SELECT *, bs_d1{tag} - bs_v{tag} * sqrt(bs_t{tag}) AS bs_d2{tag} FROM (SELECT *, exp(-{RATE} * bs_t{tag}) AS bs_disc{tag},
    (ln(bs_s{tag} / bs_k{tag}) + ({RATE} + bs_v{tag} * bs_v{tag} / 2) * bs_t{tag}) / (bs_v{tag} * sqrt(bs_t{tag})) AS bs_d1{tag} FROM (
  SELECT *, {spot} AS bs_s{tag}, {strike} AS bs_k{tag}, CASE WHEN {t} > 0 AND {vol} > 0 THEN CAST({vol} AS DOUBLE) ELSE 1.0::DOUBLE END AS bs_v{tag},
    CASE WHEN {t} > 0 AND {vol} > 0 THEN CAST({t} AS DOUBLE) ELSE 1.0::DOUBLE END AS bs_t{tag}, {kind} AS bs_kind{tag}, coalesce({t} > 0 AND {vol} > 0, false) AS bs_live{tag} FROM ({source}))))"""


define("chain_t", "SELECT *, (expiry - trade_date) / 365.0::DOUBLE AS t FROM chain WHERE oi > 0")
define("iv_start", f"""
SELECT underlying, expiry, strike, kind, spot, settle, t FROM (SELECT *, strike * exp(-{RATE} * t) AS d FROM chain_t) WHERE t > 0
  AND settle > greatest(CASE WHEN kind = 'PE' THEN d - spot ELSE spot - d END, 0.0) + 1e-6""")
define("iv_steps", f"""
SELECT *, {op.VOL_LOW}::DOUBLE AS lo, {op.VOL_HIGH}::DOUBLE AS hi, 0 AS step FROM iv_start
UNION ALL SELECT underlying, expiry, strike, kind, spot, settle, t, CASE WHEN v > settle THEN lo ELSE (lo + hi) / 2 END, CASE WHEN v > settle THEN (lo + hi) / 2 ELSE hi END, step + 1
FROM ({priced_sql('SELECT * FROM iv_steps WHERE step < ' + str(op.VOL_STEPS), 'spot', 'strike', 't', '((lo + hi) / 2)', 'kind', 'v')})""")
define("chain_iv", f"""
SELECT c.*, (s.lo + s.hi) / 2 AS iv FROM chain_t c JOIN iv_steps s ON s.underlying = c.underlying AND s.expiry = c.expiry AND s.strike = c.strike AND s.kind = c.kind WHERE s.step = {op.VOL_STEPS}""")
define("near_put", """
SELECT c.* FROM chain_iv c JOIN (SELECT underlying, expiry, quantile_cont(oi, 0.5) AS mid FROM chain_iv WHERE kind = 'PE' GROUP BY 1, 2) m
  ON m.underlying = c.underlying AND m.expiry = c.expiry WHERE c.kind = 'PE' AND c.oi >= m.mid""")
define("hb", "SELECT p.portfolio, p.session, p.ret, f.large_ret AS m FROM port p JOIN fx f ON f.session = p.session WHERE large_ret IS NOT NULL")
define("needs", f"""
SELECT portfolio, 'Brand#' || CAST(portfolio % 25 + 1 AS VARCHAR) AS underlying, {VALUE}::DOUBLE AS value, h AS hedge_ratio, greatest(h, d) AS down_ratio FROM (
SELECT r.portfolio, regr_slope(ret, m) AS h, regr_slope(ret, m) FILTER (m < 0) AS d FROM hb r GROUP BY 1)""")
define("cands", f"""
SELECT *, round_even(cost / {PRINCIPAL} * 100, 2) AS cost_pct, round_even(below_pct * ratio, 2) AS loss_before_cover_pct FROM (
SELECT n.portfolio, n.underlying, n.value, n.down_ratio AS ratio, c.expiry, c.strike, c.kind, c.spot, c.settle, c.oi, greatest(1, round_even(n.down_ratio * n.value / (c.spot * {LOT}), 0)) AS lots,
  round_even(c.settle * greatest(1, round_even(n.down_ratio * n.value / (c.spot * {LOT}), 0)) * {LOT}, 0) AS cost, round_even((1 - c.strike / c.spot) * 100, 2) AS below_pct
FROM needs n JOIN chain c ON c.underlying = n.underlying JOIN (SELECT underlying, min(expiry) FILTER (expiry >= DATE '{HORIZON}') AS e FROM chain GROUP BY 1) x ON x.underlying = c.underlying AND x.e = c.expiry
WHERE c.kind = 'PE' AND c.strike BETWEEN c.spot * 0.88 AND c.spot * 1.001 AND c.oi > 0)""")
define("tail_pick", """
SELECT c.* FROM cands c JOIN (SELECT portfolio, quantile_cont(oi, 0.5) AS mid FROM cands GROUP BY 1) m ON m.portfolio = c.portfolio WHERE c.oi >= m.mid
QUALIFY row_number() OVER (PARTITION BY c.portfolio ORDER BY abs(below_pct - 5), strike) = 1""")
define("plan_rows", f"""
SELECT *, future_lots * spot * 1.01 * {LOT} AS future_notional, future_lots * spot * 1.01 * {LOT} * 0.12 AS margin, {PRINCIPAL} - value - cost AS cash_after FROM (
SELECT t.*, n.hedge_ratio, n.down_ratio, n.hedge_ratio * t.value / (t.spot * 1.01 * {LOT}) AS future_lots_exact, round_even(n.hedge_ratio * t.value / (t.spot * 1.01 * {LOT}), 0) AS future_lots
FROM tail_pick t JOIN needs n ON n.portfolio = t.portfolio)""")
define("opt_trades", """
SELECT l_suppkey // 8 AS portfolio, p_brand AS underlying, CAST(DATE '2001-12-28' + to_months(CAST(p_size % 3 AS INTEGER)) AS DATE) AS expiry, floor(p_retailprice / 25) * 25.0 AS strike,
  CASE WHEN p_partkey % 2 = 0 THEN 'PE' ELSE 'CE' END AS kind, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 7""")
define("legs", "SELECT portfolio, underlying, expiry, strike, kind, sum(signed) AS units FROM opt_trades GROUP BY ALL HAVING sum(signed) <> 0")
define("legs_iv", """
SELECT l.*, c.settle, c.iv, c.spot, c.t FROM legs l LEFT JOIN chain_iv c ON c.underlying = l.underlying AND c.expiry = l.expiry AND c.kind = l.kind AND round(c.strike, 2) = round(l.strike, 2)""")
define("core", """
SELECT portfolio, underlying, expiry, strike, units FROM legs WHERE kind = 'PE' AND units > 0 QUALIFY row_number() OVER (PARTITION BY portfolio, underlying ORDER BY expiry DESC, strike DESC) = 1""")
define("legs_d", f"""
SELECT *, d1 - iv * sqrt(t) AS d2, strike * exp(-{RATE} * t) AS disc, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS dens FROM (
SELECT *, (ln(spot / strike) + ({RATE} + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM legs_iv)""")
define("legs_g", f"""
SELECT *, {cdf_sql('d1')} - CASE WHEN kind = 'PE' THEN 1 ELSE 0 END AS delta, CASE WHEN kind = 'PE' THEN {cdf_sql('(-d2)')} ELSE {cdf_sql('d2')} END AS side, CASE WHEN kind = 'PE' THEN -1 ELSE 1 END AS sgn FROM legs_d""")
define("stock_d", f"""
SELECT v.portfolio, sum(v.value * b.beta) AS stock_delta FROM (SELECT DISTINCT portfolio, symbol, weight * {VALUE} AS value FROM rets) v JOIN (
SELECT symbol, CASE WHEN count(*) > 20 THEN covar_samp(ret, m) / var_samp(m) END AS beta FROM (SELECT r.symbol, r.ret, f.large_ret AS m FROM rets r JOIN fx f ON f.session = r.session WHERE large_ret IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r.session DESC) <= 245) GROUP BY 1) b ON b.symbol = v.symbol GROUP BY 1""")
MOVE_ROWS = ", ".join(f"({m})" for m in op.MOVES)


def _book_sql(t: str, vol: str, name: str) -> str:
    return priced_sql("SELECT * FROM sens_base", "(spot * (1 + m / 100.0))", "strike", t, vol, "kind", name)


define("sens_base", f"""
SELECT l.portfolio, l.underlying, l.expiry, l.strike, l.kind, l.units, l.iv, l.spot, l.t, greatest(l.expiry - DATE '{HORIZON}', 0) / 365.0::DOUBLE AS tx, g.m, l.v0 FROM ({priced_sql("SELECT * FROM legs_iv WHERE iv IS NOT NULL", "spot", "strike", "t", "iv", "kind", "v0")}) l
CROSS JOIN (VALUES {MOVE_ROWS}) AS g(m)""")
for name, t, vol in (("sens_now", "t", "iv"), ("sens_exit", "tx", "iv"), ("sens_up", "t", "greatest(iv + 0.05, 0.01)"), ("sens_down", "t", "greatest(iv - 0.05, 0.01)")):
    define(name, f"SELECT portfolio, m, sum(units * (v1 - v0)) AS v FROM ({_book_sql(t, vol, 'v1')}) GROUP BY 1, 2")
define("near_chain", f"""
SELECT c.* FROM chain_iv c JOIN (SELECT underlying, min(expiry) FILTER (expiry >= DATE '{HORIZON}') AS e FROM chain_iv GROUP BY 1) x ON x.underlying = c.underlying AND x.e = c.expiry""")
define("near_liquid", """
SELECT c.* FROM near_chain c JOIN (SELECT underlying, quantile_cont(oi, 0.5) AS mid FROM near_chain WHERE kind = 'PE' GROUP BY 1) m ON m.underlying = c.underlying WHERE c.kind = 'PE' AND c.oi >= m.mid""")
define("targets", "SELECT * FROM near_liquid CROSS JOIN (VALUES ('atm', 1.0), ('m2', 0.98), ('m3', 0.97), ('m5', 0.95)) AS g(target, f) QUALIFY row_number() OVER (PARTITION BY underlying, target ORDER BY abs(strike - spot * f), strike) = 1")
define("call_pick", """
SELECT c.* FROM near_chain c JOIN targets t ON t.underlying = c.underlying AND t.target = 'm2' WHERE c.kind = 'CE' AND c.strike > c.spot
QUALIFY row_number() OVER (PARTITION BY c.underlying ORDER BY abs(c.settle - t.settle), c.strike) = 1""")
define("hedgers", "SELECT DISTINCT portfolio, 'Brand#' || CAST(portfolio % 25 + 1 AS VARCHAR) AS underlying FROM port")
define("held_legs", """
SELECT h.portfolio, h.underlying, c.kind, c.strike, c.settle, c.iv, c.expiry FROM hedgers h JOIN core k ON k.portfolio = h.portfolio AND k.underlying = h.underlying
JOIN chain_iv c ON c.underlying = k.underlying AND c.expiry = k.expiry AND c.strike = k.strike AND c.kind = 'PE'""")
_LEG = "{0}.kind, {0}.strike, {0}.settle AS price, {0}.iv, {0}.expiry"


def _t(alias: str) -> str:
    return f"JOIN targets {alias} ON {alias}.underlying = h.underlying AND {alias}.target = '{alias}'"


_SPREADS = [("atm", "m3"), ("atm", "m5"), ("m2", "m5")]
_SPREAD_NAME = "'Put spread ' || CAST(CAST({0}.strike AS BIGINT) AS VARCHAR) || '/' || CAST(CAST({1}.strike AS BIGINT) AS VARCHAR)"
define("spreads", " UNION ALL ".join(
    f"SELECT h.portfolio, h.underlying, {k} AS ord, {_SPREAD_NAME.format(a, b)} AS strategy, '{a}' AS hi, '{b}' AS lo FROM hedgers h {_t(a)} {_t(b)} WHERE {a}.strike > {b}.strike" for k, (a, b) in enumerate(_SPREADS)))
define("all_legs", " UNION ALL ".join([
    "SELECT portfolio, underlying, 'Keep the puts held' AS strategy, true AS keep, kind, strike, settle AS price, iv, expiry, 1.0 AS qty FROM held_legs",
    "SELECT portfolio, underlying, 'No hedge', false, NULL, NULL, NULL, NULL, NULL, NULL FROM hedgers",
    *[f"SELECT h.portfolio, h.underlying, 'Protective put {n} ' || CAST(CAST({n}.strike AS BIGINT) AS VARCHAR), false, {_LEG.format(n)}, 1.0 FROM hedgers h {_t(n)}" for n in ("atm", "m2", "m3")],
    f"SELECT s.portfolio, s.underlying, s.strategy, false, {_LEG.format('t')}, 1.0 FROM spreads s JOIN targets t ON t.underlying = s.underlying AND t.target = s.hi",
    f"SELECT s.portfolio, s.underlying, s.strategy, false, {_LEG.format('t')}, -1.0 FROM spreads s JOIN targets t ON t.underlying = s.underlying AND t.target = s.lo",
    f"SELECT h.portfolio, h.underlying, 'Collar ' || CAST(CAST(m2.strike AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(c.strike AS BIGINT) AS VARCHAR), false, {_LEG.format('m2')}, 1.0 FROM hedgers h {_t('m2')} JOIN call_pick c ON c.underlying = h.underlying",
    f"SELECT h.portfolio, h.underlying, 'Collar ' || CAST(CAST(m2.strike AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(c.strike AS BIGINT) AS VARCHAR), false, {_LEG.format('c')}, -1.0 FROM hedgers h {_t('m2')} JOIN call_pick c ON c.underlying = h.underlying",
    *[f"SELECT s.portfolio, s.underlying, 'Keep and add a put spread', true, {_LEG.format('t')}, {q} FROM (SELECT * FROM spreads QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY ord) = 1) s JOIN held_legs k ON k.portfolio = s.portfolio JOIN targets t ON t.underlying = s.underlying AND t.target = s.{side}"
      for side, q in (("hi", "1.0"), ("lo", "-1.0"))],
    "SELECT k.portfolio, k.underlying, 'Keep and add a put spread', true, k.kind, k.strike, k.settle, k.iv, k.expiry, 1.0 FROM held_legs k WHERE k.portfolio IN (SELECT portfolio FROM spreads)",
    *[f"SELECT k.portfolio, k.underlying, 'Keep and sell the near put', true, {_LEG.format(side)}, {q} FROM held_legs k JOIN near_chain n ON n.underlying = k.underlying AND n.kind = 'PE' AND n.strike = k.strike AND n.expiry <> k.expiry"
      for side, q in (("k", "1.0"), ("n", "-1.0"))]]))
# the same leg twice in one strategy (held and bought) counts twice; equal strategies listed twice count once
define("plan_legs", """
SELECT portfolio, underlying, strategy, keep, kind, strike, price, iv, expiry, qty FROM all_legs WHERE strategy LIKE 'Keep%' UNION ALL
SELECT DISTINCT portfolio, underlying, strategy, keep, kind, strike, price, iv, expiry, qty FROM all_legs WHERE strategy NOT LIKE 'Keep%'""")
define("legs_spot", f"SELECT l.*, s.spot, greatest(l.expiry - DATE '{HORIZON}', 0) / 365.0::DOUBLE AS tx FROM plan_legs l JOIN (SELECT underlying, max(spot) AS spot FROM chain_iv GROUP BY 1) s ON s.underlying = l.underlying")
define("scen", "SELECT p.portfolio, p.session AS scenario, f.large_ret * sqrt(5.0) AS index_ret, p.ret * sqrt(5.0) AS stock_ret FROM port p JOIN fx f ON f.session = p.session")
define("results", f"""
SELECT portfolio, strategy, scenario, any_value(index_ret) AS index_ret, any_value(keep) AS keep, {UNITS} * coalesce(sum(qty * (v - price)), 0) AS option_pnl, {VALUE} * any_value(stock_ret) + {UNITS} * coalesce(sum(qty * (v - price)), 0) AS total
FROM ({priced_sql("SELECT l.*, s.scenario, s.index_ret, s.stock_ret FROM legs_spot l JOIN scen s ON s.portfolio = l.portfolio", "(spot * (1 + index_ret))", "strike", "tx", "iv", "kind", "v")}) GROUP BY 1, 2, 3""")
define("flat", f"""
SELECT portfolio, strategy, -{UNITS} * coalesce(sum(qty * (v - price)), 0) AS cost_if_unchanged, {UNITS} * coalesce(sum(qty * price), 0) AS net_premium FROM ({priced_sql("SELECT * FROM legs_spot", "spot", "strike", "tx", "iv", "kind", "v")}) GROUP BY 1, 2""")
define("strat_table", """
SELECT *, CASE WHEN expected_cost > 0 THEN cvar_saved / expected_cost END AS saved_per_cost FROM (SELECT s.*, b.cvar95 - s.cvar95 AS cvar_saved FROM strat_stats s JOIN strat_stats b ON b.portfolio = s.portfolio AND b.strategy = 'No hedge')""")
define("strat_stats", """
SELECT r.portfolio, r.strategy, any_value(r.keep) AS keep, -avg(option_pnl) AS expected_cost, avg(CASE WHEN option_pnl > 0 THEN 1.0 ELSE 0.0 END) * 100 AS profit_probability, avg(total) AS expected_pnl, -any_value(q.q5) AS var95,
  -avg(total) FILTER (total <= q.q5) AS cvar95, -any_value(q.q1) AS worst_1pct, any_value(f.cost_if_unchanged) AS cost_if_unchanged, any_value(f.net_premium) AS net_premium
FROM results r JOIN (SELECT portfolio, strategy, quantile_cont(total, 0.05) AS q5, quantile_cont(total, 0.01) AS q1 FROM results GROUP BY 1, 2) q ON q.portfolio = r.portfolio AND q.strategy = r.strategy
JOIN flat f ON f.portfolio = r.portfolio AND f.strategy = r.strategy GROUP BY 1, 2""")
BUCKET_SQL = "CASE WHEN index_ret * 100 <= -6 THEN 'below -6%' WHEN index_ret * 100 <= -3 THEN '-6% to -3%' WHEN index_ret * 100 <= -1 THEN '-3% to -1%' WHEN index_ret * 100 <= 1 THEN '-1% to +1%' WHEN index_ret * 100 <= 3 THEN '+1% to +3%' ELSE 'above +3%' END"
define("buckets", f"""
SELECT portfolio, strategy, bucket, count(*) * 100.0 / any_value(n) AS probability_pct, avg(total) AS mean_pnl FROM (SELECT *, {BUCKET_SQL} AS bucket, count(*) OVER (PARTITION BY portfolio, strategy) AS n FROM results) GROUP BY 1, 2, 3""")

QUERIES = [
    Query("chain_implied_vol", "H1 X12 X13 X14 D10", "underlying:s expiry:d strike:2 kind:s spot:4 settle:4 oi:i iv:6", chain, with_tables("SELECT * FROM chain_iv")),
    Query("expiry_day_settlement", "F17", "underlying:s expiry:d strike:2 kind:s settle:2", expiry_settlement, with_tables("""
SELECT underlying, expiry, strike, kind, CASE WHEN expiry = DATE '2001-12-28' THEN round(greatest(CASE WHEN kind = 'PE' THEN strike - spot ELSE spot - strike END, 0.0), 2) ELSE settle END AS settle FROM chain""")),
    Query("chosen_expiry", "K7", "underlying:s expiry:d", chosen_expiry, with_tables("SELECT underlying, min(expiry) FILTER (expiry >= DATE '2002-01-15') AS expiry FROM chain GROUP BY 1")),
    Query("nearest_strikes", "K6", "underlying:s expiry:d spot:4 atm:2 m2:2 m3:2 m5:2 m5_price:4", nearest, with_tables("""
SELECT underlying, expiry, max(spot) AS spot, """ + ", ".join(f"arg_min(strike, (abs(strike - spot * {f}), strike)) AS {n}" for n, f in op.STRIKE_TARGETS.items())
        + ", arg_min(settle, (abs(strike - spot * 0.95), strike)) AS m5_price FROM near_put GROUP BY 1, 2")),
    Query("put_candidates", "F18 J3", "portfolio:i underlying:s expiry:d strike:2 settle:4 oi:i lots:i cost:0 cost_pct:2 below_pct:2 loss_before_cover_pct:2", candidates, with_tables("SELECT * FROM cands")),
    Query("hedge_plan", "H2", "portfolio:i underlying:s strike:2 settle:4 lots:i cost:0 below_pct:2 hedge_ratio:5 down_ratio:5 future_lots_exact:4 future_lots:i future_notional:2 margin:2 cash_after:2", hedge_plan,
          with_tables("SELECT * FROM plan_rows")),
    Query("crash_scenarios", "H3 J14", "portfolio:i move_pct:1 level:4 bare:2 payoff:2 premium:2 hedged:2", crash_table, with_tables(f"""
SELECT *, bare + payoff - premium AS hedged FROM (SELECT portfolio, m AS move_pct, spot * (1 + m / 100.0) AS level, value * CASE WHEN m < 0 THEN down_ratio ELSE hedge_ratio END * m / 100.0 AS bare,
  greatest(strike - spot * (1 + m / 100.0), 0) * lots * {LOT} AS payoff, settle * lots * {LOT} AS premium FROM plan_rows CROSS JOIN (VALUES {", ".join(f"({m})" for m in op.CRASH_MOVES)}) AS g(m))""")),
    Query("open_option_legs", "H4 G2", "portfolio:i underlying:s expiry:d strike:2 kind:s units:2", legs, with_tables("SELECT * FROM legs")),
    Query("core_puts", "K8", "portfolio:i underlying:s expiry:d strike:2 units:2", core_puts, with_tables("SELECT * FROM core")),
    Query("option_delta_position", "H9 J12", "portfolio:i legs:i delta_inr:2", delta_positions, with_tables(
        "SELECT portfolio, count(*) AS legs, CASE WHEN count(iv) = count(*) THEN sum(units * delta * spot) END AS delta_inr FROM legs_g GROUP BY 1")),
    Query("book_greeks", "H8", "portfolio:i delta:4 gamma:6 vega:4 theta:4 rho:4", greeks, with_tables(f"""
SELECT portfolio, sum(units * delta) AS delta, sum(units * dens / (spot * iv * sqrt(t))) AS gamma, sum(units * spot * dens * sqrt(t) / 100) AS vega,
  sum(units * (-spot * dens * iv / (2 * sqrt(t)) - sgn * {RATE} * disc * side) / 365) AS theta, sum(units * sgn * t * disc * side / 100) AS rho FROM legs_g WHERE iv IS NOT NULL GROUP BY 1""")),
    Query("stock_index_delta", "H13", "portfolio:i stock_delta:2", stock_delta, with_tables("SELECT * FROM stock_d")),
    Query("book_sensitivity", "H8", "portfolio:i move_pct:1 stocks:2 now:2 at_exit:2 vol_up:2 vol_down:2 total_now:2 total_exit:2", sensitivity, with_tables("""
SELECT n.portfolio, n.m AS move_pct, d.stock_delta * n.m / 100 AS stocks, n.v AS now, e.v AS at_exit, u.v AS vol_up, w.v AS vol_down, d.stock_delta * n.m / 100 + n.v AS total_now, d.stock_delta * n.m / 100 + e.v AS total_exit
FROM sens_now n JOIN sens_exit e ON e.portfolio = n.portfolio AND e.m = n.m JOIN sens_up u ON u.portfolio = n.portfolio AND u.m = n.m JOIN sens_down w ON w.portfolio = n.portfolio AND w.m = n.m
JOIN stock_d d ON d.portfolio = n.portfolio""")),
    Query("strategy_legs", "H5", "portfolio:i strategy:s kind:s strike:2 expiry:d price:4 iv:6 qty:1", strategy_legs, with_tables("SELECT * FROM plan_legs")),
    Query("strategy_table", "H6 K9 G10", "portfolio:i strategy:s keep:b net_premium:2 cost_if_unchanged:2 expected_cost:2 profit_probability:4 expected_pnl:2 var95:2 cvar95:2 worst_1pct:2 cvar_saved:2 saved_per_cost:4 recommended:b", strategy_table,
          with_tables(f"""
SELECT *, fits AND row_number() OVER (PARTITION BY portfolio ORDER BY fits DESC, CASE WHEN expected_cost > 0 THEN saved_per_cost ELSE 'Infinity'::DOUBLE END DESC, cvar_saved DESC, strategy) = 1 AS recommended FROM (
SELECT *, expected_cost <= {VALUE} * 1.0 / 100 AND cvar_saved >= {VALUE} * 0.5 / 100 AS fits FROM strat_table)""")),
    Query("strategy_buckets", "G16", "portfolio:i strategy:s bucket:s probability_pct:4 mean_pnl:2", strategy_buckets, with_tables("SELECT * FROM buckets")),
    Query("strategy_bucket_pivot", "G25", "bucket:s Keep:2 No:2 Protective:2 Put:2 Collar:2", bucket_pivot, with_tables(
        "SELECT bucket, " + ", ".join(f"avg(mean_pnl) FILTER (split_part(strategy, ' ', 1) = '{n}') AS \"{n}\"" for n in ("Keep", "No", "Protective", "Put", "Collar")) + " FROM buckets GROUP BY 1")),
    Query("payoff_curves", "H7", "portfolio:i strategy:s move_pct:1 pnl:2", payoff, with_tables(f"""
SELECT r.portfolio, strategy, m AS move_pct, {VALUE} * CASE WHEN m < 0 THEN down_ratio ELSE hedge_ratio END * m / 100 + unit AS pnl FROM (
SELECT portfolio, strategy, m, {UNITS} * coalesce(sum(qty * (v - price)), 0) AS unit FROM ({priced_sql("SELECT l.*, g.k / 2.0::DOUBLE AS m FROM legs_spot l CROSS JOIN (SELECT unnest(range(-20, 13)) AS k) g", "(spot * (1 + m / 100))", "strike", "tx", "iv", "kind", "v")}) GROUP BY 1, 2, 3) r
JOIN needs n ON n.portfolio = r.portfolio""")),
    Query("probability_below_strikes", "H12", "underlying:s expiry:d strike:2 probability:5", below_probability, with_tables(f"""
SELECT underlying, expiry, strike, {cdf_sql('z')} * 100 AS probability FROM (SELECT s.*, (ln(s.strike / s.spot) + a.iv_atm * a.iv_atm * tt / 2) / (a.iv_atm * sqrt(tt)) AS z FROM (
SELECT DISTINCT underlying, expiry, strike, spot, (DATE '{HORIZON}' - trade_date) / 365.0::DOUBLE AS tt FROM chain_iv WHERE kind = 'PE') s
JOIN (SELECT underlying, expiry, arg_min(iv, (abs(strike - spot), strike)) AS iv_atm FROM near_put GROUP BY 1, 2) a ON a.underlying = s.underlying AND a.expiry = s.expiry)""")),
]
