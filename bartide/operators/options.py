"""Option pricing as Column expressions over whole chains, hedge sizing, strategies and scenario evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bartide.functions.numbers import as_col
from bartide.session import cut_lineage

# fixed values: published rational approximation of the normal distribution function (double precision)
CDF_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
              793.826512519948, 440.413735824752)
VOL_LOW, VOL_HIGH, VOL_STEPS = 1e-4, 3.0, 55
MOVES = (-10, -7, -5, -3, -1, 0, 1, 3, 5)
CRASH_MOVES = (-25, -20, -15, -10, -5, 0, 5, 10, 15)
BUCKETS = ((None, -6), (-6, -3), (-3, -1), (-1, 1), (1, 3), (3, None))


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(name: str) -> Column:
    """Standard normal distribution function of a column; beyond 7 standard deviations a continued fraction."""
    x = F.col(name)
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    far = F.lit(0.65) + a
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = F.when(a < 7.07106781186547, bell * _poly(a, CDF_TOP) / _poly(a, CDF_BOTTOM)).otherwise(bell / (far * 2.506628274631))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _staged(rows: DataFrame, spot, strike, t, r, vol, kind) -> DataFrame:
    """Add the inputs of the pricing formula as columns, so that later expressions refer to them instead of repeating
    them; the projections run in one generated stage."""
    inputs = {"_s": as_col(spot), "_k": as_col(strike), "_tt": as_col(t), "_vv": as_col(vol), "_put": as_col(kind) == "PE"}
    rows = rows.withColumns(inputs)
    live = F.coalesce((F.col("_tt") > 0) & (F.col("_vv") > 0), F.lit(False))
    rows = rows.withColumns({"_live": live, "_t1": F.when(live, F.col("_tt")).otherwise(1.0), "_v1": F.when(live, F.col("_vv")).otherwise(1.0)})
    rows = rows.withColumns({"_sd": F.col("_v1") * F.sqrt("_t1"), "_disc": F.col("_k") * F.exp(-as_col(r) * F.col("_t1"))})
    d1 = (F.ln(F.col("_s") / F.col("_k")) + (as_col(r) + F.col("_v1") * F.col("_v1") / 2) * F.col("_t1")) / F.col("_sd")
    return rows.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - F.col("_sd"))


_SCRATCH = ("_s", "_k", "_tt", "_vv", "_put", "_live", "_t1", "_v1", "_sd", "_disc", "_d1", "_d2")


def priced(rows: DataFrame, name: str, spot, strike, t, r, vol, kind) -> DataFrame:
    """Add the European option value; the intrinsic value at expiry or without volatility."""
    staged = _staged(rows, spot, strike, t, r, vol, kind)
    call = F.col("_s") * normal_cdf("_d1") - F.col("_disc") * normal_cdf("_d2")
    # a put by parity costs no further distribution values
    value = call + F.when(F.col("_put"), F.col("_disc") - F.col("_s")).otherwise(0.0)
    gain = F.when(F.col("_put"), F.col("_k") - F.col("_s")).otherwise(F.col("_s") - F.col("_k"))
    return staged.withColumn(name, F.when(F.col("_live"), value).otherwise(F.greatest(gain, F.lit(0.0)))).drop(*_SCRATCH)


def with_greeks(rows: DataFrame, spot, strike, t, r, vol, kind) -> DataFrame:
    """Add per unit: delta, gamma (per point), vega (per volatility point), theta (per day), rho (per rate point)."""
    staged = _staged(rows, spot, strike, t, r, vol, kind)
    put = F.col("_put")
    sign = F.when(put, -1.0).otherwise(1.0)
    staged = staged.withColumns({"_n1": normal_cdf("_d1"), "_n2": normal_cdf("_d2"), "_dens": F.exp(-F.col("_d1") * F.col("_d1") / 2) / F.sqrt(F.lit(2) * F.pi())})
    side = F.when(put, 1 - F.col("_n2")).otherwise(F.col("_n2"))
    inside = F.when(put, F.col("_s") < F.col("_k")).otherwise(F.col("_s") > F.col("_k"))
    flow = F.col("_s") * F.col("_dens")

    def alive(value):
        return F.when(F.col("_live"), value).otherwise(0.0)

    return staged.withColumns({
        "delta": F.when(F.col("_live"), F.col("_n1") - F.when(put, 1.0).otherwise(0.0)).otherwise(F.when(inside, sign).otherwise(0.0)),
        "gamma": alive(F.col("_dens") / (F.col("_s") * F.col("_sd"))), "vega": alive(flow * F.sqrt("_t1") / 100),
        "theta": alive((-flow * F.col("_v1") / (2 * F.sqrt("_t1")) - sign * as_col(r) * F.col("_disc") * side) / 365),
        "rho": alive(sign * F.col("_t1") * F.col("_disc") * side / 100)}).drop(*_SCRATCH, "_n1", "_n2", "_dens")


def _cdf_values(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    bell, near = np.exp(-a * a / 2), np.minimum(a, 7.07106781186547)
    far = 0.65 + a
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = np.where(a < 7.07106781186547, bell * np.polyval(CDF_TOP, near) / np.polyval(CDF_BOTTOM, near), bell / (far * 2.506628274631))
    return np.where(x > 0, 1 - tail, tail)


@F.pandas_udf(T.DoubleType())
def _bisected_vol(premium: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, r: pd.Series, put: pd.Series) -> pd.Series:
    p, s, k, tt = (v.to_numpy(float) for v in (premium, spot, strike, t))
    disc = k * np.exp(-r.to_numpy(float) * tt)
    low, high = np.full(len(p), VOL_LOW), np.full(len(p), VOL_HIGH)
    parity = np.where(put.to_numpy(bool), disc - s, 0.0)
    for _ in range(VOL_STEPS):
        mid = (low + high) / 2
        sd = mid * np.sqrt(tt)
        d1 = (np.log(s / disc) + sd * sd / 2) / sd
        above = s * _cdf_values(d1) - disc * _cdf_values(d1 - sd) + parity > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return pd.Series((low + high) / 2)


def implied_vol(premium, spot, strike, t, r, kind) -> Column:
    """Volatility that reproduces the premium: bisection to double precision over Arrow batches of the chain, all rows
    of a batch at once; null below intrinsic value."""
    premium, spot, strike, t, r, put = as_col(premium), as_col(spot), as_col(strike), as_col(t), as_col(r), as_col(kind) == "PE"
    discounted = strike * F.exp(-r * t)
    floor = F.greatest(F.when(put, discounted - spot).otherwise(spot - discounted), F.lit(0.0))
    usable = F.coalesce((premium > floor + 1e-6) & (t > 0), F.lit(False))
    found = _bisected_vol(premium, spot, strike, F.when(usable, t).otherwise(1.0), r, put)
    return F.when(usable, found)


def years_to(expiry, day) -> Column:
    return F.datediff(as_col(expiry), as_col(day)) / F.lit(365.0)


def with_vol(chain: DataFrame, r: float) -> DataFrame:
    """A chain with open interest and its implied volatility; rows without one are left out."""
    t = years_to("expiry", "trade_date")
    return (chain.where(F.col("oi") > 0).withColumn("t", t)
            .withColumn("iv", implied_vol("settle", "spot", "strike", "t", F.lit(r), "kind")).where(F.col("iv").isNotNull()))


def settled_on_expiry(chain: DataFrame) -> DataFrame:
    """On the expiry day the settlement column holds the final index price: the option is worth its intrinsic value."""
    gain = F.when(F.col("kind") == "PE", F.col("strike") - F.col("settle")).otherwise(F.col("settle") - F.col("strike"))
    return chain.withColumn("settle", F.when(F.col("expiry") == F.col("trade_date"), F.round(F.greatest(gain, F.lit(0.0)), 2)).otherwise(F.col("settle")))


def first_expiry(chain: DataFrame, on_or_after: str) -> DataFrame:
    return chain.groupBy("underlying").agg(F.min(F.when(F.col("expiry") >= F.lit(on_or_after).cast("date"), F.col("expiry"))).alias("expiry"))


def liquid(chain: DataFrame, by: Sequence[str], oi: str = "oi") -> DataFrame:
    """Rows with at least the median open interest of their side (a side has one row per strike)."""
    middle = chain.groupBy(*by).agg(F.percentile(oi, F.lit(0.5)).alias("_mid"))
    return chain.join(middle, list(by)).where(F.col(oi) >= F.col("_mid")).drop("_mid")


def nearest_strikes(chain: DataFrame, factors: dict[str, float], by: Sequence[str] = ("underlying",)) -> DataFrame:
    """One row per group: for every named target (a multiple of spot) the nearest liquid put as a struct, ties to the
    lower strike; one aggregate for all targets."""
    puts = liquid(chain.where(F.col("kind") == "PE"), by)
    leg = F.struct("kind", "strike", F.col("settle").alias("price"), "iv", "expiry")
    picks = [F.min_by(leg, F.struct(F.abs(F.col("strike") - F.col("spot") * f), "strike")).alias(name) for name, f in factors.items()]
    return puts.groupBy(*by).agg(F.max("spot").alias("spot"), *picks)


def put_candidates(chain: DataFrame, needs: DataFrame, lot: int, principal: float) -> DataFrame:
    """Puts from 12% below spot to the money for every book that hedges on the underlying, with lots and cost.

    `needs` has (portfolio, underlying, value, hedge_ratio)."""
    near = (F.col("kind") == "PE") & F.col("strike").between(F.col("spot") * 0.88, F.col("spot") * 1.001) & (F.col("oi") > 0)
    rows = needs.join(chain.where(near), "underlying")
    lots = F.greatest(F.lit(1), F.bround(F.col("hedge_ratio") * F.col("value") / (F.col("spot") * lot)))
    rows = rows.withColumn("lots", lots).withColumn("cost", F.bround(F.col("settle") * F.col("lots") * lot, 0))
    below = F.bround((1 - F.col("strike") / F.col("spot")) * 100, 2)
    return rows.withColumns({"cost_pct": F.bround(F.col("cost") / principal * 100, 2), "below_pct": below,
                             "loss_before_cover_pct": F.bround(below * F.col("hedge_ratio"), 2)})


def tail_put(candidates: DataFrame, otm_pct: float = 5.0) -> DataFrame:
    """Per book the candidate nearest to `otm_pct` below spot among strikes with at least median open interest."""
    others = [c for c in candidates.columns if c != "portfolio"]
    best = liquid(candidates, ["portfolio"]).groupBy("portfolio").agg(
        F.min_by(F.struct(*others), F.struct(F.abs(F.col("below_pct") - otm_pct), "strike")).alias("_p"))
    return best.select("portfolio", "_p.*")


def move_grid(rows: DataFrame, moves: Sequence[float], name: str = "move_pct") -> DataFrame:
    """Every row once per scenario of a short literal grid."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(float(m)) for m in moves])))


def crash_scenarios(plan: DataFrame, lot: int) -> DataFrame:
    """P&L at expiry per index move, bare (falls at the downside beta) and with the puts."""
    rows = move_grid(plan, CRASH_MOVES)
    move = F.col("move_pct")
    beta = F.when(move < 0, F.col("down_ratio")).otherwise(F.col("hedge_ratio"))
    level = F.col("spot") * (1 + move / 100)
    return rows.withColumns({
        "level": level, "bare": F.col("value") * beta * move / 100,
        "payoff": F.greatest(F.col("strike") - level, F.lit(0.0)) * F.col("lots") * lot, "premium": F.col("settle") * F.col("lots") * lot}
    ).withColumn("hedged", F.col("bare") + F.col("payoff") - F.col("premium"))


def open_legs(trades: DataFrame, as_of: str) -> DataFrame:
    """Net option legs per book that expire after `as_of`; shorts are negative."""
    signed = F.when(F.col("action") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    net = trades.groupBy("portfolio", "underlying", "expiry", "strike", "kind").agg(F.sum(signed).alias("units"))
    return net.where((F.col("units") != 0) & (F.col("expiry") > F.lit(as_of).cast("date")))


def core_put(legs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The longest-dated, highest-strike long put per book."""
    long_puts = legs.where((F.col("kind") == "PE") & (F.col("units") > 0))
    return long_puts.groupBy(*by).agg(F.max_by(F.struct("expiry", "strike", "units"), F.struct("expiry", "strike")).alias("_c")).select(*by, "_c.*")


def matched(legs: DataFrame, chain: DataFrame) -> DataFrame:
    """Legs with their chain row; strikes compare on two decimals."""
    keys = ["underlying", "expiry", "kind", "strike2"]
    priced = chain.withColumn("strike2", F.round("strike", 2)).select(*keys, "settle", "iv", "spot", "t", "trade_date")
    return legs.withColumn("strike2", F.round("strike", 2)).join(priced, keys, "left").drop("strike2")


def delta_position(legs: DataFrame, r: float) -> DataFrame:
    """Rupee index exposure of all legs of a book; null as soon as one leg has no price or volatility."""
    rows = with_greeks(legs, "spot", "strike", "t", F.lit(r), "iv", "kind")
    part = F.when(F.col("iv").isNotNull(), F.col("units") * F.col("delta") * F.col("spot"))
    return rows.groupBy("portfolio").agg(F.count(F.lit(1)).alias("legs"), F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias("delta_inr"))


def book_greeks(legs: DataFrame, r: float) -> DataFrame:
    """Greeks of the whole book in units and rupees."""
    rows = with_greeks(legs, "spot", "strike", "t", F.lit(r), "iv", "kind")
    return rows.groupBy("portfolio").agg(*[F.sum(F.col("units") * F.col(n)).alias(n) for n in ("delta", "gamma", "vega", "theta", "rho")])


def sensitivity(legs: DataFrame, stock_delta: DataFrame, r: float, exit_day: str, shock: float = 0.05) -> DataFrame:
    """Book P&L per index move: revalued now, at the exit day and with volatility shocked both ways."""
    rate, contract = F.lit(r), ["spot", "strike", "t", "expiry", "iv", "kind"]
    held = legs.groupBy("portfolio", *contract).agg(F.sum("units").alias("units"))
    base = held.select(*contract).distinct().withColumn("t_exit", F.greatest(years_to("expiry", F.lit(exit_day).cast("date")), F.lit(0.0)))
    rows = move_grid(priced(base, "_base", "spot", "strike", "t", rate, "iv", "kind"), MOVES)
    level = F.col("spot") * (1 + F.col("move_pct") / 100)
    cases = {"now": ("t", 0.0), "at_exit": ("t_exit", 0.0), "vol_up": ("t", shock), "vol_down": ("t", -shock)}
    for name, (t, bump) in cases.items():
        rows = priced(rows, f"_{name}", level, "strike", t, rate, F.greatest(F.col("iv") + bump, F.lit(0.01)) if bump else F.col("iv"), "kind")
    # one row per contract: its change on every move of the short grid, priced once for all books
    moved = rows.groupBy(*contract).agg(F.collect_list(F.struct("move_pct", *[(F.col(f"_{n}") - F.col("_base")).alias(n) for n in cases])).alias("moves"))
    out = held.join(moved, contract).select("portfolio", "units", F.inline("moves")).groupBy("portfolio", "move_pct").agg(*[F.sum(F.col("units") * F.col(n)).alias(n) for n in cases])
    stocks = F.col("stock_delta") * F.col("move_pct") / 100
    return out.join(stock_delta, "portfolio").withColumn("stocks", stocks).withColumns(
        {"total_now": F.col("stocks") + F.col("now"), "total_exit": F.col("stocks") + F.col("at_exit")})


# ---- strategies ----------------------------------------------------------------------------------------------------

STRIKE_TARGETS = {"atm": 1.0, "m2": 0.98, "m3": 0.97, "m5": 0.95}


def strategies(books: DataFrame, chain: DataFrame, expiry: DataFrame) -> DataFrame:
    """(portfolio, strategy, keep, legs): candidate strategies of every book on its underlying, legs as a short array.

    `books` has (portfolio, underlying, held) where held is the core put's leg struct or null, and may have `extra`, an
    array of further legs held (kind, strike, price, iv, expiry, qty) that every strategy which keeps the put keeps too.
    """
    leg_type = "array<struct<kind:string,strike:double,price:double,iv:double,expiry:date,qty:double>>"
    extra = F.coalesce(F.col("extra").cast(leg_type), F.array().cast(leg_type)) if "extra" in books.columns else F.array().cast(leg_type)
    books = books.withColumn("_extra", extra)
    near = chain.join(expiry, ["underlying", "expiry"], "left_semi")
    picks = nearest_strikes(near, STRIKE_TARGETS)
    calls = near.where((F.col("kind") == "CE") & (F.col("strike") > F.col("spot")))
    premium = picks.select("underlying", F.col("m2.price").alias("_m2"))
    call = (calls.join(premium, "underlying").groupBy("underlying").agg(F.min_by(
        F.struct("kind", "strike", F.col("settle").alias("price"), "iv", "expiry"),
        F.struct(F.abs(F.col("settle") - F.col("_m2")), "strike")).alias("call")))
    # the put of the near expiry at the held strike, to be sold against a put held for longer
    same = near.where(F.col("kind") == "PE").select("underlying", F.col("strike").alias("_strike"), F.struct(
        "kind", "strike", F.col("settle").alias("price"), "iv", "expiry").alias("same"))
    rows = (books.join(picks.drop("spot"), "underlying", "left").join(call, "underlying", "left").withColumn("_strike", F.col("held")["strike"])
            .join(same, ["underlying", "_strike"], "left"))

    def leg(name, quantity):
        c = F.col(name)
        return F.struct(c["kind"].alias("kind"), c["strike"].alias("strike"), c["price"].alias("price"), c["iv"].alias("iv"),
                        c["expiry"].alias("expiry"), F.lit(float(quantity)).alias("qty"))

    def put_name(name):
        # null without such a strike, and with it the strategy
        return F.when(F.col(name).isNotNull(), F.format_string("%.0f", F.col(name)["strike"]))

    held = F.struct(*[F.col("held")[c].alias(c) for c in ("kind", "strike", "price", "iv", "expiry")], F.lit(1.0).alias("qty"))
    has = F.col("held").isNotNull()
    kept = F.concat(F.array(held), F.col("_extra"))
    empty = F.array().cast(leg_type)
    pairs = [("atm", "m3"), ("atm", "m5"), ("m2", "m5")]
    wide = {p: F.col(p[0])["strike"] > F.col(p[1])["strike"] for p in pairs}
    first = F.coalesce(*[F.when(wide[p], F.array(leg(p[0], 1), leg(p[1], -1))) for p in pairs])
    options = [(F.when(has, F.lit("Keep the puts held")), F.lit(True), kept), (F.lit("No hedge"), F.lit(False), empty)]
    options += [(F.concat(F.lit(f"Protective put {n} "), put_name(n)), F.lit(False), F.array(leg(n, 1))) for n in ("atm", "m2", "m3")]
    options += [(F.when(wide[p], F.concat(F.lit("Put spread "), put_name(p[0]), F.lit("/"), put_name(p[1]))), F.lit(False),
                 F.array(leg(p[0], 1), leg(p[1], -1))) for p in pairs]
    options += [(F.when(F.col("call").isNotNull(), F.concat(F.lit("Collar "), put_name("m2"), F.lit("/"), put_name("call"))), F.lit(False),
                 F.array(leg("m2", 1), leg("call", -1))),
                # with more legs held the book may have its spread already
                (F.when(has & first.isNotNull() & (F.size("_extra") == 0), F.lit("Keep and add a put spread")), F.lit(True), F.concat(kept, first)),
                (F.when(has & (F.col("same")["expiry"] != F.col("held")["expiry"]), F.lit("Keep and sell the near put")), F.lit(True), F.concat(kept, F.array(leg("same", -1))))]
    every = F.array(*[F.struct(n.alias("strategy"), k.alias("keep"), legs.alias("legs")) for n, k, legs in options])
    spread = rows.select("portfolio", "underlying", F.inline(every)).where(F.col("strategy").isNotNull())
    # strikes that coincide give the same strategy twice
    return spread.groupBy("portfolio", "underlying", "strategy").agg(F.max("keep").alias("keep"), F.max("legs").alias("legs"))


def exploded_value(rows: DataFrame, keys: Sequence[str], spot: Column, horizon: str, r: float, name: str) -> DataFrame:
    """Gain of a strategy per unit at an index level on the horizon day: legs as rows, priced and summed."""
    legs = rows.select(*keys, spot.alias("_level"), F.explode_outer("legs").alias("_l"))
    t = F.greatest(years_to(F.col("_l.expiry"), F.lit(horizon).cast("date")), F.lit(0.0))
    valued = priced(legs, "_v", "_level", F.col("_l.strike"), t, F.lit(r), F.col("_l.iv"), F.col("_l.kind"))
    gain = F.col("_l.qty") * (F.col("_v") - F.col("_l.price"))
    return valued.groupBy(*keys).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias(name))


# What a leg is worth does not depend on who holds it: every different contract is priced once per index level, and books only add up
# those numbers with their quantities.
CONTRACT = ("underlying", "kind", "strike", "iv", "expiry")


def contract_cube(contracts: DataFrame, levels: DataFrame, horizon: str, r: float) -> DataFrame:
    """(contract, spot, scenario, unit): every different contract (CONTRACT, spot) at every different index return of its underlying (underlying, scenario, index_ret)."""
    grid = contracts.select(*CONTRACT, "spot").distinct().join(levels.select("underlying", "scenario", "index_ret").distinct(), "underlying")
    t = F.greatest(years_to("expiry", F.lit(horizon).cast("date")), F.lit(0.0))
    return priced(grid, "unit", F.col("spot") * (1 + F.col("index_ret")), "strike", t, F.lit(r), "iv", "kind").select(*CONTRACT, "spot", "scenario", "unit")


def with_leg_set(plans: DataFrame) -> DataFrame:
    """`leg_set`: equal for plans whose legs are the same."""
    return plans.withColumn("leg_set", F.md5(F.to_json("legs")))


def leg_set_gains(plans: DataFrame, levels: DataFrame, horizon: str, r: float) -> DataFrame:
    """(underlying, leg_set, scenario, gain): gain per unit of each different set of legs, a sparse product of quantities and the contract cube.
    A leg without a volatility counts nothing. `plans` has underlying, leg_set, legs, spot."""
    sets = plans.select("underlying", "leg_set", "spot", "legs").dropDuplicates(["underlying", "leg_set"])
    legs = sets.select("underlying", "leg_set", "spot", F.inline("legs")).where(F.col("iv").isNotNull())
    cube = contract_cube(legs, levels, horizon, r)
    return legs.join(cube, [*CONTRACT, "spot"]).groupBy("underlying", "leg_set", "scenario").agg(F.sum(F.col("qty") * (F.col("unit") - F.col("price"))).alias("gain"))


def scenario_results(plans: DataFrame, scenarios: DataFrame, units: float, horizon: str, r: float) -> DataFrame:
    """(portfolio, strategy, scenario, index_ret, option_pnl, total): every strategy on every supplied scenario of its book.

    `plans` has portfolio, underlying, strategy, legs, spot, value; `scenarios` has portfolio, scenario, index_ret, stock_ret. A scenario has one index_ret
    for all books of an underlying."""
    keyed = cut_lineage(with_leg_set(plans))
    rows = keyed.select("portfolio", "underlying", "strategy", "leg_set", "value").join(scenarios, "portfolio")
    levels = keyed.select("portfolio", "underlying").distinct().join(scenarios, "portfolio")
    gains = leg_set_gains(keyed, levels, horizon, r)
    option = units * F.coalesce("gain", F.lit(0.0))
    return rows.join(gains, ["underlying", "leg_set", "scenario"], "left").select(
        "portfolio", "strategy", "scenario", "index_ret", option.alias("option_pnl"), (F.col("value") * F.col("stock_ret") + option).alias("total"))


def evaluated(results: DataFrame, plans: DataFrame, units: float, horizon: str, r: float) -> DataFrame:
    """Per book and strategy: premium, expected cost, profit probability, VaR and CVaR, and what it saves against none."""
    by = ["portfolio", "strategy"]
    # one row per scenario: the group is bounded by the scenario table
    q5 = F.percentile("total", F.lit(0.05)).over(Window.partitionBy(*by))
    stats = results.withColumn("_q5", q5).groupBy(*by).agg(
        (-F.avg("option_pnl")).alias("expected_cost"), (F.avg((F.col("option_pnl") > 0).cast("double")) * 100).alias("profit_probability"),
        F.avg("total").alias("expected_pnl"), (-F.max("_q5")).alias("var95"), (-F.avg(F.when(F.col("total") <= F.col("_q5"), F.col("total")))).alias("cvar95"),
        (-F.percentile("total", F.lit(0.01))).alias("worst_1pct"))
    keyed = with_leg_set(plans)
    still = keyed.select("underlying", F.lit(0).alias("scenario"), F.lit(0.0).alias("index_ret")).distinct()
    flat = keyed.join(leg_set_gains(keyed, still, horizon, r), ["underlying", "leg_set"], "left").select(*by, F.coalesce("gain", F.lit(0.0)).alias("_flat"))
    premium = F.aggregate(F.transform("legs", lambda g: g["qty"] * g["price"]), F.lit(0.0), lambda a, v: a + v) * units
    out = (stats.join(plans.select(*by, "keep", "value", premium.alias("net_premium")), by).join(flat, by)
           .withColumn("cost_if_unchanged", -units * F.col("_flat")).drop("_flat"))
    base = out.where(F.col("strategy") == "No hedge").select("portfolio", F.col("cvar95").alias("_base"))
    saved = out.join(base, "portfolio").withColumn("cvar_saved", F.col("_base") - F.col("cvar95")).drop("_base")
    return saved.withColumn("saved_per_cost", F.when(F.col("expected_cost") > 0, F.col("cvar_saved") / F.nullif(F.col("expected_cost"), F.lit(0.0))))


def recommended(table: DataFrame, budget_pct: float = 1.0, least_saved_pct: float = 0.5) -> DataFrame:
    """Flag per book the strategy that saves most per rupee inside the budget; free cover ranks first."""
    fits = (F.col("expected_cost") <= F.col("value") * budget_pct / 100) & (F.col("cvar_saved") >= F.col("value") * least_saved_pct / 100)
    ratio = F.when(F.col("expected_cost") > 0, F.col("saved_per_cost")).otherwise(float("inf"))
    place = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("_fits"), F.desc("_ratio"), F.desc("cvar_saved"), "strategy"))
    return (table.withColumns({"_fits": fits, "_ratio": ratio}).withColumn("recommended", (place == 1) & F.col("_fits")).drop("_fits", "_ratio"))


def bucket_of(move_pct) -> Column:
    """Label of the index-move bucket, right-closed."""
    move, out = as_col(move_pct), None
    for low, high in BUCKETS:
        label = f"below {high:+g}%" if low is None else f"above {low:+g}%" if high is None else f"{low:+g}% to {high:+g}%"
        inside = F.lit(True) if high is None else move <= high
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def outcome_buckets(results: DataFrame) -> DataFrame:
    """Mean P&L and probability per strategy and index-move bucket."""
    total = results.groupBy("portfolio", "strategy").agg(F.count(F.lit(1)).alias("_n"))
    parts = results.groupBy("portfolio", "strategy", bucket_of(F.col("index_ret") * 100).alias("bucket")).agg(
        F.count(F.lit(1)).alias("_k"), F.avg("total").alias("mean_pnl"))
    return parts.join(total, ["portfolio", "strategy"]).select("portfolio", "strategy", "bucket", (F.col("_k") / F.col("_n") * 100).alias("probability_pct"), "mean_pnl")


def with_probability_below(rows: DataFrame, name: str, spot, strike, vol, t) -> DataFrame:
    """Add the risk-neutral probability (without drift) that the index ends below the strike."""
    spot, strike, vol, t = (as_col(v) for v in (spot, strike, vol, t))
    z = (F.ln(strike / spot) + vol * vol * t / 2) / (vol * F.sqrt(t))
    return rows.withColumn("_z", z).withColumn(name, normal_cdf("_z")).drop("_z")


# ---- plans for the puts held: one row per book ---------------------------------------------------------------------

def roll_plan(books: DataFrame, lot: int, trigger_pct: float = 10.0, max_rolls: int = 1) -> DataFrame:
    """Profit lock: status and trade per book.

    `books` has pnl_pct, rolls, stocks, cash, spot, hedge_ratio, the held put (held_strike, held_units, held_price) and
    the new put (new_strike, new_price, expiry)."""
    lots = F.greatest(F.lit(1), F.bround(F.col("hedge_ratio") * F.col("stocks") / (F.col("spot") * lot)))
    rows = books.withColumn("lots", lots).withColumn("extra", F.col("lots") * lot - F.coalesce("held_units", F.lit(0)))
    higher = F.col("new_strike") > F.coalesce("held_strike", F.lit(0.0))
    waiting = F.col("pnl_pct") < trigger_pct
    status = (F.when(F.col("rolls") >= max_rolls, "done").when(waiting, "waiting").when(F.col("new_strike").isNull(), "no prices")
              .when(higher, "TRIGGERED").when(F.col("extra") > 0, "TRIGGERED").otherwise("covered"))
    rows = rows.withColumn("status", status)
    fired = F.col("status").isin("TRIGGERED", "covered")
    sale = F.when(fired, F.when(higher, F.coalesce("held_units", F.lit(0)) * F.coalesce("held_price", F.lit(0.0))).otherwise(0.0))
    cost = F.when(fired, F.when(higher, F.col("lots") * lot * F.col("new_price")).otherwise(F.greatest(F.col("extra"), F.lit(0)) * F.col("held_price")))
    buy = F.when(higher, F.col("lots") * lot).otherwise(F.col("extra"))
    trade = F.when((F.col("status") == "TRIGGERED"), F.format_string(
        "BUY %.0f INDEX %s %.0f PE @ %.2f", buy.cast("double"), F.col("expiry").cast("string"),
        F.when(higher, F.col("new_strike")).otherwise(F.col("held_strike")), F.when(higher, F.col("new_price")).otherwise(F.col("held_price"))))
    out = rows.withColumns({"sell_value": sale, "buy_cost": cost, "trade": trade, "gap_pp": F.when(F.col("status") == "waiting", trigger_pct - F.col("pnl_pct"))})
    net = F.col("buy_cost") - F.col("sell_value")
    return out.withColumns({"net_cost": net, "cash_sufficient": F.col("cash") >= net})


def drift_plan(books: DataFrame, lot: int, band_lots: float = 1.0) -> DataFrame:
    """Keep the hedge ratio: buy or sell lots of the core put when the need differs by the band or more."""
    held = F.col("held_units") / lot
    need = F.col("hedge_ratio") * F.col("stocks") / (F.col("spot") * lot)
    rows = books.withColumns({"lots_held": held, "lots_needed": need})
    status = (F.when(F.col("held_units").isNull(), "no puts").when(F.col("roll_status").isin("TRIGGERED", "no prices"), "see profit lock")
              .when(F.abs(need - held) < band_lots, "in band").when(F.col("held_price").isNull() | ~(F.col("held_price") > 0), "no prices").otherwise("REBALANCE"))
    # whole units: the move to the rounded lots, and never more than is held can be sold
    move = F.greatest(((F.greatest(F.lit(1), F.bround(need)) - held) * lot).cast("long"), -F.col("held_units").cast("long"))
    rows = rows.withColumn("status", status).withColumn("change", F.when(F.col("status") == "REBALANCE", move))
    value = F.abs("change") * F.col("held_price")
    return rows.withColumns({"trade_value": value, "cash_sufficient": (F.col("change") <= 0) | (F.col("cash") >= value)})
