from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bartide.functions.numbers import half_away, half_even
from bartide.operators import backtests as bt
from bartide.operators import options as op
from bartide.operators import prep
from bartide.operators import ranking as rank
from bartide.operators import risk as rk
from bartide.operators import weights as wt
from bartide.operators.rolling import smoothed


def series(spark, values, order="session"):
    return spark.createDataFrame([("A", k, None if v is None or math.isnan(v) else float(v)) for k, v in enumerate(values)], f"symbol string, {order} int, x double")


def wilder(values, p):
    y, out = None, []
    for k, x in enumerate(values):
        known = x is not None and not math.isnan(x)
        if k < p - 1:
            out.append(None)
            continue
        if k == p - 1:
            head = [v for v in values[:p] if v is not None and not math.isnan(v)]
            y = sum(head) / len(head) if head else None
        elif known:
            y = x if y is None else (y * (p - 1) + x) / p
        out.append(y)
    return out


@pytest.mark.parametrize("length,hole", [(40, 0.0), (1500, 0.2), (2600, 0.02)])
def test_wilder_closed_form_equals_the_recurrence(spark, length, hole):
    rng = np.random.default_rng(length)
    values = [float("nan") if rng.random() < hole else float(v) for v in rng.normal(50, 20, length)]
    got = [r["y"] for r in smoothed(series(spark, values), {"y": "x"}, 14).orderBy("session").collect()]
    for a, b in zip(got, wilder(values, 14)):
        assert (a is None) == (b is None)
        assert a is None or a == pytest.approx(b, rel=1e-10)


def test_wilder_without_a_seed_starts_at_the_first_value(spark):
    values = [float("nan")] * 20 + [5.0, 7.0]
    got = [r["y"] for r in smoothed(series(spark, values), {"y": "x"}, 14).orderBy("session").collect()]
    assert got[:20] == [None] * 20 and got[20] == 5.0 and got[21] == pytest.approx((5 * 13 + 7) / 14)


def test_decayed_mean_equals_ewm_with_gaps(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(1000) < 0.3, np.nan, rng.normal(10, 3, 1000))
    expected = pd.Series(values).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().to_numpy()
    got = [r["y"] for r in bt.decayed_mean(series(spark, values, "n"), "y", "x", 1 / 14, 14).orderBy("n").collect()]
    for a, b in zip(got, expected):
        assert (a is None) == math.isnan(b)
        assert a is None or a == pytest.approx(b, rel=1e-9)


def test_ranks_and_quantiles_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000)), "id": range(3000), "v": rng.integers(0, 400, 3000) ** 2.0})
    frame.loc[rng.random(3000) < 0.1, "v"] = np.nan
    rows = spark.createDataFrame([(g, int(i), None if math.isnan(v) else float(v)) for g, i, v in frame.itertuples(index=False)], "g string, id int, v double")
    got = rank.with_ranks(rows, ["g"], "v", average="a", percent="p", low="l", high="h").toPandas().set_index("id").sort_index()
    groups = frame.groupby("g")["v"]
    for name, expected in (("a", groups.rank()), ("p", groups.rank(pct=True)), ("l", groups.rank(method="min")), ("h", groups.rank(method="min", ascending=False))):
        np.testing.assert_allclose(got[name].astype(float).to_numpy(), expected.to_numpy())
    q = rank.quantiles(rows, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q8": 0.83}).toPandas().set_index("g")
    for name, share in (("q1", 0.1), ("q5", 0.5), ("q8", 0.83)):
        for g, expected in groups.quantile(share).items():
            assert q.loc[g, name] == pytest.approx(expected)
    placed = rank.with_positions(rows, ["g"], "v", ["id"], "pos").where("v is not null").toPandas()
    for _, part in placed.groupby("g"):
        ordered = part.sort_values(["v", "id"], ascending=[False, True])
        assert ordered["pos"].tolist() == list(range(1, len(part) + 1))


@pytest.mark.parametrize("n", [10, 11, 13, 37])
def test_fifths_equal_qcut(spark, n):
    values = np.random.default_rng(n).permutation(n).astype(float)
    rows = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(values)], "g int, id int, v double")
    got = rank.with_fifths(rows, ["g"], "v", ["id"], "fifth").toPandas().sort_values("id")["fifth"].tolist()
    assert got == (pd.qcut(pd.Series(values).rank(method="first"), 5, labels=False) + 1).tolist()


OPTION = "k int, spot double, strike double, t double, vol double, kind string"


def test_normal_distribution_and_parity(spark):
    xs = [-40.0, -8.0, -3.2, -0.5, 0.0, 0.7, 2.9, 7.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", op.normal_cdf("x").alias("n")).collect()
    for r in rows:
        assert r["n"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-14)
    both = spark.createDataFrame([(1, 22900.0, 22500.0, 15 / 365, 0.137, "PE"), (2, 22900.0, 22500.0, 15 / 365, 0.137, "CE"),
                                  (3, 21000.0, 22000.0, 0.0, 0.2, "PE"), (4, 23000.0, 22000.0, -0.1, 0.2, "PE")], OPTION)
    priced = op.priced(both, "v", "spot", "strike", "t", F.lit(0.0573), "vol", "kind")
    v = {r["k"]: r["v"] for r in priced.collect()}
    assert v[2] - v[1] == pytest.approx(22900 - 22500 * math.exp(-0.0573 * 15 / 365), abs=1e-6)
    assert v[3] == 1000 and v[4] == 0
    back = priced.withColumn("iv", op.implied_vol("v", "spot", "strike", "t", F.lit(0.0573), "kind"))
    iv = {r["k"]: r["iv"] for r in back.collect()}
    assert iv[1] == pytest.approx(0.137, abs=1e-6) and iv[2] == pytest.approx(0.137, abs=1e-6) and iv[3] is None and iv[4] is None


def test_greeks_equal_finite_differences(spark):
    base = spark.createDataFrame([(1, 100.0, 95.0, 0.4, 0.3, "PE"), (2, 100.0, 105.0, 0.4, 0.3, "CE")], OPTION)
    r = F.lit(0.05)
    rows = op.with_greeks(base, "spot", "strike", "t", r, "vol", "kind")
    h = 1e-4
    shifted = {"s+": (F.col("spot") + h, "t", "vol", r), "s-": (F.col("spot") - h, "t", "vol", r), "0": ("spot", "t", "vol", r), "v+": ("spot", "t", F.col("vol") + h, r),
               "v-": ("spot", "t", F.col("vol") - h, r), "t+": ("spot", F.col("t") + h, "vol", r), "t-": ("spot", F.col("t") - h, "vol", r),
               "r+": ("spot", "t", "vol", r + h), "r-": ("spot", "t", "vol", r - h)}
    for name, (s, t, v, rate) in shifted.items():
        rows = op.priced(rows, name, s, "strike", t, rate, v, "kind")
    for x in rows.collect():
        assert x["delta"] == pytest.approx((x["s+"] - x["s-"]) / (2 * h), abs=1e-6)
        assert x["gamma"] == pytest.approx((x["s+"] - 2 * x["0"] + x["s-"]) / h ** 2, abs=1e-4)
        assert x["vega"] == pytest.approx((x["v+"] - x["v-"]) / (2 * h) / 100, abs=1e-6)
        assert x["theta"] == pytest.approx(-(x["t+"] - x["t-"]) / (2 * h) / 365, abs=1e-6)
        assert x["rho"] == pytest.approx((x["r+"] - x["r-"]) / (2 * h) / 100, abs=1e-6)


def test_equal_risk_weights():
    vols = np.array([0.1, 0.2, 0.4])
    np.testing.assert_allclose(wt.level_contributions(np.diag(vols ** 2), 0, 1), (1 / vols) / (1 / vols).sum(), rtol=1e-9)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 8))
    cov = np.cov(a @ rng.normal(size=(8, 8)), rowvar=False)
    w = wt.level_contributions(cov, 0.05, 0.25)
    assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-12 and w.max() <= 0.25 + 1e-12
    free = (w > 0.05 + 1e-9) & (w < 0.25 - 1e-9)
    parts = w * (cov @ w)
    assert np.ptp(parts[free]) < 1e-9 * abs(parts).max()


def test_variance_frontier_and_tangency_are_optimal():
    rng = np.random.default_rng(4)
    cov = np.cov(rng.normal(size=(300, 5)) * [1, 2, 3, 4, 5], rowvar=False)
    mu = np.array([0.1, 0.3, 0.2, 0.5, 0.4])
    w, t = wt.pair_descent(cov, np.zeros(5), 0.05, 0.4), wt.best_ratio(cov, mu)
    tilted = wt.pair_descent(cov, 2.0 * mu, 0.0, 1.0)
    for _ in range(3000):
        other = rng.dirichlet(np.ones(5))
        assert tilted @ cov @ tilted - 2 * mu @ tilted <= other @ cov @ other - 2 * mu @ other + 1e-9
        assert mu @ t / math.sqrt(t @ cov @ t) >= mu @ other / math.sqrt(other @ cov @ other) - 1e-9
        if other.min() >= 0.05 and other.max() <= 0.4:
            assert w @ cov @ w <= other @ cov @ other + 1e-9


def test_regression_recovers_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, (120, 3))
    y = 0.001 + x @ [1.2, -0.4, 0.3] + rng.normal(0, 0.004, 120)
    rows = spark.createDataFrame([("A", float(b), *map(float, a)) for a, b in zip(x, y)], "g string, y double, a double, b double, c double")
    fit = rk.ols(rows, ["g"], "y", ["a", "b", "c"]).first()
    design = np.column_stack([np.ones(120), x])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ coef
    se = np.sqrt(np.diag(resid @ resid / 116 * np.linalg.inv(design.T @ design)))
    for name, c, s in zip(("const", "a", "b", "c"), coef, se):
        assert fit[f"b_{name}"] == pytest.approx(c, rel=1e-8) and fit[f"se_{name}"] == pytest.approx(s, rel=1e-8)
    short = rk.ols(rows.limit(6), ["g"], "y", ["a", "b", "c"]).first()
    assert short["n"] == 6 and short["b_a"] is None


def test_value_at_risk_components_add_up(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(0, 0.02, (300, 3))
    held = [3e6, 2e6, 1e6]
    rows = spark.createDataFrame([(1, f"S{j}", k, held[j], float(r[k, j])) for k in range(300) for j in range(3)], "portfolio int, symbol string, session int, x double, ret double")
    days = rk.complete_sessions(rows, 300)
    base = spark.createDataFrame([(1, 6e6)], "portfolio int, value double")
    out = rk.value_at_risk(days, 4, base).first()
    cov = np.cov(r, rowvar=False)
    sigma = math.sqrt(np.array(held) @ cov @ np.array(held))
    assert out["parametric_95"] == pytest.approx(1.6449 * sigma) and out["parametric_95_horizon"] == pytest.approx(2 * out["parametric_95"])
    parts = rk.components(days).toPandas()
    assert parts["component"].sum() == pytest.approx(out["parametric_95"]) and parts["share_pct"].sum() == pytest.approx(100)
    pnl = r @ held
    assert out["historical_95"] == pytest.approx(-np.quantile(pnl, 0.05)) and out["cvar_95"] == pytest.approx(-pnl[pnl <= np.quantile(pnl, 0.05)].mean())


def test_portfolio_return_renormalises(spark):
    rows = spark.createDataFrame([(1, "A", 0.5, 1, 0.01), (1, "A", 0.5, 2, 0.02), (1, "B", 0.5, 2, 0.04)], "portfolio int, symbol string, weight double, session int, ret double")
    got = {r["session"]: r["ret"] for r in rk.portfolio_returns(rows).collect()}
    assert got == {1: pytest.approx(0.01), 2: pytest.approx(0.03)}


def test_rate_of_return(spark):
    flows = F.array(*[F.struct(F.lit(y).alias("years"), F.lit(a).alias("amount")) for y, a in ((0.0, -100.0), (0.5, 30.0), (1.0, 90.0))])
    same = F.array(*[F.struct(F.lit(0.0).alias("years"), F.lit(1.0).alias("amount"))])
    got = spark.range(1).select(rk.rate_of_return(flows).alias("a"), rk.rate_of_return(same).alias("b")).first()
    assert -100 + 30 / (1 + got["a"]) ** 0.5 + 90 / (1 + got["a"]) == pytest.approx(0, abs=1e-9) and got["b"] is None


def test_ranks_of_large_clustered_groups_are_split_and_exact(spark, monkeypatch):
    monkeypatch.setattr(rank, "SPLIT_ABOVE", 50)
    rng = np.random.default_rng(12)
    values = np.concatenate((rng.normal(0, 1e-9, 900), [1e12, -1e12], rng.integers(0, 5, 60).astype(float)))  # nearly all in one spot
    frame = pd.DataFrame({"g": np.where(np.arange(len(values)) % 7, "big", "small"), "id": range(len(values)), "v": values})
    rows = spark.createDataFrame([(g, int(i), float(v)) for g, i, v in frame.itertuples(index=False)], "g string, id int, v double")
    got = rank.with_ranks(rows, ["g"], "v", average="a", low="l").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["a"].astype(float).to_numpy(), frame.groupby("g")["v"].rank().to_numpy())
    whole = rank.with_ranks(rows, [], "v", low="l").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(whole["l"].astype(float).to_numpy(), frame["v"].rank(method="min").to_numpy())
    plan = rank.value_counts(rows, ["g"], "v", 16)
    assert plan.columns == ["g", "v", "ties", "total", "before"]


def test_sessions_outside_a_calendar_are_unknown(spark):
    bounds = spark.sql("SELECT DATE '2024-01-01' AS first, DATE '2024-01-12' AS last")
    days = spark.sql("SELECT * FROM VALUES (DATE '2024-01-02', DATE '2024-01-09'), (DATE '2023-12-01', DATE '2024-01-09'), (DATE '2024-01-09', DATE '2024-01-02') AS t(a, b)")
    rows = prep.sessions_between(days, prep.weekday_calendar(bounds), "a", "b", "n", at_least=1).orderBy("a").collect()
    assert [r["n"] for r in rows] == [None, 5, 1]


def test_books_without_an_answer_get_no_weights():
    cov = np.array([np.diag([1.0, 2.0, 3.0]), np.diag([2.0, 2.0, 2.0])])
    cut = wt.pair_descent(cov, np.zeros((2, 3)), 0.0, 1.0, rounds=1)
    assert np.isnan(cut[0]).all() and np.allclose(cut[1], 1 / 3)
    whole = wt.pair_descent(cov, np.zeros((2, 3)), 0.0, 1.0)
    assert np.allclose(whole[0], np.array([6, 3, 2]) / 11) and np.allclose(wt.level_contributions(cov, 0.0, 1.0)[1], 1 / 3)
    solved = wt._solved_by_size(lambda c: wt.pair_descent(c, np.zeros(c.shape[:2]), 0.0, 1.0), 0.0, 1.0, pd.Series([[1.0, 0.0, 0.0, 1.0], None, [1.0, None, None, 1.0]], dtype=object))
    assert np.allclose(solved[0], [0.5, 0.5]) and solved[1] is None and solved[2] is None


def test_near_put_is_sold_against_a_longer_one_and_extra_legs_are_kept(spark):
    chain = spark.sql("""SELECT 'I' AS underlying, DATE '2002-01-28' AS expiry, k AS strike, kind, 100.0D AS spot, 2.0D + k / 100 AS settle, 5.0D AS oi, 0.2D AS iv
        FROM VALUES (95.0D, 'PE'), (97.0D, 'PE'), (98.0D, 'PE'), (100.0D, 'PE'), (105.0D, 'CE') AS t(k, kind)""")
    expiry = spark.sql("SELECT 'I' AS underlying, DATE '2002-01-28' AS expiry")
    leg = "named_struct('kind', 'PE', 'strike', 98.0D, 'price', 4.0D, 'iv', 0.2D, 'expiry', DATE '{}')"
    more = "array(named_struct('kind', 'PE', 'strike', 90.0D, 'price', 1.0D, 'iv', 0.2D, 'expiry', DATE '2002-03-28', 'qty', -1.0D))"
    books = spark.sql(f"SELECT 1 AS portfolio, 'I' AS underlying, {leg.format('2002-03-28')} AS held, {more} AS extra UNION ALL SELECT 2, 'I', {leg.format('2002-01-28')}, null")
    found = {(r.portfolio, r.strategy): r.legs for r in op.strategies(books, chain, expiry).collect()}
    near = found[1, "Keep and sell the near put"]
    assert [(x.strike, x.qty, str(x.expiry)) for x in near] == [(98.0, 1.0, "2002-03-28"), (90.0, -1.0, "2002-03-28"), (98.0, -1.0, "2002-01-28")]
    assert len(found[1, "Keep the puts held"]) == 2 and (1, "Keep and add a put spread") not in found
    assert (2, "Keep and sell the near put") not in found and len(found[2, "Keep and add a put spread"]) == 3


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [116.14999999999999, -109.85000000000001, 109.94999999999999, 125.44999999999999, 627.675, -33.175, -562.935, 0.285, 2.675, 2.5, -3.5, 0.25, 0.35, -0.04, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        found = {r.x: (r.e, r.a) for r in rows.select("x", half_even("x", digits).alias("e"), half_away("x", digits).alias("a")).collect()}
        for v in values:
            assert found[v] == duckdb.execute(f"SELECT round_even(CAST('{v!r}' AS DOUBLE), {digits}), round(CAST('{v!r}' AS DOUBLE), {digits})").fetchone(), (v, digits)
            assert str(found[v][0]) != "-0.0" and str(found[v][1]) != "-0.0"
