"""Cross-sectional studies: signal panels, scorecards, rule comparisons, stop rules.

Signals are window columns over a calendar-complete panel (one exchange by symbol); the panel is cut to the rebalance
dates before anything runs across symbols, so the second exchange moves only those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.operators import indicators as ind
from bartide.operators import rolling as rl
from bartide.operators.prep import chained_prices, on_calendar
from bartide.operators.ordering import average_rank, placed, stacked, with_percentiles
from bartide.operators.ranking import quantiles, top_rows, with_fifths
from bartide.operators.screening import conviction, quadrant, selected
from bartide.session import cut_lineage

ORDER = "n"


def price_panel(bars: DataFrame, calendar: DataFrame, bench: DataFrame, jump_limit: float | None = None) -> DataFrame:
    """Calendar-complete panel of chained prices; one missing session inside the history takes the previous value."""
    chained = chained_prices(bars, jump_limit).withColumn("deliv", F.col("deliv_qty") / F.nullif(F.col("qty"), F.lit(0.0)) * 100)
    values = ["adj_close", "adj_high", "adj_low", "deliv", "turnover"]
    dense = on_calendar(chained, calendar, values)
    names = dict(zip(values, ["close", "high", "low", "deliv", "turnover"]))
    filled = dense.select("symbol", "n", "session", *[rl.carried_once_inside(v, order=ORDER).alias(o) for v, o in names.items()])
    return filled.join(F.broadcast(bench), "session").withColumn("history", F.count("close").over(rl.so_far(order=ORDER)))


def spread_over(rows: int, skip: int = 0) -> Column:
    """Stock minus benchmark return in pp over `rows` sessions that end `skip` sessions ago."""
    def ratio(c):
        return rl.back(c, skip, order=ORDER) / rl.back(c, skip + rows, order=ORDER) - 1
    return (ratio("close") - ratio("bench")) * 100


def forward_spread(horizon: int) -> Column:
    def ratio(c):
        return rl.ahead(c, horizon, order=ORDER) / F.col(c) - 1
    return (ratio("close") - ratio("bench")) * 100


def trend_columns(panel: DataFrame, min_rows: int = 40) -> DataFrame:
    """(symbol, n, adx, di_gap, rsi) on the sessions with prices."""
    known = panel.dropna(subset=["close", "high", "low"]).select("symbol", "n", F.col("n").alias("session"), "high", "low", "close")
    osc = ind.oscillators(known).where(F.col("total") >= min_rows)
    return osc.select("symbol", F.col("session").alias("n"), "adx", (F.col("plus_di") - F.col("minus_di")).alias("di_gap"), "rsi")


def is_rebalance(warmup: int, every: int, horizon: int, total: str = "total") -> Column:
    """Every k-th session after the warm-up whose horizon ends inside the calendar (n counts from 1)."""
    return (F.col("n") > warmup) & ((F.col("n") - 1 - warmup) % every == 0) & (F.col("n") - 1 + horizon < F.col(total))


def onto_dates(rows: DataFrame, calendar: DataFrame, reach: int, warmup: int, every: int, horizon: int, skip: int = 0) -> DataFrame:
    """`rows` once for every rebalance date `d` in whose window of `reach` rows, ended `skip` rows before `d`, they lie (a symbol has a row a session).

    Windows are only wanted on these dates; a sliding frame would add up all its rows again on every session."""
    start, n = F.lit(warmup + 1), F.col("n")
    first = (start + F.ceil(F.greatest(n + skip - start, F.lit(0)) / every) * every).cast("int")
    last = F.least(n + skip + reach - 1, F.col("_total") - horizon).cast("int")
    total = calendar.agg(F.max("n").alias("_total"))  # one row
    dated = rows.join(F.broadcast(total)).withColumns({"_first": first, "_end": last}).where("_first <= _end")
    return dated.withColumn("d", F.explode(F.sequence("_first", "_end", F.lit(every)))).drop("_first", "_end", "_total")


def median_on_dates(rows: DataFrame, dates: DataFrame, value: str, reach: int, least: int) -> DataFrame:
    """(symbol, n, median) of the `reach` rows up to each rebalance date of `dates` (n), null below `least` known values: a symbol's values are one array by
    session (a row a session, bounded by the calendar), and only what a date needs of it is sorted."""
    whole = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("n", value))).alias("_all"))
    days = F.broadcast(dates.agg(F.sort_array(F.collect_set("n")).alias("_days")))  # one row
    each = whole.join(days).select("symbol", F.col(f"_all.{value}").alias("_v"), F.col("_all")[0]["n"].alias("_low"), F.explode("_days").alias("n"))
    each = each.where((F.col("n") >= F.col("_low")) & (F.col("n") < F.col("_low") + F.size("_v")))
    start = F.greatest(F.col("n") - reach + 1 - F.col("_low"), F.lit(0)) + 1
    known = each.select("symbol", "n", F.sort_array(F.array_compact(F.slice("_v", start, F.col("n") - F.col("_low") + 2 - start))).alias("_k"))
    size = F.size("_k")
    middle = (F.get("_k", F.floor((size - 1) / 2).cast("int")) + F.get("_k", F.floor(size / 2).cast("int"))) / 2
    return known.select("symbol", "n", F.when(size >= least, middle).alias("median"))


def momentum_moves(panel: DataFrame, windows: Sequence[int], horizon: int) -> DataFrame:
    """Signals that compare two sessions, for every session."""
    return panel.withColumns({f"rs_{w}": spread_over(w) for w in windows} | {
        "rs_10": spread_over(10), "rs_skip": spread_over(105, 21), "fwd_rs": forward_spread(horizon), "ret126": F.col("close") / rl.back("close", 126, order=ORDER) - 1,
        "bench126": F.col("bench") / rl.back("bench", 126, order=ORDER) - 1})


def rolled_on_dates(dated: DataFrame) -> DataFrame:
    """(symbol, n, rolling values) per rebalance date, from rows of `onto_dates` over 252 sessions with `daily` returns; the minimum counts let
    short gaps through."""
    def roll(c, how, rows, least):
        inside = F.when(F.col("n") > F.col("d") - rows, F.col(c))
        return F.when(F.count(inside) >= least, how(inside))

    wanted = {"high_20": ("high", F.max, 20, 15), "high_252": ("high", F.max, 252, 200), "sd_63": ("daily", F.stddev_samp, 63, 50), "sd_126": ("daily", F.stddev_samp, 126, 100),
              "ma_200": ("close", F.avg, 200, 180), "deliv_21": ("deliv", F.avg, 21, 15), "deliv_126": ("deliv", F.avg, 126, 100),
              "turnover_21": ("turnover", F.avg, 21, 15), "turnover_126": ("turnover", F.avg, 126, 100)}
    return dated.groupBy("symbol", "d").agg(*[roll(*how).alias(f"_{name}") for name, how in wanted.items()]).withColumnRenamed("d", "n")


def momentum_signals(moves: DataFrame, rolled: DataFrame) -> DataFrame:
    """All per-symbol signals on the rebalance dates: `moves` cut to them and `rolled` windows. The distance to the
    high is rounded to 9 digits: a close at the high is exactly 0 there, whatever the rounding of the chained prices."""
    over = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return moves.join(rolled, ["symbol", "n"]).withColumns({
        "burst_share": F.when(F.col("rs_63") > 0, F.col("rs_10") / over("rs_63") * 100),
        "dist_high": F.round((F.col("close") / F.col("_high_20") - 1) * 100, 9), "high_52w": F.col("close") / F.col("_high_252"),
        "vol_63": F.col("_sd_63") * 252 ** 0.5 * 100, "rs_126_per_vol": F.col("rs_126") / over("_sd_126"), "above_ma200": (F.col("close") / F.col("_ma_200") - 1) * 100,
        "deliv_trend": F.col("_deliv_21") - F.col("_deliv_126"), "turnover_trend": F.col("_turnover_21") / over("_turnover_126")}).drop(
        *[c for c in rolled.columns if c.startswith("_")])


def with_sector_spread(rows: DataFrame, ret: str = "ret126", bench: str = "bench126") -> DataFrame:
    """Sector mean return against the benchmark and own return against the sector mean, in pp."""
    mean = F.broadcast(cut_lineage(rows.groupBy("sector", "n").agg(F.avg(ret).alias("_mean"))))  # sectors x dates
    return rows.join(mean, ["sector", "n"], "left").withColumns({
        "sector_rs_126": (F.col("_mean") - F.col(bench)) * 100, "rs_126_vs_sector": (F.col(ret) - F.col("_mean")) * 100}).drop("_mean")


def with_composite(rows: DataFrame) -> DataFrame:
    """Mean percentile of 126-session strength and closeness to the 52-week high, per date: both in one sort. `rows` are read several times."""
    ranked = with_percentiles(rows, ["n"], ["symbol"], {"rs_126": "_a", "high_52w": "_b"})
    return ranked.withColumn("composite", (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def with_flags(rows: DataFrame, split_day: str) -> DataFrame:
    return rows.withColumns({
        "period": F.when(F.col("session") <= F.lit(split_day).cast("date"), "in sample").otherwise("out of sample"),
        "burst": F.coalesce(F.col("burst_share") > 50, F.lit(False)), "strong_trend": F.coalesce((F.col("adx") > 25) & (F.col("di_gap") > 0), F.lit(False)),
        "overbought": F.coalesce(F.col("rsi") > 70, F.lit(False)), "near_high": F.coalesce(F.col("dist_high") >= -2, F.lit(False))})


# ---- scorecards ----------------------------------------------------------------------------------------------------

def with_repeats(panel: DataFrame) -> DataFrame:
    """Marks the rows whose symbol comes more than once on their date."""
    return panel.withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("symbol", "n", "period")) > 1)


def once_a_symbol(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, values) with one row per symbol and group, the largest of each value: only rows marked `repeated` have to meet for that."""
    met = rows.where("repeated").groupBy(*by, "symbol").agg(*[F.max(v).alias(v) for v in values])
    return rows.where("not repeated").select(*by, *values).unionByName(met.select(*by, *values))


def tall_signals(panel: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(signal, n, period, symbol, value, fwd_rs): one job scores every signal."""
    each = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])
    marks = [c for c in ("repeated",) if c in panel.columns]
    return panel.select("symbol", "n", "period", "fwd_rs", *marks, F.inline(each)).where(F.col("value").isNotNull())


def date_scores(tall: DataFrame, top: int = 8, least: int = 25) -> DataFrame:
    """Per signal and date: rank correlation with the forward spread, top fifth against all, and whether the best and
    worst `top` beat the market. Signals of all groups are ranked in one sort; a second one by forward spread takes along the first rank and
    nothing else. Rows that `with_repeats` did not mark meet no others of their symbol."""
    by = ["signal", "n", "period"]
    if "repeated" not in tall.columns:
        tall = tall.withColumn("repeated", F.lit(True))
    rows = tall.select(*by, "symbol", "repeated", *[F.col(c).cast("double").alias(c) for c in ("value", "fwd_rs")])
    # ties of the best rows go by symbol: counted from the top of each run
    from_top = F.col("_total") - F.col("_before") - F.col("_ties") + (F.col("_place") - F.col("_before"))
    ranked = placed(rows, by, "value", ["symbol"]).where(F.col("_total") >= least).withColumns({"_ra": average_rank(), "_low": F.col("_place"), "_high": from_top})
    again = F.when(F.col("repeated"), F.col("symbol")).alias("symbol")
    moved = placed(ranked.select(*by, "repeated", again, "_ra", "fwd_rs"), by, "fwd_rs").withColumn("_rb", average_rank())
    ic = once_a_symbol(moved, by, ["_ra", "_rb"]).groupBy(*by).agg(F.corr("_ra", "_rb").alias("ic"))
    paired = once_a_symbol(ranked, by, ["value", "fwd_rs", "_low", "_high", "_before", "_ties", "_total"])
    spot = F.lit(0.8) * (F.col("_total") - 1)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_ties"))
    mean = lambda chosen: F.avg(F.when(chosen, F.col("fwd_rs")))
    stats = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("names"), F.avg("fwd_rs").alias("all_fwd"),
        (mean(F.col("_high") <= top) > 0).alias("best_beats"), (mean(F.col("_low") <= top) > 0).alias("worst_beats"),
        F.max(F.when(holds(F.floor(spot)), F.col("value"))).alias("_lower"), F.max(F.when(holds(F.ceil(spot)), F.col("value"))).alias("_upper"), F.max(spot - F.floor(spot)).alias("_share"))
    stats = cut_lineage(stats.withColumn("_q80", F.col("_lower") + (F.col("_upper") - F.col("_lower")) * F.col("_share")))  # a row per signal and date
    fifth = paired.join(F.broadcast(stats.select(*by, "_q80")), by).where(F.col("value") >= F.col("_q80")).groupBy(*by).agg(F.avg("fwd_rs").alias("top_fwd"))
    return stats.join(fifth, by).join(ic, by).select(*by, "ic", "names", (F.col("top_fwd") - F.col("all_fwd")).alias("spread"), "best_beats", "worst_beats")


def rank_correlation(rows: DataFrame, by: Sequence[str], a: str, b: str, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spearman correlation per group: exact average ranks of both columns from one sort, then a plain correlation."""
    ranks = placed(stacked(rows, [*by, *key], [a, b]), [*by, "name"], "x", key)
    of = lambda name: F.max(F.when(F.col("name") == name, average_rank()))
    paired = ranks.groupBy(*by, *key).agg(of(a).alias("_ra"), of(b).alias("_rb"))
    return paired.groupBy(*by).agg(F.corr("_ra", "_rb").alias("ic"), F.count(F.lit(1)).alias("names"))


def labelled(rows: DataFrame) -> DataFrame:
    """Each row under its period and under 'all'."""
    return rows.withColumn("label", F.explode(F.array(F.lit("all"), F.col("period"))))


def every_third_t(rows: DataFrame, by: Sequence[str], value: str, scaled: bool = True) -> DataFrame:
    """(by, t): mean over standard error of every third non-null value in date order (non-overlapping horizons); null
    with two values or fewer."""
    known = rows.where(F.col(value).isNotNull())
    place = F.row_number().over(Window.partitionBy(*by).orderBy("n"))
    kept = known.withColumn("_p", place).where((F.col("_p") - 1) % 3 == 0)
    sd = F.stddev_samp(value)
    return kept.groupBy(*by).agg(F.when((F.count(value) > 2) & (sd > 0), F.avg(value) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count(value))).alias("t"))


def scorecard(scores: DataFrame) -> DataFrame:
    rows = labelled(scores)
    by = ["label", "signal"]
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), (F.avg((F.col("ic") > 0).cast("double")) * 100).alias("ic_positive_pct"),
        F.avg("spread").alias("top_fifth_pp"), (F.avg(F.col("best_beats").cast("double")) * 100).alias("best_beat_pct"),
        (F.avg(F.col("worst_beats").cast("double")) * 100).alias("worst_beat_pct"))
    return stats.join(every_third_t(rows, by, "ic"), by, "left")


def conditional_effect(panel: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Inside the top fifth by 126-session strength on each date: forward spread with and without each flag."""
    cut = quantiles(panel, ["n"], "rs_126", {"q80": 0.8})
    top = labelled(panel.join(cut, "n").where(F.col("rs_126") >= F.col("q80")))
    each = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])
    rows = top.select("label", "fwd_rs", F.inline(each))
    on, fwd = F.col("on"), F.col("fwd_rs")
    out = rows.groupBy("label", "flag").agg(
        F.count_if(on).alias("n_with"), F.count_if(~on).alias("n_without"), F.avg(F.when(on, fwd)).alias("with_pp"), F.avg(F.when(~on, fwd)).alias("without_pp"),
        (F.avg(F.when(on, (fwd > 0).cast("double"))) * 100).alias("with_beat_pct"), (F.avg(F.when(~on, (fwd > 0).cast("double"))) * 100).alias("without_beat_pct"))
    return out.withColumn("difference_pp", F.col("with_pp") - F.col("without_pp"))


def rule_against_universe(panel: DataFrame, passes: Column) -> DataFrame:
    per_date = panel.groupBy("n", "period").agg(F.avg(F.when(passes, F.col("fwd_rs"))).alias("rule"), F.avg("fwd_rs").alias("all"))
    rows = labelled(per_date.where(F.col("rule").isNotNull()))
    return rows.groupBy("label").agg(F.avg(F.col("rule") - F.col("all")).alias("vs_universe_pp"), (F.avg((F.col("rule") > 0).cast("double")) * 100).alias("beat_pct"),
                                     F.count(F.lit(1)).alias("dates"))


def reliability(card: DataFrame, panel: DataFrame) -> DataFrame:
    """Verdict per signal: same sign in both periods, its portfolio beats the base rate in both, |t| of all at least 2."""
    base = (panel.groupBy("n", "period").agg(F.avg("fwd_rs").alias("_f")).groupBy("period").agg((F.avg((F.col("_f") > 0).cast("double")) * 100).alias("base")))
    per = card.where(F.col("label") != "all").join(base, F.col("label") == F.col("period"))
    full = card.where(F.col("label") == "all").select("signal", F.col("t").alias("t_all"))
    mean = per.groupBy("signal").agg(F.avg("mean_ic").alias("_m"))
    judged = per.join(mean, "signal").withColumn("_beat", F.when(F.col("_m") > 0, F.col("best_beat_pct")).otherwise(F.col("worst_beat_pct")))
    both = judged.groupBy("signal").agg(
        F.max(F.when(F.col("label") == "in sample", F.col("mean_ic"))).alias("ic_in"), F.max(F.when(F.col("label") == "out of sample", F.col("mean_ic"))).alias("ic_out"),
        (F.bool_and(F.col("mean_ic") > 0) | F.bool_and(F.col("mean_ic") < 0)).alias("_same"), F.bool_and(F.col("_beat") > F.col("base")).alias("_beats"), F.max("_m").alias("_m"))
    return both.join(full, "signal", "left").select(
        "signal", "ic_in", "ic_out", "t_all", F.when(F.col("_m") > 0, "top").otherwise("bottom").alias("side"),
        (F.col("_same") & F.col("_beats") & F.coalesce(F.abs("t_all") >= 2, F.lit(False))).alias("reliable"))


# ---- rule comparisons ----------------------------------------------------------------------------------------------

def rotation_signals(panel: DataFrame, sectors: DataFrame, horizon: int, lookback: int = 63, span: int = 5, gap: int = 10) -> DataFrame:
    """Strength and smoothed momentum against the market and against the sector mean, per session."""
    base = panel.withColumns({"ret63": F.col("close") / rl.back("close", lookback, order=ORDER) - 1, "mkt63": F.col("bench") / rl.back("bench", lookback, order=ORDER) - 1})
    base = base.join(sectors, "symbol")
    mean = F.broadcast(base.groupBy("sector", "n").agg(F.avg("ret63").alias("_mean")))  # sectors x calendar
    both = base.join(mean, ["sector", "n"], "left").withColumns({"x_n": (F.col("ret63") - F.col("mkt63")) * 100, "x_s": (F.col("ret63") - F.col("_mean")) * 100})
    return both.withColumns({"y_n": rl.mean_shift("x_n", span, gap, order=ORDER), "y_s": rl.mean_shift("x_s", span, gap, order=ORDER),
                             "rs_skip": spread_over(105, 21), "fwd_rs": forward_spread(horizon)}).drop("_mean")


def with_conviction(rows: DataFrame) -> DataFrame:
    marked = rows.withColumns({"_q1": quadrant("x_n", "y_n"), "_q2": quadrant("x_s", "y_s")})
    return marked.withColumn("conviction", conviction("_q1", "_q2")).drop("_q1", "_q2")


def eligible_rows(rows: DataFrame, gap_floor: float, min_history: int) -> DataFrame:
    return rows.where((F.col("di_gap") >= gap_floor) & (F.col("history") >= min_history))


def best_of(rows: DataFrame, rule: str, size: int, order: str = "rs_skip", ascending: bool = False) -> DataFrame:
    """(rule, n, period, symbol, fwd_rs): the best `size` rows per date."""
    key = F.asc(order) if ascending else F.desc(order)
    picked = top_rows(rows.where(F.col(order).isNotNull()), ["n"], size, key, F.col("symbol"))
    return picked.select(F.lit(rule).alias("rule"), "n", "period", "symbol", "fwd_rs")


def per_date(picks: DataFrame) -> DataFrame:
    return picks.groupBy("rule", "n", "period").agg(F.avg("fwd_rs").alias("outcome"))


def outcome_table(dates: DataFrame) -> DataFrame:
    return labelled(dates).groupBy("label", "rule").agg(
        F.count("outcome").alias("dates"), F.avg("outcome").alias("mean_pp"), (F.avg((F.col("outcome") > 0).cast("double")) * 100).alias("beat_pct"),
        F.stddev_samp("outcome").alias("sd_pp"), F.min("outcome").alias("worst_pp"))


def paired_differences(dates: DataFrame, baseline: str, two_sided: bool = False) -> DataFrame:
    """Each rule minus the baseline on the same dates: means per period, t of non-overlapping dates, adoption."""
    base = dates.where(F.col("rule") == baseline).select("n", F.col("outcome").alias("_b"))
    rows = dates.where(F.col("rule") != baseline).join(base, "n").withColumn("diff", F.col("outcome") - F.col("_b"))
    means = rows.groupBy("rule", "period").agg(F.avg("diff").alias("_d"))
    wide = means.groupBy("rule").agg(F.max(F.when(F.col("period") == "in sample", F.col("_d"))).alias("diff_in"),
                                     F.max(F.when(F.col("period") == "out of sample", F.col("_d"))).alias("diff_out"), F.bool_and(F.col("_d") > 0).alias("_up"))
    joined = wide.join(every_third_t(rows, ["rule"], "diff"), "rule", "left")
    strength = F.abs("t") if two_sided else F.col("t")
    return joined.select("rule", "diff_in", "diff_out", "t", (F.col("_up") & F.coalesce(strength >= 2, F.lit(False))).alias("adopt"))


def changed_dates(picks: DataFrame, first: str, second: str) -> DataFrame:
    """Per date whether two rules pick different sets (of at most a handful each)."""
    def members(rule):
        return F.array_sort(F.collect_set(F.when(F.col("rule") == rule, F.col("symbol"))))
    return picks.groupBy("n").agg((members(first) != members(second)).alias("changed"))


def quota_picks(rows: DataFrame, rule: str, size: int, minimums: DataFrame | None) -> DataFrame:
    """Per date: the best of each sector up to its minimum, the rest by rank. Only what a rule can pick is ordered: the best
    `size` of a date and of each sector in it."""
    best = (F.desc_nulls_last("rs_skip"), F.col("symbol"))
    reach = top_rows(rows, ["n"], size, *best).unionByName(top_rows(rows, ["n", "sector"], size, *best)).distinct()
    ranked = reach.withColumn("selection_rank", F.row_number().over(Window.partitionBy("n").orderBy(*best)))
    chosen = selected(ranked, size, minimums, None, by=["n"])
    return ranked.join(chosen.select("n", "symbol"), ["n", "symbol"], "left_semi").select(F.lit(rule).alias("rule"), "n", "period", "symbol", "fwd_rs", "sector")


def residual_momentum(moves: DataFrame, dated: DataFrame, market: DataFrame, skip: int = 21, window: int = 126, beta_window: int = 252) -> DataFrame:
    """Residual momentum and frog-in-the-pan on each rebalance date, from moments only.

    The beta is pairwise covariance over the market's full-window variance, both over `beta_window` sessions that end
    `skip` ago; residual sums over the shorter window follow from sums, variances and covariances of (r, m).
    `moves` has one row per symbol and date; `dated` the returns `r` of `onto_dates` over `beta_window` rows and `skip`; `market` is
    (n, m, m_mean, m_var) with the market's own rolling moments on the calendar.
    """
    rows = dated.join(F.broadcast(market.select("n", "m")), "n").withColumn("mr", F.when(F.col("r").isNotNull(), F.col("m")))
    short = F.col("n") > F.col("d") - window
    rows = rows.withColumns({"_r": F.when(short, F.col("r")), "_mr": F.when(short, F.col("mr"))})
    sums = rows.groupBy("symbol", "d").agg(
        F.covar_samp("r", "mr").alias("_cov"), F.avg("r").alias("_rmean"), F.count("_r").alias("_k"), F.sum("_r").alias("_sr"), F.sum("_mr").alias("_sm"),
        F.var_samp("_r").alias("_vr"), F.var_samp("_mr").alias("_vm"), F.covar_samp("_r", "_mr").alias("_c"), F.count_if(F.col("_r") > 0).alias("_pos"),
        F.count_if(F.col("_r") < 0).alias("_neg"), (F.product(1 + F.col("_r")) - 1).alias("_total")).withColumnRenamed("d", "n")
    out = moves.join(sums, ["symbol", "n"], "left").join(F.broadcast(market.select("n", "m_mean", "m_var")), "n")
    out = out.withColumn("_beta", F.col("_cov") / F.nullif(F.col("m_var"), F.lit(0.0)))
    b, k = F.col("_beta"), F.col("_k")
    total = F.col("_sr") - b * F.col("_sm") - k * (F.col("_rmean") - b * F.col("m_mean"))
    spread = F.sqrt(F.greatest(F.col("_vr") + b * b * F.col("_vm") - 2 * b * F.col("_c"), F.lit(0.0)))
    return out.withColumns({"resid_mom": total / F.nullif(spread, F.lit(0.0)),
                            "pan": F.signum("_total") * (F.col("_neg") - F.col("_pos")) / F.nullif(k, F.lit(0))}).drop("_beta", *[c for c in sums.columns if c.startswith("_")])


def decayed_mean(rows: DataFrame, name: str, value: str, alpha: float, min_rows: int, block: int = 400) -> DataFrame:
    """Exponentially weighted mean that starts at the first value; a missing row still ages the old weight.

    With d = (1 - alpha)^(rows since the last value), y' = (d y + alpha x) / (d + alpha). Logs of the decay are summed
    within blocks, so that nothing overflows; what is older than one whole block is dropped (below 1e-12).
    """
    order = rl.by_symbol(order=ORDER)
    x, before = F.col(value), order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_i": F.row_number().over(order), "_seen": F.count(value).over(rl.so_far(order=ORDER))})
    out = out.withColumn("_gap", F.col("_i") - F.last(F.when(x.isNotNull(), F.col("_i")), ignorenulls=True).over(before))
    d = F.pow(F.lit(1 - alpha), F.col("_gap"))
    first = x.isNotNull() & (F.col("_seen") == 1)
    out = out.withColumns({"_blk": F.floor((F.col("_i") - 1) / block), "_log": F.when(x.isNotNull() & ~first, F.ln(d / (d + alpha))).otherwise(0.0),
                           "_in": F.when(first, x).when(x.isNotNull(), alpha * x / (d + alpha)).otherwise(0.0)})
    inside = Window.partitionBy("symbol", "_blk").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_cum", F.sum("_log").over(inside))
    out = out.withColumn("_part", F.exp("_cum") * F.sum(F.col("_in") * F.exp(-F.col("_cum"))).over(inside))
    ends = Window.partitionBy("symbol").orderBy("_blk").rangeBetween(-1, -1)
    out = out.withColumn("_last", F.max(F.struct(ORDER, "_part")).over(ends)["_part"])
    y = F.col("_part") + F.exp("_cum") * F.coalesce("_last", F.lit(0.0))
    return out.withColumn(name, F.when(F.col("_seen") >= min_rows, y)).drop("_i", "_seen", "_gap", "_blk", "_log", "_in", "_cum", "_part", "_last")


def stop_outcomes(picks: DataFrame, panel: DataFrame, horizon: int, multiple: float, trail: bool = True, target: float | None = None,
                  cost: float = 0.0025) -> DataFrame:
    """(n, symbol, held, stopped, exited): end value per unit under holding and under the stop rule.

    `picks` has n, symbol, close, atr at entry; `panel` n, symbol, close, atr. The stop is a running maximum, the first
    breach a minimum, the exit the next session with a price.
    """
    steps = picks.select(F.col("n").alias("n0"), "symbol", F.col("close").alias("px"), (F.col("close") - multiple * F.col("atr")).alias("stop0"))
    days = steps.withColumn("n", F.explode(F.sequence(F.col("n0") + 1, F.col("n0") + horizon))).join(
        panel.select("symbol", "n", "close", "atr"), ["symbol", "n"], "left")
    slot = Window.partitionBy("n0", "symbol").orderBy("n")
    running = slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.greatest(F.col("stop0"), F.max(F.when(F.col("close").isNotNull(), F.col("close") - multiple * F.col("atr"))).over(running)) if trail else F.col("stop0")
    hit = F.coalesce(F.col("close") <= level, F.lit(False))
    if target is not None:
        hit = hit | F.coalesce(F.col("close") >= F.col("px") + target * (F.col("px") - F.col("stop0")), F.lit(False))
    marked = days.withColumn("_hit", hit)
    first = F.min(F.when(F.col("_hit"), F.col("n"))).over(Window.partitionBy("n0", "symbol"))
    marked = marked.withColumn("_first", first)
    exit_close = F.min_by("close", F.when((F.col("n") > F.col("_first")) & F.col("close").isNotNull(), F.col("n")))
    ends = marked.groupBy("n0", "symbol").agg(
        F.max("px").alias("px"), F.coalesce(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("n"))), F.max("px")).alias("_end"), exit_close.alias("_exit"))
    held = F.col("_end") / F.col("px")
    return ends.select(F.col("n0").alias("n"), "symbol", held.alias("held"),
                       F.when(F.col("_exit").isNotNull(), F.col("_exit") / F.col("px") * (1 - cost)).otherwise(held).alias("stopped"), F.col("_exit").isNotNull().alias("exited"))


def universe_scores(rows: DataFrame, size: int = 8, least: int = 10) -> DataFrame:
    """Per universe and date: mean forward spread of the best `size`, rank correlation, and top minus bottom fifth."""
    by = ["universe", "n", "period"]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("names"))
    best = top_rows(rows, by, size, F.desc("rs_skip"), F.col("symbol")).groupBy(*by).agg(F.when(F.count(F.lit(1)) >= size, F.avg("fwd_rs")).alias("top"))
    enough = cut_lineage(rows.join(counts.where(F.col("names") >= least).select(*by), by, "left_semi"))
    ic = rank_correlation(enough, by, "rs_skip", "fwd_rs").select(*by, "ic")
    fifths = with_fifths(enough, by, "rs_skip", ["symbol"], "fifth").groupBy(*by).agg(
        (F.avg(F.when(F.col("fifth") == 5, F.col("fwd_rs"))) - F.avg(F.when(F.col("fifth") == 1, F.col("fwd_rs")))).alias("fifth_spread"))
    return counts.join(best, by, "left").join(ic, by, "left").join(fifths, by, "left")


def banded(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Right-closed bands (low, high]; the last is open."""
    band, column = None, F.col(value)
    for low, high in zip(edges, [*edges[1:], None]):
        inside = (column > low) if high is None else (column > low) & (column <= high)
        label = f"({low:g}, {'inf' if high is None else f'{high:g}'}]"
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return rows.withColumn("band", band)
