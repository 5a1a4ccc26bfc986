"""Technical indicators as window columns over bars keyed (symbol, session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.functions.numbers import TRADING_DAYS, half_even
from bartide.operators.rolling import by_symbol, in_blocks, latest, rolling, smoothed, smoothed_in_blocks

# fixed values: labels of the trend column
BULLISH, BEARISH, NEUTRAL, NO_TREND = "Bullish (Uptrend)", "Bearish (Downtrend)", "Neutral", "N/A (Insufficient History)"


def true_range(previous) -> Column:
    """max(high - low, |high - previous|, |low - previous|); greatest() skips a missing previous close."""
    previous = F.col(previous) if isinstance(previous, str) else previous
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def oscillators(bars: DataFrame, period: int = 14, carry: tuple[str, ...] = (), textbook: bool = False) -> DataFrame:
    """RSI, +DI, -DI, DX, ADX and trend for every bar.

    One exchange by symbol and two sorts serve all windows. `textbook` seeds the ADX from the first real DX instead of counting the
    warm-up rows as zeros.
    """
    window = by_symbol()
    prev = F.lag("close").over(window)
    change, up, down = F.col("close") - prev, F.col("high") - F.lag("high").over(window), F.lag("low").over(window) - F.col("low")
    inputs = bars.select(
        "symbol", "session", "high", "low", "close", *carry, F.row_number().over(window).alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("total"),
        F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))).alias("gain"),
        F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))).alias("loss"),
        true_range(prev).alias("tr"), F.when((up > down) & (up > 0), up).otherwise(0.0).alias("pdm"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("mdm"))
    columns = {"avg_gain": "gain", "avg_loss": "loss", "atr": "tr", "avg_pdm": "pdm", "avg_mdm": "mdm"}
    out = smoothed_in_blocks(in_blocks(inputs, period), columns, period)
    gain, loss = F.col("avg_gain"), F.col("avg_loss")
    rsi = (F.when(F.col("total") <= period, None).when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0)
           .when(gain == 0, 0.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0)))))

    def directional(part: str) -> Column:
        return F.when(F.col("atr") > 0, 100.0 * F.col(part) / F.nullif(F.col("atr"), F.lit(0.0))).otherwise(0.0)

    out = out.withColumns({"rsi": rsi, "plus_di": directional("avg_pdm"), "minus_di": directional("avg_mdm")})
    total_di = F.col("plus_di") + F.col("minus_di")
    dx = F.when(total_di > 0, 100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / F.nullif(total_di, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("dx", dx)
    if textbook:
        out = out.withColumn("_real_dx", F.when(F.col("rn") >= period, F.col("dx")))
        out = smoothed(out, {"adx": "_real_dx"}, period, seed_rows=2 * period - 1).drop("_real_dx")
    else:
        out = smoothed_in_blocks(out, {"adx": "dx"}, period)
    trend = (F.when(F.col("adx").isNull(), NO_TREND).when(F.col("plus_di") > F.col("minus_di"), BULLISH)
             .when(F.col("minus_di") > F.col("plus_di"), BEARISH).otherwise(NEUTRAL))
    return out.withColumn("trend", trend).drop("gain", "loss", "tr", "pdm", "mdm", "avg_gain", "avg_loss", "avg_pdm", "avg_mdm", "_rn", "_blk")


def last_oscillators(bars: DataFrame) -> DataFrame:
    """`oscillators` of every symbol's last bar, by its place: another order would sort all bars once more."""
    return oscillators(bars).where(F.col("rn") == F.col("total"))


def average_true_range(bars: DataFrame, period: int = 14) -> DataFrame:
    """Latest Wilder ATR per symbol on the exchange's previous close: (symbol, atr), null below `period` sessions."""
    ranged = bars.select("symbol", "session", true_range("prev_close").alias("tr"))
    return latest(smoothed(ranged, {"atr": "tr"}, period)).select("symbol", "atr")


def support_resistance(bars: DataFrame, rows: int = 20, min_bars: int = 5) -> DataFrame:
    """Nearest rolling low below and rolling high above the latest close, with the extremes as fallbacks."""
    whole = by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least_rows = max(3, rows // 4)
    marked = bars.select(
        "symbol", "high", "low", F.last("close").over(whole).alias("price"),
        half_even(rolling("low", F.min, rows, least_rows), 2).alias("floor_level"),
        half_even(rolling("high", F.max, rows, least_rows), 2).alias("roof_level"))
    found = marked.groupBy("symbol").agg(
        F.max("price").alias("current_price"), F.max(F.when(F.col("floor_level") < F.col("price"), F.col("floor_level"))).alias("below"),
        F.min(F.when(F.col("roof_level") > F.col("price"), F.col("roof_level"))).alias("above"),
        F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.count(F.lit(1)).alias("sessions"))
    price = F.col("current_price")
    fallback = F.when(F.col("min_low") < price, half_even("min_low", 2)).otherwise(half_even(price * 0.95, 2))
    return found.where(F.col("sessions") >= min_bars).select(
        "symbol", "current_price", F.coalesce("below", fallback).alias("support"),
        F.coalesce("above", F.when(F.col("max_high") > price, half_even("max_high", 2))).alias("resistance"), "sessions")


def paired_sessions(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Bars on the sessions that stock and benchmark share, with `d` = sessions before the latest and `total`."""
    window = Window.partitionBy("symbol").orderBy(F.desc("session"))
    return (bars.where(F.col("close").isNotNull()).join(bench.where(F.col("bench").isNotNull()), "session")
            .select("symbol", "session", "close", "bench", (F.row_number().over(window) - 1).alias("d"),
                    F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("total")))


def spreads(paired: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Latest relative strength per symbol: rs_<name>, ret_<name>, bench_<name> in percentage points.

    A window longer than the history shrinks to it. All windows come from one pass over the pairs.
    """
    aggregates = []
    for name, rows in windows.items():
        base = F.col("d") == F.least(F.lit(rows), F.col("total") - 1)
        aggregates += [F.max(F.when(base, F.col("close"))).alias(f"_p_{name}"), F.max(F.when(base, F.col("bench"))).alias(f"_m_{name}")]
    now = F.col("d") == 0
    wide = paired.where(F.col("total") >= 2).groupBy("symbol").agg(
        F.max(F.when(now, F.col("close"))).alias("_p"), F.max(F.when(now, F.col("bench"))).alias("_m"), *aggregates)
    out = [F.col("symbol")]
    for name in windows:
        stock, market = F.col(f"_p_{name}"), F.col(f"_m_{name}")
        valid = (stock > 0) & (market > 0)
        own, other = (F.col("_p") - stock) / stock * 100, (F.col("_m") - market) / market * 100
        out += [F.when(valid, half_even(own - other, 2)).alias(f"rs_{name}"), F.when(valid, half_even(own, 2)).alias(f"ret_{name}"),
                F.when(valid, half_even(other, 2)).alias(f"bench_{name}")]
    return wide.select(*out)


def spread_path(paired: DataFrame, rows: int, skip: int = 0) -> DataFrame:
    """RS over exactly `rows` sessions for every window end; null where the history is too short. Values are rounded
    here, before any later average."""
    window = by_symbol()
    stock, market = F.lag("close", rows).over(window), F.lag("bench", rows).over(window)
    own, other = (F.col("close") / stock - 1) * 100, (F.col("bench") / market - 1) * 100
    return paired.select("symbol", "session", "d", "total", half_even(own - other, 2).alias("rs"), half_even(own, 2).alias("ret"))


def momentum_of(value: str, gap: int = 10, span: int = 5) -> tuple[Column, Column]:
    """(mean of the `span` window ends `gap` sessions ago, momentum) as aggregates over spread_path rows; null if any
    of the values is missing."""
    now, then = F.col("d") < span, (F.col("d") >= gap) & (F.col("d") < gap + span)
    complete = F.count(F.when(now | then, F.col(value))) == 2 * span
    mean_now, mean_then = F.avg(F.when(now, F.col(value))), F.avg(F.when(then, F.col(value)))
    return F.when(complete, half_even(mean_then, 2)), F.when(complete, half_even(mean_now - mean_then, 2))


def spread_momentum(path: DataFrame, gap: int = 10, span: int = 5) -> DataFrame:
    """(symbol, rs_now, rs_prev, rs_momentum) of a rotation graph; null without the full history."""
    prev, momentum = momentum_of("rs", gap, span)
    complete = momentum.isNotNull()
    return path.where(F.col("d") < gap + span).groupBy("symbol").agg(
        F.when(complete, F.max(F.when(F.col("d") == 0, F.col("rs")))).alias("rs_now"), prev.alias("rs_prev"), momentum.alias("rs_momentum"))


def against_sector(rows: DataFrame, ret: str, sector: str = "sector", *more: str) -> DataFrame:
    """Add `sector_avg` and `vs_sector`: return minus the equal-weight sector mean, missing returns excluded.

    The mean is a partial aggregate joined back, so one huge sector does not gather in one task.
    """
    keys = [sector, *more]
    mean = rows.groupBy(*keys).agg(F.avg(ret).alias("sector_avg"))
    return rows.join(mean, keys, "left").withColumn("vs_sector", F.col(ret) - F.col("sector_avg"))


def run_up(spread: DataFrame, recent: str = "10", full: str = "63") -> DataFrame:
    """Share of the full-window RS earned in the recent sessions; null unless the full RS is positive."""
    share = half_even(F.col(f"rs_{recent}") / F.nullif(F.col(f"rs_{full}"), F.lit(0.0)) * 100, 1)
    return spread.withColumn("recent_share", F.when(F.col(f"rs_{full}") > 0, share))


def technical_summary(bars: DataFrame, bench: DataFrame, min_bars: int = 5, dealt: DataFrame | None = None) -> DataFrame:
    """One row of latest values per symbol; symbols with fewer than `min_bars` bars keep an N/A row. `dealt` are the bars exchanged by symbol into tasks
    that do not grow with the input."""
    dealt = bars if dealt is None else dealt
    osc = last_oscillators(dealt).select("symbol", "close", "rsi", "adx", "plus_di", "minus_di", "trend", "total")
    levels = support_resistance(dealt, min_bars=min_bars).select("symbol", "support", "resistance")
    rs = spreads(paired_sessions(bars, bench), {"63": 63})
    enough = F.col("total") >= min_bars
    joined = osc.join(levels, "symbol", "left").join(rs, "symbol", "left")
    return joined.select(
        "symbol", F.when(enough, half_even("close", 2)).alias("current_price"), F.when(enough, half_even("rsi", 2)).alias("rsi"),
        F.when(enough, half_even("adx", 2)).alias("adx"), F.when(enough, half_even("plus_di", 2)).alias("plus_di"),
        F.when(enough, half_even("minus_di", 2)).alias("minus_di"),
        F.when(enough, F.col("trend")).otherwise("N/A (Insufficient Data)").alias("trend"),
        F.when(enough, F.col("rs_63")).alias("rs_63"), "support", "resistance", F.col("total").alias("sessions"))


def session_returns(bars: DataFrame) -> DataFrame:
    """One-session return on the exchange's previous close, so that a missed session is never spanned."""
    base = F.col("prev_close")
    return bars.select("symbol", "session", F.when(base > 0, F.col("close") / base - 1).alias("ret"))


def volatility(returns: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """Sample volatility and mean of the last `rows` returns per symbol, per session and per year."""
    kept = latest(returns.where(F.col("ret").isNotNull()), rows=rows)
    return kept.groupBy("symbol").agg(
        F.count("ret").alias("observations"), F.stddev_samp("ret").alias("session_vol"), F.avg("ret").alias("_mean")).select(
        "symbol", "observations", "session_vol", (F.col("session_vol") * TRADING_DAYS ** 0.5).alias("annual_vol"),
        (F.col("_mean") * TRADING_DAYS).alias("annual_mean"))


def atr_stop(price, atr, support, multiple: float = 5.0, band: float = 1.0, buffer: float = 0.25) -> tuple[Column, Column]:
    """(stop, method): price - multiple x ATR, moved just under a support that lies within `band` ATRs below it."""
    price, atr, support = F.col(price), F.col(atr), F.col(support)
    base = price - multiple * atr
    known = price.isNotNull() & (price > 0) & atr.isNotNull() & (atr > 0)
    near = support.isNotNull() & (support >= base - band * atr) & (support < base)
    stop = F.when(near, support - buffer * atr).otherwise(base)
    usable = known & (stop > 0)
    return F.when(usable, stop), F.when(~usable | usable.isNull(), "unavailable").when(near, "support").otherwise("atr")


def trailed_stop(stop, method, previous, price) -> tuple[Column, Column]:
    """A stop is only raised: a higher previous stop stays ('trailed'), one at or above the price is 'breached'."""
    stop, method, previous, price = F.col(stop), F.col(method), F.col(previous), F.col(price)
    keep_new = previous.isNull() | price.isNull()
    higher = stop.isNull() | (half_even(previous, 2) > half_even(stop, 2))
    return (F.when(keep_new, stop).when(previous >= price, previous).when(higher, previous).otherwise(stop),
            F.when(keep_new, method).when(previous >= price, "breached").when(higher, "trailed").otherwise(method))
