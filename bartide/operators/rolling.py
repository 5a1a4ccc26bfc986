"""Per-symbol window columns. A symbol has one row per session, so these groups are bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.functions.numbers import as_col


def by_symbol(key: str | tuple = "symbol", order: str = "session"):
    keys = (key,) if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def trailing(rows: int, skip: int = 0, key: str | tuple = "symbol", order: str = "session"):
    """The `rows` rows that end `skip` rows ago."""
    return by_symbol(key, order).rowsBetween(-(rows - 1) - skip, -skip)


def so_far(key: str | tuple = "symbol", order: str = "session"):
    return by_symbol(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(value, how, rows: int, min_rows: int | None = None, skip: int = 0, key="symbol", order="session") -> Column:
    """how(value) over the trailing rows, null until `min_rows` non-null values are present."""
    window = trailing(rows, skip, key, order)
    value = as_col(value)
    return F.when(F.count(value).over(window) >= (rows if min_rows is None else min_rows), how(value).over(window))


def rolling_median(value, rows: int, min_rows: int | None = None, key="symbol", order="session") -> Column:
    return rolling(value, lambda v: F.percentile(v, F.lit(0.5)), rows, min_rows, 0, key, order)


def back(value, rows: int, key="symbol", order="session") -> Column:
    return F.lag(as_col(value), rows).over(by_symbol(key, order))


def ahead(value, rows: int, key="symbol", order="session") -> Column:
    return F.lead(as_col(value), rows).over(by_symbol(key, order))


def chained(returns, key="symbol", order="session") -> Column:
    """Running product of (1 + return), a null return counting as 0."""
    return F.product(1 + F.coalesce(as_col(returns), F.lit(0.0))).over(so_far(key, order))


def carried(value, key="symbol", order="session") -> Column:
    """Last known value."""
    return F.last(as_col(value), ignorenulls=True).over(so_far(key, order))


def carried_once_inside(value, key="symbol", order="session") -> Column:
    """Fill a single missing row, and only where a later value exists."""
    value = as_col(value)
    # all but those up to here: a frame that ends at the last row is counted anew for every row
    known = F.count(value).over(by_symbol(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(value, F.when(known > F.count(value).over(so_far(key, order)), F.lag(value, 1).over(by_symbol(key, order))))


def adjacent_return(close="close", number="n", key="symbol") -> Column:
    """One-session return that never spans a session the symbol missed: `number` is the calendar's session number."""
    window = Window.partitionBy(key).orderBy(number)
    before = F.lag(close).over(window)
    touching = F.col(number) - F.lag(number).over(window) == 1
    return F.when(touching & (before > 0), F.col(close) / before - 1)


def mean_shift(value, span: int, gap: int, key="symbol", order="session") -> Column:
    """Mean of the latest `span` values minus the mean of the `span` values that end `gap` rows earlier."""
    return (rolling(value, F.avg, span, span, 0, key, order) - rolling(value, F.avg, span, span, gap, key, order))


def latest(df: DataFrame, key: str = "symbol", order: str = "session", rows: int = 1) -> DataFrame:
    """The last `rows` rows of every key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")


#: smoothed values come in blocks of this many periods
BLOCK_PERIODS = 40


def in_blocks(df: DataFrame, period: int = 14, seed_rows: int | None = None, key: str = "symbol", order: str = "session") -> DataFrame:
    """Rows with their place `_rn` and block `_blk` for `smoothed_in_blocks`, where no value is missing after the seed row."""
    rows = period if seed_rows is None else seed_rows
    out = df.withColumn("_rn", F.row_number().over(by_symbol(key, order)))
    return out.withColumn("_blk", F.floor(F.greatest(F.col("_rn") - rows - 1, F.lit(0)) / (BLOCK_PERIODS * period)))


def smoothed_in_blocks(df: DataFrame, columns: dict[str, str], period: int = 14, seed_rows: int | None = None, key: str = "symbol",
                       order: str = "session") -> DataFrame:
    """`smoothed` on rows of `in_blocks`. All windows go by block and session, so that one sort serves every call."""
    rows = period if seed_rows is None else seed_rows
    rn = F.col("_rn")
    whole = Window.partitionBy(key).orderBy("_blk", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.greatest(rn - rows - 1, F.lit(0)) % (BLOCK_PERIODS * period)
    sources = dict(enumerate(columns.values()))
    out = df.withColumns({f"_start{i}": F.avg(F.when(rn <= rows, F.col(x))).over(whole) for i, x in sources.items()})
    out = out.withColumns({f"_term{i}": _term(F.col(x), rn > rows, place, period) for i, x in sources.items()})
    out = _unrolled(out, list(columns), [("_blk", place, F.greatest(rn - rows, F.lit(0)))] * len(columns), rn >= rows, period, key, order)
    return out.drop(*[c for c in out.columns if c not in df.columns and c not in columns])


def _term(x: Column, use: Column, place: Column, period: int) -> Column:
    return F.when(use, x * F.pow(F.lit((period - 1) / period), -place) / period).otherwise(0.0)


def _unrolled(df: DataFrame, names: list[str], parts: list[tuple[str, Column, Column]], seeded: Column, period: int, key: str, order: str) -> DataFrame:
    """The recurrence of `smoothed` from `_start<i>` and `_term<i>`; `parts` are (block column, place in the block, step)."""
    decay, block_len = (period - 1) / period, BLOCK_PERIODS * period

    def inside(block: str):
        return Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def earlier(block: str):
        return Window.partitionBy(key).orderBy(block).rangeBetween(-1, -1)

    out = df.withColumns({f"_cur{i}": F.sum(f"_term{i}").over(inside(block)) for i, (block, _, _) in enumerate(parts)})
    # the last running sum of the block before, not its sum anew: a window without `_cur` is moved before it and sorts once more
    out = out.withColumns({f"_prev{i}": F.max_by(f"_cur{i}", order).over(earlier(block)) for i, (block, _, _) in enumerate(parts)})
    values = {}
    for i, (name, (block, place, step)) in enumerate(zip(names, parts)):
        block, start = F.col(block), F.col(f"_start{i}")
        carry = F.col(f"_prev{i}") * (decay ** (block_len - 1))
        carry = F.when(block == 0, start).when(block == 1, carry + start * (decay ** block_len)).otherwise(carry)
        grown = F.pow(F.lit(decay), place) * (decay * carry + F.col(f"_cur{i}"))
        values[name] = F.when(seeded, F.when(step >= 1, grown).otherwise(start))
    return out.withColumns(values)


def smoothed(df: DataFrame, columns: dict[str, str], period: int = 14, seed_rows: int | None = None, dense: bool = False,
             key: str = "symbol", order: str = "session") -> DataFrame:
    """Wilder smoothing y' = (y (p-1) + x) / p as window sums: {new column: input column}.

    The seed is the mean of the first `seed_rows` (default `period`) values at that row; a missing value carries y; if
    the seed is missing the first later value starts the series. With a = (p-1)/p the recurrence unrolls to
    y = a^m (seed + sum x a^-k / p). Exponents restart every 40 p values so that a^-k cannot overflow; what is older
    than one whole block weighs less than 1e-17 and is dropped. `dense`: no value is missing after the seed row.
    """
    if dense:
        placed = in_blocks(df, period, seed_rows, key, order)
        return smoothed_in_blocks(placed, columns, period, seed_rows, key, order).drop("_rn", "_blk")
    rows = period if seed_rows is None else seed_rows
    block_len = BLOCK_PERIODS * period
    window, running = by_symbol(key, order), so_far(key, order)
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_rn", F.row_number().over(window))
    after, sources, known = F.col("_rn") > rows, dict(enumerate(columns.values())), {}
    for i, source in sources.items():
        x = F.col(source)
        known |= {f"_seed{i}": F.avg(F.when(F.col("_rn") <= rows, x)).over(whole), f"_cnt{i}": F.count(F.when(after, x)).over(running),
                  f"_late{i}": F.first(F.when(after, x), ignorenulls=True).over(whole)}
    out = out.withColumns(known)
    # step 1 is the first smoothed value, so the block and place within it count from step - 1
    out = out.withColumns({f"_step{i}": F.col(f"_cnt{i}") - F.when(F.col(f"_seed{i}").isNull(), 1).otherwise(0) for i in sources})
    parts, derived = [], {}
    for i, source in sources.items():
        x, step = F.col(source), F.col(f"_step{i}")
        place = F.greatest(step - 1, F.lit(0)) % block_len
        derived |= {f"_blk{i}": F.floor(F.greatest(step - 1, F.lit(0)) / block_len),
                    f"_start{i}": F.when(step >= 0, F.coalesce(f"_seed{i}", f"_late{i}")),
                    f"_term{i}": _term(x, after & x.isNotNull() & (step >= 1), place, period)}
        parts.append((f"_blk{i}", place, step))
    out = _unrolled(out.withColumns(derived), list(columns), parts, F.col("_rn") >= rows, period, key, order)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])
