"""Price preparation: cleaning, corporate actions, adjusted series, as-of joins, calendars and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.operators.rolling import by_symbol, so_far


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the latest by `order`, a number (see market.packed for several). One max_by for each column on a key that fits
    the aggregation buffer, so that raw rows are hashed and not sorted; equal orders must belong to equal rows."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in others])


def on_calendar(bars: DataFrame, calendar: DataFrame, values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Bars on every session between a symbol's first and last one, gaps as null rows (n = session number).

    Each bar fills forward to the next bar of its symbol, so no symbols x sessions grid is joined. The calendar is broadcast: rows stay with their symbol.
    """
    calendar = F.broadcast(calendar)
    numbered = bars.join(calendar, "session")
    following = F.lead("n").over(by_symbol())
    filled = (numbered.withColumn("_until", F.coalesce(following - 1, F.col("n")))
              .withColumn("_m", F.explode(F.sequence("n", "_until"))))
    own = F.col("_m") == F.col("n")
    dense = filled.select("symbol", *keep, F.col("_m").alias("n"), *[F.when(own, F.col(v)).alias(v) for v in values])
    return dense.join(calendar, "n")


def action_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, session, factor): one price factor per symbol and ex-date.

    Actions of one ex-date compound in list order (`ord`); a gap sets the running factor to close / prev_close, so only
    what follows the last gap multiplies it. Dropped unless the ex-date is a session with earlier rows.
    """
    gap = F.col("kind") == "gap"
    per_day = actions.groupBy("symbol", F.col("ex_date").alias("session")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "factor"))).alias("_list"), F.max(gap).alias("has_gap"))
    # the actions of one symbol on one day are a handful
    after_gap = F.aggregate("_list", F.lit(1.0), lambda acc, x: F.when(x["kind"] == "gap", F.lit(1.0)).otherwise(acc * x["factor"]))
    first = F.row_number().over(by_symbol())
    days = bars.select("symbol", "session", "close", "prev_close", first.alias("_rn"))
    found = days.join(per_day.withColumn("after", after_gap).drop("_list"), ["symbol", "session"])
    base = F.when(F.col("has_gap"), F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0))).otherwise(F.lit(1.0))
    return found.where(F.col("_rn") > 1).select("symbol", "session", (base * F.col("after")).alias("factor"))


def back_adjust(bars: DataFrame, actions: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close"),
                quantities: Sequence[str] = ("qty", "deliv_qty")) -> DataFrame:
    """Scale every price before an ex-date by its factor and every quantity by the inverse; prev_close on the ex-date
    is scaled too. A suffix product over the symbol's rows replaces the join of rows with later actions."""
    marked = bars.join(action_factors(bars, actions), ["symbol", "session"], "left")
    later = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    own = F.coalesce("factor", F.lit(1.0))
    scaled = marked.withColumn("_scale", F.coalesce(F.product(own).over(later), F.lit(1.0)))
    changes = {c: F.col(c) * F.col("_scale") for c in prices}
    changes |= {q: F.col(q) / F.col("_scale") for q in quantities}
    changes["prev_close"] = F.col("prev_close") * F.col("_scale") * own
    return scaled.withColumns(changes).drop("_scale", "factor")


def unexplained_jumps(bars: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows that move more than `threshold`, leaving out each symbol's first row."""
    ret = F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0)) - 1
    rows = bars.select("symbol", "session", "prev_close", "close", ret.alias("ret"), F.row_number().over(by_symbol()).alias("_rn"))
    return rows.where((F.col("_rn") > 1) & (F.abs("ret") > threshold)).drop("_rn")


def chained_prices(bars: DataFrame, jump_limit: float | None = None) -> DataFrame:
    """Continuous closes from chained returns close / prev_close, highs and lows on the same scale. Moves beyond
    `jump_limit` count as unrecorded corporate actions (return 0)."""
    window = by_symbol()
    first = F.row_number().over(window) == 1
    ret = F.when(first, 0.0).otherwise(F.coalesce(F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0)) - 1, F.lit(0.0)))
    rows = bars.withColumn("_ret", ret)
    if jump_limit is not None:
        rows = rows.withColumn("_ret", F.when(F.abs("_ret") > jump_limit, 0.0).otherwise(F.col("_ret")))
    adj = F.first("close").over(so_far()) * F.product(1 + F.col("_ret")).over(so_far())
    return (rows.withColumn("adj_close", adj).withColumn("adj_high", F.col("high") * F.col("adj_close") / F.col("close"))
            .withColumn("adj_low", F.col("low") * F.col("adj_close") / F.col("close")).withColumnRenamed("_ret", "ret"))


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, keys: Sequence[str] = (),
          strict: bool = True) -> DataFrame:
    """Add the last `value` known before (strict) or at each row of `left`: both sides in one ordered stream, no range
    join. Keys bound the group; without keys both sides are calendars."""
    side = [F.col(k) for k in keys]
    # at equal times a strict search must not see the right row yet
    rank_left, rank_right = (0, 1) if strict else (1, 0)
    others = [c for c in left.columns if c not in keys]
    a = left.select(*side, F.col(left_time).alias("_t"), F.lit(rank_left).alias("_o"), F.struct(*others).alias("_l"),
                    F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.where(F.col(value).isNotNull()).select(*side, F.col(right_time).alias("_t"), F.lit(rank_right).alias("_o"),
                                                     F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_t", "_o")
    known = F.last("_v", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (a.unionByName(b).withColumn(f"{value}_asof", known).where(F.col("_l").isNotNull())
            .select(*keys, "_l.*", f"{value}_asof"))


def bridge_levels(levels: DataFrame, value: str, price: str, key: str = "index_name") -> DataFrame:
    """Fill missing index levels by another index's return, chained from the last known level, with a flag.

    The chain of daily returns telescopes to value_a * price / price_a, valid while no price since the anchor a is
    missing or not positive.
    """
    running = so_far(key)
    bad = F.when(F.col(price).isNull() | (F.col(price) <= 0), 1).otherwise(0)
    rows = levels.withColumn("_bad", F.sum(bad).over(running) - bad)  # bad prices before this row
    known = F.col(value).isNotNull()
    rows = rows.withColumns({
        "_level": F.last(F.when(known, F.col(value)), ignorenulls=True).over(running),
        "_price": F.last(F.when(known, F.coalesce(F.col(price), F.lit(-1.0))), ignorenulls=True).over(running),
        "_bad0": F.last(F.when(known, F.col("_bad")), ignorenulls=True).over(running)})
    chain = (F.col("_price") > 0) & (F.col("_bad") == F.col("_bad0")) & F.col(price).isNotNull()
    bridged = F.when(~known & chain, F.col("_level") * F.col(price) / F.nullif(F.col("_price"), F.lit(0.0)))
    return (rows.withColumn("filled", F.coalesce(value, bridged)).withColumn("provisional", ~known & bridged.isNotNull())
            .drop("_bad", "_level", "_price", "_bad0"))


def levels_as_of(levels: DataFrame, days: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """The levels as they were known on each of `days` (a short list): (as_of, key, session, price, level, filled, provisional).

    `levels` has session, published, level and price. A level counts from its day of publication on; until then it is bridged with the
    price and flagged. A later publication therefore changes later answers only, and both versions can be asked for."""
    known = levels.withColumn("as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in days]))).where(F.col("session") <= F.col("as_of"))
    known = known.withColumn("level", F.when(F.col("published") <= F.col("as_of"), F.col("level"))).withColumn("_series", F.struct("as_of", *key))
    return bridge_levels(known, "level", "price", "_series").select("as_of", *key, "session", "price", "level", "filled", "provisional")


def weekday_calendar(bounds: DataFrame, extra: Sequence[str] = (), holidays: Sequence[str] = ()) -> DataFrame:
    """(day, is_session, sessions_so_far, last_session) for every calendar day of a range: one row with first and last day."""
    days = bounds.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    listed = F.col("day").cast("string")
    open_day = ((F.weekday("day") < 5) | listed.isin(*extra)) & ~listed.isin(*holidays)
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = days.withColumn("is_session", open_day)
    return marked.select("day", "is_session", F.sum(F.col("is_session").cast("int")).over(running).alias("sessions_so_far"),
                         F.last(F.when(F.col("is_session"), F.col("day")), ignorenulls=True).over(running).alias("last_session"))


def sessions_between(rows: DataFrame, calendar: DataFrame, start: str, end: str, name: str, at_least: int | None = None) -> DataFrame:
    """Sessions after `start` up to and including `end`: a difference of running counts, two equi-joins."""
    counts = calendar.select("day", "sessions_so_far")
    joined = (rows.join(counts.select(F.col("day").alias(start), F.col("sessions_so_far").alias("_a")), start, "left")
              .join(counts.select(F.col("day").alias(end), F.col("sessions_so_far").alias("_b")), end, "left"))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()  # a day outside the calendar has no count
    gap = F.when(known, F.greatest(F.col("_b") - F.col("_a"), F.lit(0 if at_least is None else at_least)))
    return joined.withColumn(name, gap).drop("_a", "_b")


def expected_session(rows: DataFrame, calendar: DataFrame, moment: str, zone: str = "Asia/Kolkata", publish_hour: int = 19) -> DataFrame:
    """Latest session whose prices should be out at a UTC moment: today after the publishing hour, else the day before."""
    local = F.from_utc_timestamp(F.col(moment), zone)
    day = F.when(F.hour(local) >= publish_hour, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return (rows.withColumn("day", day).join(calendar.select("day", "last_session"), "day", "left")
            .withColumnRenamed("last_session", "expected").drop("day"))


def event_windows(events: DataFrame, bars: DataFrame, bench: DataFrame, calendar: DataFrame, active: int = 100) -> DataFrame:
    """Announcement return of every event over the session before to the session after, in pp against the benchmark,
    with the session numbers [known, until] in which it is the latest one: (symbol, event_date, known, until, ear)."""
    sessions = calendar.select(F.col("session").alias("event_date"), F.col("n"))
    days = events.select("symbol", "event_date").distinct()
    # first session on or after the event: the calendar read backwards
    spine = days.select("event_date").distinct().unionByName(sessions.select("event_date")).distinct().join(sessions, "event_date", "left")
    after = spine.withColumn("pos", F.first("n", ignorenulls=True).over(
        Window.orderBy("event_date").rowsBetween(Window.currentRow, Window.unboundedFollowing))).drop("n")
    placed = days.join(after, "event_date").where(F.col("pos").isNotNull())
    priced = bars.join(bench, "session").join(calendar, "session").select("symbol", "n", "close", "bench")
    before = priced.select("symbol", (F.col("n") + 1).alias("pos"), F.col("close").alias("c0"), F.col("bench").alias("b0"))
    behind = priced.select("symbol", (F.col("n") - 1).alias("pos"), F.col("close").alias("c1"), F.col("bench").alias("b1"))
    ear = (F.col("c1") / F.col("c0") - F.col("b1") / F.col("b0")) * 100
    found = (placed.join(before, ["symbol", "pos"]).join(behind, ["symbol", "pos"])
             .select("symbol", "event_date", (F.col("pos") + 1).alias("known"), ear.alias("ear")))
    # a later event overwrites, also when two fall on the same session
    latest = found.groupBy("symbol", "known").agg(F.max_by("ear", "event_date").alias("ear"), F.max("event_date").alias("event_date"))
    following = F.lead("known").over(Window.partitionBy("symbol").orderBy("known"))
    return latest.withColumn("until", F.least(F.col("known") + active - 1, F.coalesce(following - 1, F.lit(2**31 - 1))))


def append_checked(existing: DataFrame, fetched: DataFrame, key: Sequence[str], group: str, values: Sequence[str],
                   tolerance: float = 1e-4) -> DataFrame:
    """Existing rows plus the new keys of `fetched`, per group only where all overlapping values agree."""
    pair = existing.alias("o").join(fetched.alias("n"), list(key))
    worst = F.greatest(*[F.abs(F.col(f"n.{v}") - F.col(f"o.{v}")) / F.col(f"o.{v}") for v in values]) if len(values) > 1 else \
        F.abs(F.col(f"n.{values[0]}") - F.col(f"o.{values[0]}")) / F.col(f"o.{values[0]}")
    rejected = pair.groupBy(group).agg(F.max(worst).alias("_gap")).where(F.col("_gap") > tolerance).select(group)
    fresh = fetched.join(rejected, group, "left_anti").join(existing.select(*key), list(key), "left_anti")
    return existing.withColumn("source", F.lit("stored")).unionByName(fresh.withColumn("source", F.lit("appended")))


def latest_on_or_before(rows: DataFrame, day: str, as_of_day: Column, keys: Sequence[str]) -> DataFrame:
    """Rows of the latest available day per key that is not after `as_of_day`."""
    usable = rows.where(F.col(day) <= as_of_day)
    last = usable.groupBy(*keys).agg(F.max(day).alias(day))
    return usable.join(last, [*keys, day], "left_semi")
