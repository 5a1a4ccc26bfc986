"""Exact ranks, positions, quantiles and rank buckets over groups of any size.

A plain `rank()` window sends one group to one task. A cross-section (all symbols of one session) or a universe-wide
ranking grows with the data. Ranks and positions come from one sort by range (`ordering.placed`). Quantiles need no row to be placed: equal
values are counted first (map-side), the values of a large group whose hash is a multiple of some number become the edges of value buckets, counts per
bucket give the offset of a bucket and an ordered window runs only inside a bucket. Hashes make every evaluation of the plan (also
a recomputed task) choose the same edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.operators.ordering import PLACES, average_rank, placed
from bartide.session import rank_buckets


#: different values from which on a group is split
SPLIT_ABOVE = 4096
_STEPS = 12  # of the search among the edges: enough for 4,095 of them


def _bucket(value: str, edges: str) -> Column:
    """How many of the sorted edges are at most `value`, by halving."""
    search = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(F.lit(0).alias("low"), F.size(edges).alias("high")), lambda s, _: F.when(
        s["low"] >= s["high"], s).otherwise(F.when(
            F.get(F.col(edges), F.shiftright(s["low"] + s["high"], 1)) <= F.col(value),
            F.struct((F.shiftright(s["low"] + s["high"], 1) + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), F.shiftright(s["low"] + s["high"], 1).alias("high")))))
    return F.when(F.col(edges).isNull(), 0).otherwise(search["low"])


def value_counts(df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """One row per (by, value): `ties`, `before` (rows with a smaller value) and `total` (non-null rows of the group)."""
    buckets = min(buckets or rank_buckets(df.sparkSession), 2048)
    whole = not by
    if whole:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    by = list(by)
    # + 0.0 merges the two zeros; the count per distinct value is the only full pass over the rows
    ties = (df.where(F.col(value).isNotNull())
            .groupBy(*by, (F.col(value) + F.lit(0.0)).alias(value)).agg(F.count(F.lit(1)).alias("ties")))
    # summarised from the tie counts, so that the rows are read once here
    span = ties.groupBy(*by).agg(F.sum("ties").alias("total"), F.count(F.lit(1)).alias("_different"))
    counted = ties.join(span, by)
    chosen = (F.col("_different") > SPLIT_ABOVE) & (F.pmod(F.xxhash64(value), F.greatest(F.ceil(F.col("_different") / buckets), F.lit(1))) == 0)
    edges = counted.where(chosen).groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_edges"))  # about `buckets` of them
    bucketed = counted.join(edges, by, "left").withColumn("_bucket", _bucket(value, "_edges")).select(*by, value, "ties", "total", "_bucket")
    inside = (Window.partitionBy(*by, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (bucketed.groupBy(*by, "_bucket").agg(F.sum("ties").alias("_size"))
               .withColumn("_offset", F.sum("_size").over(before) - F.col("_size")).drop("_size"))
    numbered = bucketed.withColumn("_upto", F.sum("ties").over(inside))
    out = numbered.join(offsets, [*by, "_bucket"]).select(*by, value, "ties", "total", (F.col("_offset") + F.col("_upto") - F.col("ties")).alias("before"))
    return out.drop("_all") if whole else out


def with_ranks(df: DataFrame, by: Sequence[str], value: str, *, average: str | None = None, percent: str | None = None,
               low: str | None = None, high: str | None = None) -> DataFrame:
    """Add ranks of `value` within `by`; null values stay unranked.

    average: mean rank of ties, ascending; percent: that over the non-null count; low: competition rank, ascending;
    high: competition rank, descending (1 = best).
    """
    wanted = {average: average_rank(), percent: average_rank() / F.col("_total"), low: F.col("_before") + 1,
              high: F.col("_total") - F.col("_before") - F.col("_ties") + 1}
    return placed(df, by, value).withColumns({name: expr for name, expr in wanted.items() if name}).drop(*PLACES)


def with_positions(df: DataFrame, by: Sequence[str], order: str, tie: Sequence[str], position: str, descending: bool = True) -> DataFrame:
    """Add the 1-based position of every row in (order, tie) order: a row_number that never needs the whole group
    in one task. Rows whose `order` is null get no position."""
    from_top = F.col("_total") - F.col("_before") - F.col("_ties") + (F.col("_place") - F.col("_before"))  # ties keep their order
    return placed(df, by, order, tie).withColumn(position, from_top if descending else F.col("_place")).drop(*PLACES)


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of `value` per group, without buffering the group: one row per `by`."""
    counts = value_counts(df, by, value, buckets)
    columns = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        lower, upper = F.floor(place), F.ceil(place)

        def holds(spot):
            return (F.col("before") <= spot) & (spot < F.col("before") + F.col("ties"))

        low, high = F.max(F.when(holds(lower), F.col(value))), F.max(F.when(holds(upper), F.col(value)))
        share = F.max(place - lower)
        columns.append((low + (high - low) * share).alias(name))
    return counts.groupBy(*by).agg(*columns)


def with_fifths(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], bucket: str, parts: int = 5) -> DataFrame:
    """Equal-frequency bucket 1..parts of the first-come rank, with interpolated edges (not ntile)."""
    fifth = F.greatest(F.ceil((F.col("_place") - 1) * parts / (F.col("_total") - 1)), F.lit(1)).cast("int")
    return placed(df, by, value, tie).withColumn(bucket, F.when(F.col("_total") > 1, fifth)).drop(*PLACES)


def top_rows(df: DataFrame, by: Sequence[str], size: int, *order: Column) -> DataFrame:
    """The first `size` rows per group in a total order; Spark trims each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")
