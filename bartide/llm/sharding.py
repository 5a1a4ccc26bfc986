"""Shards of near equal bytes: a minimax contiguous partition of ordered groups.

Equal texts are one atomic group. Groups stand in order of falling size, so that cuts among the last shards fall between the
smallest. The least capacity for which a greedy pass needs no more shards than there are is found by binary search, and the
order is cut there. Groups of one size are interchangeable, so the search needs only how many groups have each size: if the
sizes are all different their sum is at least half the square of their number, so T bytes have at most sqrt(2 T) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import join_heavy, stored

#: rows that one window task orders, on average
ROWS_PER_BUCKET = 20_000


def greedy(runs: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(shards needed, where each but the first begins as (run, groups of that run before it)) of runs (size, groups); sizes fit the capacity."""
    used, begins = 0, []
    for k, (size, groups) in enumerate(runs):
        placed = 0
        while placed < groups:
            fits = min((capacity - used) // size, groups - placed)
            if fits:
                placed += fits
                used += fits * size
            else:
                begins.append((k, placed))
                used = 0
    return len(begins) + (1 if runs else 0), begins


def least_capacity(runs: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity with which the greedy pass needs at most `shards` shards."""
    total, largest = sum(s * g for s, g in runs), max((s for s, _ in runs), default=1)
    low = max(-(-total // shards), largest)
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if greedy(runs, middle)[0] <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Where shards 1, 2, ... begin, as (size, groups of that size before it); runs are in order of falling size.

    A group larger than an equal share fills a shard alone, and the rest is divided among the shards that remain; the
    largest shard is the same as without this step, and the others stay near equal."""
    runs, found = list(runs), []
    total = sum(s * g for s, g in runs)
    alone = 0  # groups of the first run that have a shard of their own
    while shards > 1 and runs and runs[0][0] * shards > total:
        size, groups = runs[0]
        total -= size
        shards -= 1
        alone += 1
        if groups > 1:
            runs[0] = (size, groups - 1)
            found.append((size, alone))
        else:
            runs.pop(0)
            alone = 0
            if runs:
                found.append((runs[0][0], 0))
    if runs:
        first = runs[0][0]
        for k, placed in greedy(runs, least_capacity(runs, shards))[1]:
            size = runs[k][0]
            found.append((size, placed + (alone if size == first else 0)))
    return found


def ranked(frame: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """`name`: 0, 1, ... within `group`, without one task for a whole group: rows are numbered inside buckets of `spread`
    and the rows of earlier buckets are added."""
    frame = frame.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = frame.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = frame.withColumn("_number", F.row_number().over(inside).cast("long"))
    return (numbered.join(offsets.hint("merge"), [*group, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_number") - 1).drop("_bucket", "_before", "_number"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row.

    A null text has no bytes: size 1, checksum 0; null texts are one group, apart from empty ones. Repeated rows are
    members of one group and get slots of their own. With fewer groups than shards the last shards stay empty; an empty
    table gives an empty result."""
    text = F.col("text").cast("string")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit("null").cast("binary")).alias("key")))
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("members")))
    by_size = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members")).collect()
    total = sum(r["members"] for r in by_size)
    begins = cuts(sorted(((r["group_size"], r["groups"]) for r in by_size), reverse=True), shards)

    inner = sorted({size for size, before in begins if before})  # sizes whose groups fall into several shards
    many = max((r["groups"] for r in by_size if r["group_size"] in inner), default=1)
    placed = groups.withColumn("rank", F.lit(0).cast("long"))
    if inner:
        straddling = ranked(groups.where(F.col("group_size").isin(inner)), ["group_size"], [F.col("key")], F.col("key"), max(many // ROWS_PER_BUCKET, 1), "rank")
        placed = placed.where(~F.col("group_size").isin(inner)).unionByName(straddling)
    shard = F.lit(0)
    for size, before in begins:
        shard = shard + F.when((F.col("group_size") < size) | ((F.col("group_size") == size) & (F.col("rank") >= before)), 1).otherwise(0)
    placed = stored(placed.select("key", "members", shard.cast("int").alias("shard")))
    with_shard = join_heavy(rows, placed, "key", "members", total).drop("members")
    slots = ranked(with_shard, ["shard"], [F.col("doc_id"), F.col("key")], F.col("doc_id"), max(total // ROWS_PER_BUCKET, 1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
