"""Exact places in one sort: every row's rank, ties and group size after a single exchange.

Rows are exchanged once by range of (group, value, tie columns), so partitions are even whatever the groups and values: a group or a value that
holds half of all rows spreads over many partitions. Each task walks its sorted rows and counts inside its partition; a group or a value that
goes on in the next partition is made whole by four numbers per partition, which the driver adds up from one short row each. The number of partitions
grows with the rows, so that what a task holds does not.
Several columns are ranked in the same sort when they are stacked under a name that is part of the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bartide.session import cut_lineage

#: rows of one partition of the sort, which its Python task holds; larger tables get more partitions
PART_ROWS = 1 << 18
#: what `placed` adds
PLACES = ("_before", "_ties", "_total", "_place")
_COUNTS = "_part int, _n long, _at long, _before long, _ties long, _group_end int, _run_end int"


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal to each other."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _runs(change: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row, length) of the run that each row is in."""
    starts = np.flatnonzero(np.concatenate(([True], change)))
    lengths = np.diff(np.append(starts, n))
    return np.repeat(starts, lengths), np.repeat(lengths, lengths)


def _ends(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """1 for the rows of the first run of the partition, 2 for those of the last one, 3 if that is the same."""
    return (first == 0).astype(np.int32) + 2 * (first + length == n).astype(np.int32)


def _counter(groups: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        group = np.zeros(n - 1, bool)
        for k in range(groups):
            group |= _changes(table.column(k))
        run = group | _changes(table.column(groups))
        g_first, g_length = _runs(group, n)
        r_first, r_length = _runs(run, n)
        added = {"_n": g_length, "_at": np.arange(n) - g_first, "_before": r_first - g_first, "_ties": r_length}
        for name, values in added.items():
            table = table.append_column(name, pa.array(values.astype(np.int64)))
        for name, ends in (("_group_end", _ends(g_first, g_length, n)), ("_run_end", _ends(r_first, r_length, n))):
            table = table.append_column(name, pa.array(ends))
        yield from table.to_batches(max_chunksize=65536)
    return count


def _carried(parts: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """(part, rows of the first group in earlier parts, rows of the first run there, rows of the last group in later parts, of the last run there), from
    the first and last group and run of every partition in order."""
    out = []
    for way in (1, -1):
        near, far = ("first", "last") if way == 1 else ("last", "first")
        carry = {"group": (None, 0), "run": (None, 0)}
        row = {}
        for p in parts[::way]:
            found = []
            for kind in ("group", "run"):
                key, rows = carry[kind]
                found.append(rows if key is not None and key == p[f"{near}_{kind}"] else 0)
                whole = p[f"first_{kind}"] == p[f"last_{kind}"]
                carry[kind] = (p[f"{far}_{kind}"], p[f"{far}_{kind}_rows"] + (found[-1] if whole else 0))
            row[p["part"]] = found
        out.append(row)
    return [(p["part"], *out[0][p["part"]], *out[1][p["part"]]) for p in parts]


def _ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` exchanged by range of `order`. A given number of partitions is not merged again into fewer large ones."""
    parts = -(-rows.count() // PART_ROWS)
    if parts <= 1:
        return rows.repartitionByRange(*order)
    return rows.repartitionByRange(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *order)


def placed(rows: DataFrame, by: Sequence[str], value: str, tie: Sequence[str] = ()) -> DataFrame:
    """`rows` with, per group `by` and among its rows with a known `value`, in rising order of (value, tie): `_before` (rows with a smaller value), `_ties` (rows
    with this value), `_total` and `_place` (from 1). Null values count in no group and get no numbers; -0.0 is 0.0.

    Rows that agree in every column are the only ones that cannot be spread over partitions."""
    spark = rows.sparkSession
    known = rows.withColumn(value, F.col(value) + F.lit(0.0)).withColumn("_known", F.col(value).isNotNull())
    keys = [*by, "_known"]
    others = [c for c in known.columns if c not in (*keys, value)]
    order = [*keys, value, *tie, "_salt"]
    # the hash of the whole row tells equal values apart, and a recomputed task sends a row where it went before
    ranged = _ranged(known.withColumn("_salt", F.xxhash64(*rows.columns)), order).sortWithinPartitions(*order).drop("_salt")
    ranged = ranged.select(*keys, value, *others, F.spark_partition_id().alias("_part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", " + _COUNTS.split(", ", 1)[1]
    counted = cut_lineage(ranged.mapInArrow(_counter(len(keys)), schema))
    group, run = F.struct(*keys), F.struct(*keys, value)
    ends = []
    for kind, key, rows_of in (("group", group, "_n"), ("run", run, "_ties")):
        for side, bit in (("first", 1), ("last", 2)):
            here = F.when(F.col(f"_{kind}_end").bitwiseAND(bit) > 0, F.struct(key.alias("k"), F.col(rows_of).alias("n")))
            ends.append(F.first(here, ignorenulls=True).alias(f"{side}_{kind}"))
    summary = counted.groupBy("_part").agg(*ends).orderBy("_part").collect()  # a row per partition
    parts = [{"part": r["_part"]} | {k: tuple(r[k]["k"]) for k in ("first_group", "last_group", "first_run", "last_run")}
             | {f"{k}_rows": r[k]["n"] for k in ("first_group", "last_group", "first_run", "last_run")} for r in summary]
    carried = spark.createDataFrame(_carried(parts), "_part int, _g0 long, _r0 long, _g1 long, _r1 long")
    at = lambda kind, bit, column: F.when(F.col(f"_{kind}_end").bitwiseAND(bit) > 0, F.col(column)).otherwise(0)
    before_group, before_run = at("group", 1, "_g0"), at("run", 1, "_r0")
    whole = counted.join(F.broadcast(carried), "_part")
    numbers = {"_before": F.col("_before") + before_group - before_run, "_ties": F.col("_ties") + before_run + at("run", 2, "_r1"),
               "_total": F.col("_n") + before_group + at("group", 2, "_g1"), "_place": F.col("_at") + before_group + 1}
    return whole.select(*rows.columns, *[F.when(F.col("_known"), expr).alias(name) for name, expr in numbers.items()])


def average_rank() -> Column:
    """Mean rank of a row's ties, of what `placed` adds."""
    return F.col("_before") + (F.col("_ties") + 1) / F.lit(2.0)


def stacked(rows: DataFrame, keep: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per value column: `keep`, `name` and `x`, so that one sort ranks them all."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])))


def with_percentiles(rows: DataFrame, by: Sequence[str], key: Sequence[str], values: dict[str, str]) -> DataFrame:
    """`rows` with the percentile rank (mean rank of ties over the known rows of the group) of each of `values` (column: new name), null where the value
    is null; `key` and `by` together name a row. One sort for all columns, and one exchange to bring them back."""
    ranks = placed(stacked(rows, [*by, *key], list(values)), [*by, "name"], "x", list(key))
    share = F.when(F.col("x").isNotNull(), average_rank() / F.col("_total"))
    wide = ranks.groupBy(*by, *key).agg(*[F.max(F.when(F.col("name") == v, share)).alias(new) for v, new in values.items()])
    return rows.join(wide, [*by, *key])
