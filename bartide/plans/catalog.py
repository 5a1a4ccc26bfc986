"""A registered query: the Spark plan, the equivalent SQL and the output columns both are cast to."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bartide.functions.numbers import half_away
from bartide.session import one_set_of_tables


@dataclass(frozen=True)
class Query:
    """`columns` lists 'name:kind' with kind s (text), d (date as text), b (flag as text), i (count) or a number of
    decimals for a floating-point value. `covers` are inventory ids."""

    name: str
    covers: str
    columns: str
    build: Callable[[SparkSession, str], DataFrame] = field(repr=False)
    sql: str | None = field(default=None, repr=False)
    shared: bool = False  # whether its parts read tables that are better computed once

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.columns.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        with one_set_of_tables() if self.shared else nullcontext():
            rows = self.build(spark, folder)
        return rows.select(*[_cast(n, k).alias(n) for n, k in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shaped = ", ".join(f"{_cast_sql(n, k)} AS {n}" for n, k in self.fields())
        return f"SELECT {shaped} FROM ({self.sql}) AS answer"


def _cast(name: str, kind: str) -> Column:
    if kind in "sdb":
        return F.col(name).cast("string")
    if kind == "i":
        return F.col(name).cast("long")
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), half_away(value, int(kind)))


def _cast_sql(name: str, kind: str) -> str:
    if kind in "sdb":
        return f"CAST({name} AS VARCHAR)"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    value = f"CAST({name} AS DOUBLE)"
    rounded = f"round({value}, {kind})"
    return f"CASE WHEN isnan({value}) OR isinf({value}) THEN NULL WHEN {rounded} = 0 THEN 0.0 ELSE {rounded} END"
