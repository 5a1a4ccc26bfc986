"""The oscillators' windows must not sort the bars again and again, nor in tasks that grow with the input."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bartide import session
from bartide.operators import indicators as ind
from bartide.operators.rolling import smoothed
from bartide.plans import registry
from bartide.sources import market as mk

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_directional_index_sorts_twice_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    plan = plan_of(registry.by_name()["directional_index"].run(spark, FOLDER))
    tasks = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 100)
    assert len(re.findall(r"Sort \[symbol", plan)) == 2
    assert re.findall(r"Exchange hashpartitioning\(symbol#\d+, (\d+)\), (\w+)", plan) == [(str(tasks), "REPARTITION_BY_NUM")]


def test_bars_by_symbol_are_the_weekly_bars(spark):
    plain, exchanged = mk.weekly_bars(spark, FOLDER), mk.weekly_bars_by_symbol(spark, FOLDER)
    key = ["symbol", "session"]
    assert exchanged.columns == plain.columns and exchanged.count() == plain.count()
    close = lambda rows: rows.select(*key, "close", "prev_close").orderBy(*key).collect()
    assert close(exchanged) == close(plain)


@pytest.mark.parametrize("length,seed_rows", [(14, None), (2000, None), (1500, 1)])
def test_smoothing_of_a_dense_series_equals_the_recurrence_over_several_blocks(spark, length, seed_rows):
    values, rows = np.random.default_rng(length).normal(50, 20, length), seed_rows or 14
    y, expected = None, []
    for k, x in enumerate(values):
        y = (y * 13 + x) / 14 if k >= rows else values[:rows].mean() if k == rows - 1 else None
        expected.append(y)
    first = dt.date(1990, 1, 1)
    frame = spark.createDataFrame([(s, first + dt.timedelta(k), float(x)) for s in "AB" for k, x in enumerate(values)], "symbol string, session date, x double")
    out = smoothed(frame.withColumn("z", -F.col("x")), {"y": "x", "w": "z"}, 14, seed_rows, dense=True)
    assert out.columns == ["symbol", "session", "x", "z", "y", "w"]
    got = out.orderBy("symbol", "session").collect()
    for r, b in zip(got, expected * 2, strict=True):
        assert (r["y"] is None) == (r["w"] is None) == (b is None)
        assert b is None or (r["y"] == pytest.approx(b, rel=1e-9, abs=1e-9) and r["w"] == pytest.approx(-b, rel=1e-9, abs=1e-9))


def test_last_oscillators_need_no_sort_of_their_own(spark):
    bars = mk.by_symbol(spark, FOLDER, mk.weekly_bars(spark, FOLDER))
    last = ind.last_oscillators(bars)
    assert not re.search(r"Sort \[symbol#\d+ ASC NULLS FIRST, session#\d+ DESC", plan_of(last))
    every = ind.oscillators(bars).groupBy("symbol").agg(F.max("session").alias("session"), F.max_by("adx", "session").alias("adx"), F.max_by("rsi", "session").alias("rsi"))
    rows = last.select("symbol", "session", "adx", "rsi").orderBy("symbol").collect()
    assert rows == every.orderBy("symbol").collect() and len({r.symbol for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["technical_summary", "trend_confirmed"])
def test_summaries_deal_their_oscillators_into_tasks_of_bounded_rows(spark, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    plan = plan_of(registry.by_name()[name].run(spark, FOLDER))
    tasks = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    assert re.search(rf"Exchange hashpartitioning\(symbol#\d+, {tasks}\), REPARTITION_BY_NUM", plan)
