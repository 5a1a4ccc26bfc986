"""Stored tables that stay dealt by their key, and scores of signals whose symbols come once or twice on a date."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bartide.operators import backtests as bt
from bartide.operators import rolling as rl
from bartide.plans import backtests as plans
from bartide.session import cut_as_dealt

FOLDER = "/root/testdata/sf0.001"


def exchanges(frame):
    return len(re.findall(r"Exchange hashpartitioning", frame._jdf.queryExecution().executedPlan().toString()))


def test_a_stored_table_stays_dealt_and_sorted(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("symbol"), "id").repartition(5, "symbol").sortWithinPartitions("symbol", "id")
    stored = cut_as_dealt(rows)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    after = stored.withColumn("before", F.lag("id").over(Window.partitionBy("symbol").orderBy("id")))
    assert exchanges(after) == 0 and "Sort [" not in after._jdf.queryExecution().executedPlan().toString()
    assert after.where("id - before = 7").count() == 993


def test_branches_of_a_panel_do_not_exchange_it(spark):
    panel, calendar, _ = plans.panel_of(spark, FOLDER)
    assert exchanges(bt.momentum_moves(panel, (21, 63), 26)) == 0
    assert exchanges(bt.trend_columns(panel)) == 0
    assert exchanges(bt.rolled_on_dates(plans.onto_dates(panel.withColumn("daily", F.col("close")), calendar, 252))) == 0


def test_one_gap_inside_is_filled(spark):
    values = [None, 1.0, None, 2.0, None, None, 3.0, None]
    rows = spark.createDataFrame([("A", k, v) for k, v in enumerate(values)], "symbol string, n int, v double")
    got = [r.f for r in rows.withColumn("f", rl.carried_once_inside("v", order="n")).orderBy("n").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 2.0, None, 3.0, None]


@pytest.mark.parametrize("marked", [True, False])
def test_scores_of_symbols_that_come_once_or_twice(spark, marked):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame([(f"S{s:02d}", n, "in sample", float(rng.integers(0, 12)), float(rng.integers(0, 15)) if rng.random() < 0.9 else None) for n in (1, 2, 3) for s in range(40)],
                        columns=["symbol", "n", "period", "fwd_rs", "a"])
    rows = pd.concat([rows, rows[(rows.n == 2) & (rows.symbol < "S05")]])
    panel = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "symbol string, n int, period string, fwd_rs double, a double").repartition(4)
    tall = bt.tall_signals(bt.with_repeats(panel) if marked else panel, ["a"])
    assert ("repeated" in tall.columns) == marked
    got = {r.n: r for r in bt.date_scores(tall, 4, 25).collect()}
    for n, group in rows.dropna().groupby("n"):
        group = group.assign(ra=group.a.rank(), rb=group.fwd_rs.rank()).sort_values(["a", "symbol"])
        group["low"] = np.arange(1, len(group) + 1)
        down = group.sort_values(["a", "symbol"], ascending=[False, True], kind="stable").copy()
        down["high"] = np.arange(1, len(down) + 1)
        q80 = group.a.quantile(0.8)
        once = group.groupby("symbol").agg(a=("a", "max"), fwd=("fwd_rs", "max"), ra=("ra", "max"), rb=("rb", "max"), low=("low", "max")).join(down.groupby("symbol").high.max())
        assert got[n].names == len(once) and got[n].ic == pytest.approx(once.ra.corr(once.rb))
        assert got[n].spread == pytest.approx(once.fwd[once.a >= q80].mean() - once.fwd.mean())
        assert got[n].best_beats == (once.fwd[once.high <= 4].mean() > 0) and got[n].worst_beats == (once.fwd[once.low <= 4].mean() > 0)
