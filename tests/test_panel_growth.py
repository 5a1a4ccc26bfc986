"""Steps whose exchanges must not grow faster than their input."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from bartide.operators import backtests as bt


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_the_dates_whose_windows_they_lie_in(spark):
    calendar = spark.range(1, 61).select(F.col("id").cast("int").alias("n"))
    for reach, skip in ((12, 0), (9, 4), (1, 0)):
        got = bt.onto_dates(calendar, calendar, reach, warmup=20, every=7, horizon=6, skip=skip).select("n", "d").collect()
        dates = [d for d in range(1, 61) if d > 20 and (d - 21) % 7 == 0 and d - 1 + 6 < 60]
        assert sorted((r.n, r.d) for r in got) == sorted((n, d) for d in dates for n in range(d - skip - reach + 1, d - skip + 1))


def test_median_on_dates(spark):
    values = [3.0, None, 1.0, 8.0, 4.0, None, 7.0, 2.0]
    rows = spark.createDataFrame([("A", k + 3, v) for k, v in enumerate(values)], "symbol string, n int, v double")
    dates = spark.createDataFrame([(2,), (3,), (6,), (10,), (11,)], "n int")
    got = {r.n: r["median"] for r in bt.median_on_dates(rows, dates, "v", 4, 2).collect()}
    assert got == {3: None, 6: 3.0, 10: 4.0}


def test_price_panel_is_exchanged_once(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(7 * k) for k in range(4)]
    bars = spark.createDataFrame([("A", d, 10.0, 11.0, 9.0, 10.0, 5.0, 50.0, 1.0) for d in days],
                                 "symbol string, session date, close double, high double, low double, prev_close double, qty double, turnover double, deliv_qty double")
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "session date, n int")
    bench = spark.createDataFrame([(d, 1.0) for d in days], "session date, bench double")
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(bt.price_panel(bars, calendar, bench)))) == 1
