from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bartide.functions import text
from bartide.functions.numbers import group_rupees, parse_number
from bartide.operators import prep

BARS = "symbol string, session date, open double, high double, low double, close double, qty double, deliv_qty double, prev_close double"


def bars(spark, symbol, closes, first=dt.date(2026, 1, 5), listing=None):
    rows, before = [], listing
    for k, c in enumerate(closes):
        rows.append((symbol, first + dt.timedelta(days=k), float(c), float(c), float(c), float(c), 1000.0, 500.0, None if before is None else float(before)))
        before = c
    return spark.createDataFrame(rows, BARS)


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, ex_date date, ord long, kind string, factor double")


def closes(frame):
    return [r["close"] for r in frame.orderBy("session").collect()]


def test_split_rescales_earlier_rows(spark):
    raw = bars(spark, "A", [490, 500, 102, 104])
    out = prep.back_adjust(raw, actions(spark, ("A", dt.date(2026, 1, 7), 1, "split", 0.2)))
    assert closes(out) == pytest.approx([98, 100, 102, 104])
    first = out.orderBy("session").first()
    assert first["qty"] == pytest.approx(5000)
    ex = out.where(F.col("session") == dt.date(2026, 1, 7)).first()
    assert ex["close"] / ex["prev_close"] - 1 == pytest.approx(0.02)
    assert prep.unexplained_jumps(raw).count() == 1
    assert prep.unexplained_jumps(out).count() == 0


def test_bonus_and_gap(spark):
    b = prep.back_adjust(bars(spark, "B", [300, 303, 101]), actions(spark, ("B", dt.date(2026, 1, 7), 1, "bonus", 1 / 3)))
    assert closes(b) == pytest.approx([100, 101, 101])
    d = prep.back_adjust(bars(spark, "D", [100, 100, 60, 61]), actions(spark, ("D", dt.date(2026, 1, 7), 1, "gap", None)))
    assert closes(d) == pytest.approx([60, 60, 60, 61])


def test_actions_outside_the_window_change_nothing(spark):
    raw = bars(spark, "A", [100, 101])
    for day in (dt.date(2025, 12, 1), dt.date(2026, 1, 5), dt.date(2026, 3, 1)):
        assert closes(prep.back_adjust(raw, actions(spark, ("A", day, 1, "split", 0.5)))) == [100, 101]


def test_two_actions_on_one_day_and_a_gap_after_a_split(spark):
    raw = bars(spark, "A", [1000, 1000, 90])
    day = dt.date(2026, 1, 7)
    both = prep.back_adjust(raw, actions(spark, ("A", day, 1, "split", 0.2), ("A", day, 2, "bonus", 0.5)))
    assert closes(both) == pytest.approx([100, 100, 90])
    # the gap is what the split left over: together they explain the whole step
    gap = prep.back_adjust(raw, actions(spark, ("A", day, 1, "split", 0.2), ("A", day, 2, "gap", None)))
    assert closes(gap) == pytest.approx([90, 90, 90])


def test_listing_day_is_no_jump(spark):
    assert prep.unexplained_jumps(bars(spark, "N", [150, 152], listing=100)).count() == 0


def test_strict_and_inclusive_asof(spark):
    left = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (1, 3, 5)], "session date")
    right = spark.createDataFrame([(dt.date(2026, 1, 3), 1.0), (dt.date(2026, 1, 4), None), (dt.date(2026, 1, 5), 2.0)], "day date, v double")
    strict = {r["session"].day: r["v_asof"] for r in prep.as_of(left, right, "session", "day", "v").collect()}
    loose = {r["session"].day: r["v_asof"] for r in prep.as_of(left, right, "session", "day", "v", strict=False).collect()}
    assert strict == {1: None, 3: None, 5: 1.0}
    assert loose == {1: None, 3: 1.0, 5: 2.0}


def test_subjects(spark):
    subjects = ["Face Value Split (Sub-Division) - From Rs 10/- Per Share To  Rs 2/- Per Share", "Bonus 1:2", "Scheme Of Arrangement", "Dividend - Rs 3"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(subjects)], "k int, s string").select("k", text.action_parts("s").alias("a")).orderBy("k").collect()
    assert [(r["a"]["kind"], r["a"]["factor"]) if r["a"] else None for r in rows] == [
        ("split", pytest.approx(0.2)), ("bonus", pytest.approx(2 / 3)), ("gap", None), None]


def test_number_texts(spark):
    row = spark.range(1).select(parse_number(F.lit("₹1,234.5%")).alias("a"), parse_number(F.lit("-")).alias("b"), group_rupees(F.lit(123456789.0)).alias("c"),
                                group_rupees(F.lit(-999.4)).alias("d")).first()
    assert tuple(row) == (1234.5, None, "12,34,56,789", "-999")


def test_files_named_after_no_day_stay_where_they_are(spark):
    from bartide.sources import files

    rows = spark.createDataFrame([("A", "2001-05-07", "part-1.csv"), ("B", "2001-05-07", "bhav_07-May-2001.csv"), ("C", "2001-05-07", "bhav_08-May-2001.csv")], "symbol string, session string, file string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = files.own_session(rows.withColumn("session", F.col("session").cast("date")))
        assert sorted(r.symbol for r in kept.collect()) == ["A", "B"]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
