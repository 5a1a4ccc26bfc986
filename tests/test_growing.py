"""Tables that grow by batches, restated levels, the latest days by folder names, stops as keyed state."""

from __future__ import annotations

import json
import os
from datetime import date, timedelta

import pytest

from bartide.operators import prep
from bartide.sources import batches, files
from bartide.streaming import stops

LEVELS = "name string, day int, level double"


def levels(spark, days, shift=0.0, name="A"):
    return spark.createDataFrame([(name, d, 100.0 + d + shift) for d in days], LEVELS)


def part_files(table):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(f"{table}/parts") for f in names)


def test_batches_are_whole_or_nothing(spark, tmp_path):
    table = str(tmp_path / "levels")
    take = lambda days, batch, **k: batches.append(spark, table, levels(spark, days, **k), batch, ["name", "day"], ["level"])
    assert take(range(10), "one") == batches.Outcome("appended", 10)
    assert take(range(5, 15), "two") == batches.Outcome("appended", 5)
    before = part_files(table)
    assert take(range(5, 15), "two") == batches.Outcome("repeated", 0)
    assert take(range(0, 12), "three") == batches.Outcome("nothing new", 0)
    assert take(range(12, 20), "four", shift=1.0) == batches.Outcome("conflict", 3)
    assert part_files(table) == before and batches.current(spark, table).number == 2
    assert take(range(14, 16), "five", shift=0.005) == batches.Outcome("appended", 1)  # within the tolerance: the stored level stays
    rows = {r.day: r.level for r in batches.read(spark, table, levels(spark, []).schema).collect()}
    assert rows == {d: 100.0 + d for d in range(15)} | {15: 115.005}


def test_a_staged_batch_that_was_never_listed_is_not_read(spark, tmp_path):
    table = str(tmp_path / "levels")
    batches.append(spark, table, levels(spark, range(3)), "one", ["name", "day"], ["level"])
    levels(spark, range(50, 60)).write.parquet(f"{table}/parts/lost")  # a writer that ended between staging and listing
    assert batches.read(spark, table, levels(spark, []).schema).count() == 3
    assert batches.append(spark, table, levels(spark, range(50, 52)), "again", ["name", "day"], ["level"]).rows == 2
    assert batches.forget_old_parts(spark, table) == 1 and batches.read(spark, table, levels(spark, []).schema).count() == 5


def test_of_two_writers_one_looks_again(spark, tmp_path):
    table = str(tmp_path / "levels")
    assert batches.publish(spark, table, batches.Version(1, [], ["x"])) and not batches.publish(spark, table, batches.Version(1, [], ["y"]))
    assert batches.current(spark, table).batches == ["x"] and [f for f in os.listdir(f"{table}/lists") if f.startswith("_")] == []
    assert json.load(open(f"{table}/lists/000000000001.json")) == {"parts": [], "batches": ["x"]}


def test_versions_of_a_key_stay_few(spark, tmp_path):
    table, schema = str(tmp_path / "rates"), "key int, at long, rate double"
    for k in range(21):
        rows = spark.createDataFrame([(i, k, float(k)) for i in range(6) if (i + k) % 3], schema)
        assert batches.upsert(spark, table, rows, str(k), ["key"], "at").status == "appended"
    assert batches.upsert(spark, table, rows, "20", ["key"], "at").status == "repeated"
    version = batches.current(spark, table)
    assert len(version.parts) <= 2 * (batches.MERGE_AT - 1) and len(version.batches) == 21
    read = batches.read(spark, table, rows.schema)
    assert read.count() <= 6 * len(version.parts)
    assert {r.key: r.rate for r in batches.latest(read, ["key"], "at").collect()} == {i: float(max(k for k in range(21) if (i + k) % 3)) for i in range(6)}


def test_latest_days_are_chosen_by_folder_names(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(f"S{k}", date(2001, 1, 1) + timedelta(7 * d), float(d)) for k in range(4) for d in range(20)]
    spark.createDataFrame(rows, "symbol string, session date, close double").repartition("session").write.partitionBy("session").parquet(path)
    found = files.latest_days(spark, path, 3, "2001-03-20")
    assert {str(r.session) for r in found.select("session").distinct().collect()} == {"2001-03-05", "2001-03-12", "2001-03-19"} and found.count() == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "session" in plan.split("PartitionFilters: [")[1].split("]")[0]
    opened = {os.path.dirname(r[0]) for r in found.selectExpr("input_file_name()").collect()}
    assert len(opened) == 3
    assert files.latest_days(spark, path, 3, "1999-01-01").count() == 0


def test_levels_are_restated(spark):
    start = date(2001, 1, 1)
    rows = [(start + timedelta(d), start + timedelta(d + (30 if d in (3, 4) else 0)), 100.0 + d * d, 50.0 + d) for d in range(10)]
    table = spark.createDataFrame(rows, "session date, published date, level double, price double")
    found = {(str(r.as_of), (r.session - start).days): (r.filled, r.provisional) for r in prep.levels_as_of(table, ["2001-01-06", "2001-02-28"]).collect()}
    assert len(found) == 6 + 10
    assert found["2001-01-06", 3] == (pytest.approx(104 * 53 / 52), True) and found["2001-01-06", 4] == (pytest.approx(104 * 54 / 52), True)
    assert found["2001-02-28", 3] == (109.0, False) and found["2001-01-06", 5] == found["2001-02-28", 5] == (125.0, False)


def batch_rule(closes, share, near, idle):
    """(session, stop, alert) of one symbol's closes in order."""
    out, high, last, hit = [], None, None, False
    for session, close in closes:
        if last is not None and (session - last).days > idle:
            high, hit = None, False
        if high is not None and not hit:
            stop = high * share
            if close <= stop:
                out.append((session, stop, "breached"))
                hit = True
            elif close <= stop * (1 + near / 100):
                out.append((session, stop, "near"))
        high, last = close if high is None else max(high, close), session
    return out


def test_stops_go_on_after_restarts(spark, tmp_path):
    import random
    rng = random.Random(4)
    rows = []
    for k in range(5):
        price, day = 100.0, date(2001, 1, 1)
        for _ in range(60):
            price *= 1 + rng.uniform(-0.04, 0.045)
            day += timedelta(rng.choice([1, 1, 2, 3, 3, 30]))
            rows.append((f"S{k}", day, price))
    cut = sorted({r[1] for r in rows})
    bounds = [date(1990, 1, 1), cut[len(cut) // 4], cut[len(cut) // 2], date(2100, 1, 1)]
    folder = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for low, high in zip(bounds, bounds[1:]):  # three runs, each from the state of the one before
        lot = [r for r in rows if low <= r[1] < high]
        rng.shuffle(lot)
        spark.createDataFrame(lot, "symbol string, session date, close double").selectExpr("*", "timestamp(session) as at").repartition(3).write.mode("append").parquet(folder["in"])
        stream = spark.readStream.schema("symbol string, session date, close double, at timestamp").parquet(folder["in"])
        stops.run_alerts(spark, stops.trailing_alerts(stream, 0.95, 1.0, 10), folder["out"], folder["state"])
    found = sorted((r.symbol, r.session, round(r.stop, 9), r.alert) for r in spark.read.schema(stops.ALERTS).parquet(folder["out"]).collect())
    expected = sorted((s, d, round(stop, 9), kind) for s in {r[0] for r in rows} for d, stop, kind in batch_rule(sorted((r[1], r[2]) for r in rows if r[0] == s), 0.95, 1.0, 10))
    assert found == expected and {a for *_, a in found} == {"near", "breached"}
