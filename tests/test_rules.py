from __future__ import annotations

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from bartide.operators import ledger as lg
from bartide.operators import screening as sc
from bartide.sources import batches, files
from bartide.streaming import market as sm


def test_technical_verdict_is_strict(spark):
    strengths = [5.0, 2.01, 2.0, 0.01, 0.0, -3.0, None]
    trends = ["Bullish (Uptrend)", "Bearish (Downtrend)", "Neutral", None]
    rows = spark.createDataFrame(list(itertools.product(strengths, trends)), "rs_63 double, trend string")
    passed, reason = sc.technical_verdict()
    for r in rows.select("rs_63", "trend", passed.alias("p"), reason.alias("why")).collect():
        good = r["rs_63"] is not None and r["rs_63"] > 2
        bull = r["trend"] is not None and r["trend"].startswith("Bullish")
        assert r["p"] == (good and bull)
        parts = ([] if good else ["RS unavailable" if r["rs_63"] is None else "RS <= +2 pp"]) + ([] if bull else [f"trend {str(r['trend']).split(' (')[0]}"])
        assert r["why"] == "; ".join(parts)


def test_every_quadrant_pair_has_one_tier(spark):
    names = [sc.LEADING, sc.WEAKENING, sc.LAGGING, sc.IMPROVING]
    rows = spark.createDataFrame(list(itertools.product(names + [None], repeat=2)), "a string, b string").select("a", "b", sc.conviction("a", "b").alias("t")).collect()
    for r in rows:
        pair = {r["a"], r["b"]}
        want = None if None in pair else "High" if pair == {sc.LEADING} else "Moderate" if pair & {sc.LEADING, sc.IMPROVING} else "Low"
        assert r["t"] == want


def test_missing_values_fail_with_a_label(spark):
    rules = spark.createDataFrame([("S", 1, "roce", ">", 8.0, "ROCE > 8%", False), ("S", 2, "debt", "<", 1.5, "Debt < 1.5", True)],
                                  "sector string, ord int, field string, op string, threshold double, label string, hard boolean")
    rows = spark.createDataFrame([("A", "S", 8.0, 1.0), ("B", "S", None, 1.5), ("C", "S", 8.1, 1.4)], "symbol string, sector string, roce double, debt double")
    got = {r["symbol"]: r for r in sc.with_checks(rows, rules, ["roce", "debt"]).collect()}
    assert got["A"]["failed_criteria"] == "ROCE > 8%" and got["A"]["hard_pass"] and got["A"]["soft_fails"] == "ROCE > 8%"
    assert got["B"]["failed_criteria"] == "ROCE > 8% (missing); Debt < 1.5" and not got["B"]["hard_pass"]
    assert got["C"]["passes_screen"] and got["C"]["passed_count"] == 2


def test_picks_honour_minimums(spark):
    ranking = spark.createDataFrame([(k, f"S{k:02d}", "X" if k < 8 else "Y", "High" if k != 3 else "Low") for k in range(1, 13)],
                                    "selection_rank int, symbol string, sector string, conviction string")
    minimums = spark.createDataFrame([("Y", 2)], "sector string, minimum int")
    got = {r["symbol"] for r in sc.selected(ranking, 4, minimums).collect()}
    assert got == {"S08", "S09", "S01", "S02"}
    assert {r["symbol"] for r in sc.selected(ranking, 4).collect()} == {"S01", "S02", "S04", "S05"}


def test_daily_values_of_a_worked_ledger(spark):
    days = [dt.date(2026, 1, d) for d in (5, 6, 7)]
    trades = spark.createDataFrame([
        (1, days[0], "AAA", "BUY", 90000.0, 100.0, "a"), (1, days[0], "INDEX 2026-03-31 22000 PE", "BUY", 455.0, 300.0, "b"),
        (1, days[2], "AAA", "SELL", 10000.0, 120.0, "c")], "portfolio long, session date, instrument string, action string, quantity double, price double, ref string")
    bars = spark.createDataFrame([("AAA", d, c) for d, c in zip(days, (100.0, 110.0, 120.0))], "symbol string, session date, close double")
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "session date, n int")
    factors = spark.createDataFrame([(d, m, r) for d, m, r in zip(days, (50.0, 51.0, 52.0), (1000.0, 1000.2, 1000.4))], "session date, market double, rate double")
    marks = spark.createDataFrame([("INDEX 2026-03-31 22000 PE", 2, 280.0)], "instrument string, n int, settle double")
    got = lg.daily_values(trades, bars, calendar, factors, marks, 1e7).orderBy("n").collect()
    assert got[0]["total"] == pytest.approx(1e7)
    cash = 1e7 - 9e6 - 455 * 300
    assert got[1]["cash"] == pytest.approx(cash * 1000.2 / 1000) and got[1]["stocks"] == pytest.approx(9.9e6) and got[1]["options"] == pytest.approx(455 * 280)
    assert got[2]["cash"] == pytest.approx(cash * 1000.4 / 1000 + 1.2e6) and got[2]["options"] == pytest.approx(455 * 280)
    assert got[2]["market_value"] == pytest.approx(1.04e7)


def spread_by_hand(amount, weight, room):
    given, left = {s: 0.0 for s in weight}, amount
    while left > 1e-9:
        free = [s for s in weight if room[s] - given[s] > 1e-9]
        if not free:
            break
        level = min([left / sum(weight[s] for s in free)] + [(room[s] - given[s]) / weight[s] for s in free])
        for s in free:
            given[s] += level * weight[s]
        left -= level * sum(weight[s] for s in free)
    return given


def test_top_ups_equal_stepwise_filling(spark):
    weight, value, cap = {"A": 0.2, "B": 0.3, "C": 0.1, "D": 0.4}, {"A": 80.0, "B": 10.0, "C": 95.0, "D": 50.0}, 100.0
    holdings = spark.createDataFrame([(1, s, weight[s], value[s], cap) for s in weight], "portfolio int, buy string, weight double, value double, cap double")
    sources = spark.createDataFrame([(1, "X", 1, 60.0), (1, "Y", 2, 70.0), (1, "Z", 3, 500.0)], "portfolio int, sell string, k int, proceeds double")
    got = {(r["sell"], r["buy"]): r["amount"] for r in lg.topped_up(sources, holdings, 0.15).collect()}
    for sell, amount in (("X", 60.0), ("Y", 70.0), ("Z", 500.0)):
        given = spread_by_hand(amount, weight, {s: max(cap - value[s], 0) for s in weight})
        for s, v in given.items():
            assert got.get((sell, s), 0.0) == pytest.approx(v, abs=1e-6)
            value[s] += v


def test_price_files(spark, tmp_path):
    header = " SYMBOL, SERIES , DATE1, PREV_CLOSE, CLOSE_PRICE, TTL_TRD_QNTY\n"
    (tmp_path / "bhav_05-Jan-2026.csv").write_text(header + 'AAA , EQ, 05-Jan-2026, -," 1,100.5 ", 10\nBBB, GB, 05-Jan-2026, 1, 2, 3\nOLD, BE, 05-Jan-2026, 5, x, 7\n')
    (tmp_path / "bhav_06-Jan-2026.csv").write_text(header + "AAA, EQ, 05-Jan-2026, 1, 9, 10\n")
    aliases = spark.createDataFrame([("OLD", "NEW")], "old string, new string")
    rows = {r["symbol"]: r for r in files.read_prices(spark, str(tmp_path), aliases=aliases).collect()}
    assert set(rows) == {"AAA", "NEW"}
    assert rows["AAA"]["close"] == 1100.5 and rows["AAA"]["prev_close"] is None and rows["NEW"]["close"] is None
    assert rows["AAA"]["session"] == dt.date(2026, 1, 5)


def test_json_documents(spark, tmp_path):
    (tmp_path / "AAA.json").write_text(json.dumps([{"subject": "Bonus 1:1", "exDate": "07-Jan-2026"}, {"subject": "Dividend", "exDate": "08-Jan-2026"}]))
    rows = files.read_actions(spark, str(tmp_path)).collect()
    assert [(r["symbol"], r["ex_date"], r["kind"], r["factor"]) for r in rows] == [("AAA", dt.date(2026, 1, 7), "bonus", 0.5)]
    payloads = ['{"data": []}', '{"data": [{"shp": "31-Mar-2025", "percPromoterShares": "4.5"}, {"shp": "30-Jun-2025", "percPromoterShares": "2.25"}]}',
                '{"data": [{"shp": "30-Jun-2025", "percPromoterShares": " "}]}']
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "k int, p string").withColumn("share", files.pledge_share("p"))
    assert [r["share"] for r in frame.orderBy("k").collect()] == [0.0, 2.25, None]


def test_missing_total_return_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("IndexName,Date,Total Returns Index\nX,01-Jan-2026,5\n")
    with pytest.raises(ValueError, match="Net Total Return Index"):
        files.read_total_return(spark, str(tmp_path / "t.csv"))


def test_late_rows_and_bars_in_a_stream(spark, tmp_path):
    start = dt.datetime(2026, 1, 5, 9)
    rows = [(k, "A", start + dt.timedelta(minutes=30 * k), float(k)) for k in range(40)]
    spark.createDataFrame(rows, "id long, key string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    sm.run_to_table(sm.bars(stream, "ts", "key", "v", "id", "2 hours", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("session").collect()
    assert all(r["until"] <= rows[-1][2] - dt.timedelta(hours=1) for r in got)
    second = got[1]
    inside = [v for _, _, t, v in rows if second["session"] <= t < second["until"]]
    assert (second["open"], second["high"], second["low"], second["close"], second["qty"]) == (inside[0], max(inside), min(inside), inside[-1], len(inside))
    sm.append_latest(stream, str(tmp_path / "t2"), str(tmp_path / "s2"), ["key"], "id").awaitTermination()
    assert batches.read_latest(spark, str(tmp_path / "t2"), stream.schema, ["key"], "id").first()["v"] == 39.0


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "p int, v string")
    one = lg.fingerprint(rows, ["p"], ["v"]).first()
    two = lg.fingerprint(rows.orderBy(F.desc("v")), ["p"], ["v"]).first()
    three = lg.fingerprint(rows.replace("c", "d"), ["p"], ["v"]).first()
    assert one == two and one["digest"] != three["digest"]


def test_references_are_read_as_the_standard_library_reads_them(spark):
    import html
    from html.entities import html5

    from bartide.functions.text import decoded_entities

    samples = [f"x&{n}y" for n in html5] + [f"&{n};z" for n in html5] + [f"&#{n};" for n in [*range(0, 300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10 ** 30]]
    samples += [f"&#x{n:x}" for n in (0, 13, 0x41, 0x80, 0x9F, 0x1F600, 0x110000, 16 ** 9)] + ["&#X41;b", "&#0065;", "&#00000000000065 x", "&#;", "&#x;", "&", "&&amp;", "a & b", "&amp;lt;", "&#38;lt; .. &lt;", "&copy 2020",
                "&notit;", "&notin;", "&NotARealName;", "&am", "&amplt", "&thetasymx", "", "no reference", "&frac12&frac34;", "&é;", "&check;&apos;", "&#150;"]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string").repartition(3)
    found = {r.i: r.d for r in rows.select("i", decoded_entities(rows["t"]).alias("d")).collect()}
    wrong = [(s, found[i], html.unescape(s)) for i, s in enumerate(samples) if found[i] != html.unescape(s)]
    assert not wrong, wrong[:5]
