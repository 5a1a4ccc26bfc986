"""Places, ties and totals of one sort against pandas, with groups and values that cross partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bartide.operators import ordering


def table(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.choice([1.0, 2.0, 2.5, -0.0, 0.0], n)
    x = np.where(rng.random(n) < 0.5, 2.0, x)  # one value holds half of the rows
    x = np.where(rng.random(n) < 0.2, rng.standard_normal(n), x)
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", None], n))
    return pd.DataFrame({"g": group, "id": np.arange(n), "x": np.where(rng.random(n) < 0.1, np.nan, x)})


def expected(t):
    known = t[t.x.notna()].copy()
    known["g"] = known.g.fillna("~")
    known["x"] = known.x + 0.0
    known = known.sort_values(["g", "x", "id"])
    known["place"] = known.groupby("g").cumcount() + 1
    known["before"] = known.groupby("g").x.rank(method="min").astype(int) - 1
    known["ties"] = known.groupby(["g", "x"]).x.transform("size")
    known["total"] = known.groupby("g").x.transform("size")
    return {r.id: (r.before, r.ties, r.total, r.place) for r in known.itertuples()}


@pytest.mark.parametrize("parts", [1, 3, 37])
def test_places(spark, parts):
    t = table()
    rows = [(None if r.g is None else r.g, int(r.id), None if np.isnan(r.x) else float(r.x)) for r in t.itertuples()]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ordering.placed(spark.createDataFrame(rows, "g string, id long, x double").repartition(5), ["g"], "x", ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    numbers = expected(t)
    assert len(found) == len(t)
    for r in found:
        assert (r._before, r._ties, r._total, r._place) == (numbers[r.id] if r.x is not None else (None,) * 4)


def test_a_value_of_half_of_the_rows_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20000).selectExpr("'all' as g", "id", "if(id % 2 = 0, -1.0, id) as x")
        plan = ordering.placed(rows, ["g"], "x", ["id"])
        sizes = [r["count"] for r in plan.where("x = -1").groupBy(ordering.F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 10000 and max(sizes) < 8000 and plan.where("_ties = 10000").count() == 10000


def test_no_group_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None)], "id long, x double")
    assert sorted((r.id, r._before, r._ties, r._total, r._place) for r in ordering.placed(rows, [], "x", ["id"]).collect() if r.x) == [(1, 1, 2, 3, 2), (2, 0, 1, 3, 1), (3, 1, 2, 3, 3)]
    assert ordering.placed(rows.limit(0), [], "x", ["id"]).count() == 0


def test_percentiles_of_several_columns(spark):
    t = table(300, 9)
    t["g"] = t.g.fillna("none")
    t["y"] = (t.id * 7 % 50).astype(float)
    rows = [(r.g, int(r.id), None if np.isnan(r.x) else float(r.x), r.y) for r in t.itertuples()]
    found = ordering.with_percentiles(spark.createDataFrame(rows, "g string, id long, x double, y double"), ["g"], ["id"], {"x": "px", "y": "py"}).collect()
    for c in ("x", "y"):
        share = t.groupby("g")[c].rank(pct=True)
        for r in found:
            assert r[f"p{c}"] == (pytest.approx(share[r.id]) if not np.isnan(share[r.id]) else None)


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART_ROWS", 1000, raising=False)
    rows = spark.range(30000).selectExpr("'all' as g", "id", "cast(id % 7 as double) as x")
    plan = ordering.placed(rows, ["g"], "x", ["id"])
    sizes = [r["count"] for r in plan.groupBy(ordering.F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30000 and max(sizes) < 3000 and plan.where("_total = 30000").count() == 30000
