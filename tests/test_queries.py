from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from bartide.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLED = ["price_bars", "back_adjusted_prices", "directional_index", "review_table", "multi_factor_table", "value_at_risk", "window_metrics", "strategy_table",
           "daily_values", "attribution_summary", "replacement_plan", "rotation_panel", "company_page_metrics", "pledge_disclosures", "streamed_bars"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_contract_is_consistent():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names and len(names) > 150
    for q in registry.all_queries():
        columns = [n for n, _ in q.fields()]
        assert len(columns) == len(set(columns)), q.name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["symbol", "rs_63", "ret_63", "bench_63", "position"] and frame.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = contract.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    answer = db.execute(contract.oracle_sql()[name])
    places = [[d[0] for d in answer.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(plain(r[p]) for p in places) for r in answer.fetchall())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["last_tick_per_day", "upserted_rates", "latest_rates", "intraday_bars"])
def test_raw_rows_are_hashed_and_not_sorted(spark, name):
    plan = plan_of(registry.by_name()[name].run(spark, FOLDER))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_price_folders_are_pruned_by_year(spark):
    plan = plan_of(registry.by_name()["price_files"].run(spark, FOLDER))
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["minimum_variance_weights", "equal_risk_weights", "hedged_value_at_risk", "risk_summary", "table_consistency", "action_files", "day_files", "page_texts", "universe_covariance", "universe_weights", "grown_index_levels",
                                  "batch_outcomes", "merged_rates", "latest_turnover_files", "restated_factors", "trailing_stop_alerts", "review_members", "output_agreement"])
def test_newer_queries_equal_sql(spark, name):
    test_query_equals_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_bars_stay_in_hash_aggregates(spark):
    plan = registry.by_name()["price_bars"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "l_comment" not in plan and "CartesianProduct" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, most", [("replacement_plan", 60), ("selection_ranking", 20), ("signal_scorecard", 10), ("strategy_table", 40)])
def test_raw_rows_are_not_read_again_by_the_last_plan(spark, name, most):
    plan = plan_of(registry.by_name()[name].run(spark, FOLDER))
    assert plan.count("lineitem.parquet") == 0 and plan.count("Exchange ") <= most


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_options_are_priced_once_for_all_books(spark):
    from bartide.operators import options as op
    from bartide.plans import options as plans

    rows = plans.strategy_plans(spark, FOLDER)
    levels = rows.select("underlying", op.F.explode(op.F.sequence(op.F.lit(0), op.F.lit(4))).alias("scenario"), (op.F.col("scenario") / 100.0).alias("index_ret"))
    legs = rows.select("underlying", "spot", op.F.inline("legs")).where("iv is not null")
    doubled = legs.unionByName(legs)
    once = op.contract_cube(legs, levels, plans.HORIZON, plans.RATE).count()
    assert once == op.contract_cube(doubled, levels, plans.HORIZON, plans.RATE).count() == legs.select(*op.CONTRACT, "spot").distinct().count() * 5
