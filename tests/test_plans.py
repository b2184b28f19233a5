"""Shape of the plans: no Python in them, pruned scans, small shuffles."""

import re

import pytest

import __spark_entry__ as entry
from mlwatch.operators import prepare
from mlwatch.plans import queries, views
from mlwatch.plans.queries import QUERIES
from mlwatch.sources import history

BATCH = [k for k in QUERIES if not k.startswith(("stream_", "train_", "retrain_"))]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_python_and_no_cross_join(spark, sf, key):
    plan = physical(entry.queries()[key](spark, sf))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|CartesianProduct", plan)
    assert "BroadcastNestedLoopJoin" not in plan


def test_log_window_reads_only_what_it_needs(spark, sf):
    plan = physical(history.recent_log(views.preds(spark, sf), "2024-01-15 12:00:00", 24, "m1"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "event_id" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_trips_read_only_used_columns(spark, sf):
    plan = physical(views.trips(spark, sf).select("fare_amount"))
    schema = next(s for s in plan.split("ReadSchema: ")[1:] if "l_extendedprice" in s).splitlines()[0]
    assert "l_shipdate" not in schema and "l_discount" not in schema and "l_quantity" not in schema


def test_trips_shuffle_line_items_for_their_orders_only(spark, sf):
    plan = physical(views.trips(spark, sf))
    assert "hashpartitioning(l_orderkey" in plan  # orders grow with the line items: they are not broadcast
    assert "hashpartitioning(o_custkey" not in plan and "hashpartitioning(l_suppkey" not in plan


def test_split_for_training_hashes_its_keys_once(spark, sf):
    parts = queries._fitting_and_testing(spark, sf)
    ready = prepare.prepare(views.featured(spark, sf), views.SPEC, keep=views.KEYS)
    for part, lazy in zip(parts, prepare.split_by_key(ready, views.KEYS)):
        assert "md5" not in physical(part) and "md5" in physical(lazy)
        assert part.exceptAll(lazy).isEmpty() and lazy.exceptAll(part).isEmpty()


def test_runs_of_a_check_do_not_read_its_log_again(spark, sf):
    assert "l_orderkey" not in physical(entry.queries()["monitor_log"](spark, sf))
