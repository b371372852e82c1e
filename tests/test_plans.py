"""Physical-plan properties that carry the scale design (checked with the executed plan text)."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from daygrain.operators import daily, folds as fo, matrix as mx
from daygrain.sources import views


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_stats_partial_aggregation_and_pruned_scan(spark):
    """Both sensors' statistics come from one scan and one partially aggregated pass; queries read what it wrote."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, SF_SMALL))
    sensors = [("value", "v1", None), ("value", "v1err", F.col("category") == "error")]
    plan = _plan(daily.daily_stats_aggregate(v1, sensors)[0])
    assert "partial_count" in plan and "partial_stddev_samp" in plan and "partial_percentile_approx" in plan
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 1 and "event_id" not in scans[0]     # projection reached the reader
    only = [line for line in _plan(daily.daily_stats_aggregate(v1, sensors[:1])[0]).split("\n") if "FileScan parquet" in line]
    assert len(only) == 1 and "event_type" not in only[0]
    for name in ("daily_stats", "spine_join", "relative_features"):
        assert "events.parquet" not in _plan(E.queries()[name](spark, SF_SMALL))


def test_searches_multiply_no_rows_by_a_grid(spark):
    for name in ("alpha_search", "calibration_search", "oof_sweep"):
        assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", _plan(E.queries()[name](spark, SF_SMALL))), name


def test_recent_tail_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["recent_prior"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_change_count_windows_are_chunked(spark):
    v1 = daily.with_date_keys(views.sensor_scalar(spark, SF_SMALL))
    plan = _plan(daily.daily_changes(v1, ["value"], "v"))
    windows = [l for l in plan.split("\n") if l.strip().startswith(("Window [", "+- Window [", ":- Window ["))]
    assert windows and any("_chunk" in l for l in windows)


def test_fold_row_numbers_are_bucketed(spark):
    plan = _plan(fo.stratified_folds(views.labelled(spark, SF_SMALL)))
    rn = [l for l in plan.split("\n") if "row_number()" in l and "Window [" in l]
    assert rn and all("_bk" in l for l in rn)


def test_list_sensors_read_only_their_fields(spark):
    for name, absent in (("label_entropy", ["l_extendedprice", "l_quantity"]),
                         ("array_row_stats", ["l_discount", "l_quantity", "l_returnflag"])):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "l_linenumber" in plan and "p_partkey" not in plan and "part.parquet" not in plan
        assert not any(c in plan for c in absent), name
    assert "p_brand" in _plan(E.queries()["daily_usage"](spark, SF_SMALL))


def test_dense_one_hot_compares_no_row_with_the_vocabulary(spark):
    """A row's array is filled around its value's place; neither the vocabulary nor a comparison an element is part of a row's work."""
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c"), (5, "b")], "id int, v string")
    out = mx.one_hot_array(df, "v", "hot")
    plan = _plan(out)
    assert "transform(" not in plan and "lambda" not in plan and "collect_set" not in plan and "NestedLoop" not in plan
    assert {r["id"]: r["hot"] for r in out.collect()} == {1: [0.0, 1.0, 0.0], 2: [0.0, 0.0, 0.0], 3: [1.0, 0.0, 0.0], 4: [0.0, 0.0, 1.0], 5: [0.0, 1.0, 0.0]}


def test_dense_one_hot_rows_are_dealt_by_their_numbers(spark, monkeypatch):
    """Rows of few bytes that grow to many numbers are not left to the one task that their bytes would ask for."""
    monkeypatch.setattr(mx, "TASK_NUMBERS", 2000, raising=False)
    df = spark.range(300).select("id", F.pmod("id", F.lit(97)).alias("v"))
    out = mx.one_hot_array(df, "v", "hot")
    rows = out.select("id", "hot", F.spark_partition_id().alias("p")).collect()
    per_task = [sum(len(r["hot"]) for r in rows if r["p"] == p) for p in {r["p"] for r in rows}]
    assert len(rows) == 300 and len(per_task) >= 12 and max(per_task) <= 2 * 2000
    assert all(sum(r["hot"]) == 1.0 and r["hot"][r["id"] % 97] == 1.0 and len(r["hot"]) == 97 for r in rows)


def test_bucket_features_read_the_lists_as_they_are(spark):
    """No list of the written orders is built anew for a sensor: the aggregate over the rows makes no structs of items, and the pivots
    read the written totals of their groups instead of the lists a second time."""
    from daygrain.plans import features as ft
    plan = ft.bucket_feature_table(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(" not in plan
    lists_read = [c for c in re.findall(r"Relation \[([^\]]*)\] parquet", plan) if "items#" in c]
    assert len(lists_read) == 3  # spine, row statistics, distinct values


def test_change_count_keeps_numbers_alone(spark):
    """The chunks' first and last values are plain numbers in a hash aggregate, not (order, value) structs that need a sort."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, SF_SMALL))
    plan = _plan(daily.daily_changes(v1, ["value", "k"], "v"))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_cells_are_taken_from_one_array_a_row(spark):
    """The cells' plan has no projection for each column, and no name, null or type is lost."""
    from daygrain.plans.q_cells import cells
    df = spark.createDataFrame([(1, 2.5, None, 7, "x"), (2, None, None, None, "y"), (3, float("nan"), -1.0, 0, None)], "k int, `a.b` double, c double, d int, s string")
    out = cells(df, ["k"])
    assert "Expand" not in _plan(out) and out.dtypes == [("k", "int"), ("feature", "string"), ("feature_value", "double")]
    assert sorted((r["k"], r["feature"], str(r["feature_value"])) for r in out.collect()) == [
        (1, "a.b", "2.5"), (1, "d", "7.0"), (3, "a.b", "nan"), (3, "c", "-1.0"), (3, "d", "0.0")]
