"""Handwritten edge rows (FIXTURES.md section 6)."""

import math
import random
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from daygrain.functions import exprs, lists
from daygrain.operators import daily, folds as fo, matrix as mx, nested, prior as pr, train


def test_list_stats_null_empty_bad_values(spark):
    df = spark.createDataFrame(
        [(1, None), (2, []), (3, [{"rssi": None}, {"rssi": 2.0}, {"rssi": 4.0}]), (4, [{"rssi": None}])],
        "id int, items array<struct<rssi:double>>")
    out = nested.list_row_stats(df, "items", ["rssi"], ["id"], "m").orderBy("id").collect()
    assert [r["m_row_n"] for r in out] == [0.0, 0.0, 3.0, 1.0]
    r3 = out[2]
    assert r3["m_row_rssi_mean"] == 3.0 and r3["m_row_rssi_std"] == 1.0   # population std
    assert r3["m_row_rssi_sum"] == 6.0 and r3["m_row_rssi_min"] == 2.0
    assert out[3]["m_row_rssi_mean"] is None and out[0]["m_row_rssi_sum"] is None


def test_unparseable_numbers_and_pairs(spark):
    df = spark.createDataFrame([(1, ["70", "x", None, "80"]), (2, None)], "id int, hr array<string>")
    out = nested.array_row_stats(df, "hr", ["id"]).orderBy("id").collect()
    assert out[0]["hr_n"] == 2.0 and out[0]["hr_median"] == 75.0
    assert out[1]["hr_n"] == 0.0 and out[1]["hr_sum"] == 0.0 and out[1]["hr_mean"] is None
    pairs = spark.createDataFrame([([["a", "0.2"], ["b", "oops"], ["c"]],)], "p array<array<string>>")
    st = nested.label_row_stats(pairs.select(lists.pairs_to_label_struct("p").alias("s")), "s", []).first()
    assert st["ambience_n"] == 2.0 and st["ambience_prob_sum"] == 0.2 and st["ambience_top_label"] == "a"


def test_label_sum_zero_and_empty(spark):
    df = spark.createDataFrame([(1, [("x", 0.0), ("y", 0.0)]), (2, [])],
                               "id int, items array<struct<label:string, prob:double>>")
    out = nested.label_row_stats(df, "items", ["id"]).orderBy("id").collect()
    assert out[0]["ambience_entropy"] is None and out[0]["ambience_top_label"] == "x"
    assert out[1]["ambience_top_label"] == "missing" and out[1]["ambience_top_prob"] is None


def test_usage_null_app_and_time(spark):
    df = spark.createDataFrame([(1, [("a", 2.0), (None, 3.0), ("a", None)])],
                               "id int, items array<struct<app_name:string, total_time:double>>")
    r = nested.usage_row_stats(df, "items", ["id"]).first()
    assert r["usage_events"] == 3.0 and r["usage_total_time"] == 5.0
    assert r["usage_max_time"] == 3.0 and r["usage_unique_apps"] == 1.0


def _ts(h, m=0, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


def test_daily_stats_one_row_day_and_empty_bin(spark):
    df = spark.createDataFrame([(1, _ts(1), 1, 5.0), (2, _ts(13), 2, None), (2, _ts(14), 3, None)],
                               "subject_id int, timestamp timestamp_ntz, row_id int, value double")
    out = daily.daily_numeric_features(df, ["value"], "s").orderBy("subject_id").collect()
    assert out[0]["s_value_std"] is None and out[0]["s_value_count"] == 1
    assert out[1]["s_value_sum"] == 0.0 and out[1]["s_value_mean"] is None
    assert out[1]["s_value_by_time_sum_afternoon"] == 0.0 and out[1]["s_value_by_time_mean_afternoon"] is None
    assert out[1]["s_value_by_time_sum_night"] is None


def _changes_brute(pdf):
    pdf = pdf.sort_values(["subject_id", "day", "timestamp", "row_id"])
    res = {}
    for k, g in pdf.groupby(["subject_id", "day"]):
        res[k] = int(g["value"].ne(g["value"].shift()).sum())
    return res


def test_changes_match_brute_force_across_chunks_and_ties(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        sid = rnd.randint(1, 3)
        ts = dt.datetime(2024, 1, 1 + rnd.randint(0, 1), rnd.randint(0, 23), rnd.choice([0, 59]), rnd.randint(0, 1))
        v = rnd.choice([0.0, 1.0, None])
        rows.append((sid, ts, i, v))
    df = spark.createDataFrame(rows, "subject_id int, timestamp timestamp_ntz, row_id int, value double")
    got = {(r["subject_id"], r["lifelog_date"]): r["s_value_changes"]
           for r in daily.daily_changes(daily.with_date_keys(df), ["value"], "s").collect()}
    pdf = pd.DataFrame(rows, columns=["subject_id", "timestamp", "row_id", "value"])
    pdf["day"] = pdf["timestamp"].dt.date
    assert got == _changes_brute(pdf)


def test_nonfinite_and_subject_without_digits(spark):
    df = spark.createDataFrame([(float("nan"), "abc"), (float("inf"), "id_042"), (1.5, "x7y8")], "v double, s string")
    out = df.select(exprs.finite("v").alias("v"), exprs.first_number("s").alias("n")).collect()
    assert [r["v"] for r in out] == [None, None, 1.5]
    assert [r["n"] for r in out] == [None, 42.0, 7.0]


def test_all_missing_column_dropped(spark):
    tr = spark.createDataFrame([(1, None, 1.0)], "k int, a double, b double")
    te = spark.createDataFrame([(2, 3.0, 1.0)], "k int, a double, b double")
    (tr2, te2), gone = mx.drop_all_missing(tr, [te], ["a", "b"])
    assert gone == ["a"] and te2.columns == ["k", "b"]


def test_unseen_subject_gets_global_mean(spark):
    lab = spark.createDataFrame(
        [(1, "s1", 1, "t", 1, "train"), (2, "s1", 2, "t", 0, "train"), (3, "s2", 3, "t", 1, "train"),
         (4, "zz", 4, "t", None, "predict")],
        "key int, subject_id string, ord int, target string, y int, split string")
    out = pr.prior_predict(lab, pr.prior_settings(spark, ["t"])).first()
    assert abs(out["prior"] - 2.0 / 3.0) < 1e-12
    look = pr.prior_lookup(lab.where("split = 'predict'").select("target", "key", "subject_id"),
                           pr.subject_prior(lab)).first()
    assert abs(look["prior"] - 2.0 / 3.0) < 1e-12


def test_single_class_fold_gives_constant(spark):
    tr = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, a double")
    va = spark.createDataFrame([(5, 3.0)], "key int, a double")
    pred, model = train.fit_predict("logistic", tr, va, ["a"], 1, train.profile("logistic"), ["key"])
    assert model is None and abs(pred.first()["pred"] - (1 - 1e-5)) < 1e-12


def test_two_class_fit_runs(spark):
    tr = spark.createDataFrame([(float(i % 2), float(i), None if i == 3 else float(i % 3)) for i in range(40)],
                               "label double, a double, b double")
    va = spark.createDataFrame([(1, 5.0, 1.0), (2, 30.0, None)], "key int, a double, b double")
    for m in ["lightgbm", "extra_trees", "logistic"]:
        pred, model = train.fit_predict(m, tr, va, ["a", "b"], 3,
                                        train.profile(m, overrides={"trees": 20}), ["key"])
        vals = [r["pred"] for r in pred.collect()]
        assert len(vals) == 2 and all(1e-5 <= v <= 1 - 1e-5 for v in vals)


def test_non_finite_numbers_inside_lists_are_missing(spark):
    from daygrain.functions import lists
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([(1.0, "a", 1.0), (nan, "b", nan), (inf, "c", 3.0)],)],
                               "items array<struct<p: double, label: string, total_time: double>>")
    row = lists.add_list_key_stats(df, "items", ["p"], "v")[0].first()
    assert (row["v_row_p_mean"], row["v_row_p_sum"], row["v_row_p_max"]) == (1.0, 1.0, 1.0)
    use = lists.add_usage_stats(df, "items", "label", "total_time")[0].first()
    assert (use["usage_total_time"], use["usage_max_time"]) == (4.0, 3.0)
    amb = lists.add_label_distribution_stats(df, "items", "label", "p")[0].first()
    assert (amb["ambience_prob_sum"], amb["ambience_top_prob"], amb["ambience_top_label"]) == (1.0, 1.0, "a")


def test_blend_keeps_all_models_when_none_is_near(spark):
    from daygrain.operators.ensemble import blend_weights
    scores = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.5)], "target string, model string, score double")
    assert [r["weight"] for r in blend_weights(scores, ratio=0.5).collect()] == [0.5, 0.5]


def test_output_rounding_equals_decimal_rounding_and_is_quick(spark):
    """Ties, signed zeros, subnormals, huge and non-finite values round as their decimal forms do, and few values need that form."""
    rnd = random.Random(8)
    odd = [0.0, -0.0, 5e-324, -1e-300, 4.999999999e-7, 5e-7, -5e-7, 0.0555625, -0.0555625, 1e15, 2.0 ** 53, -1e300, 1.7e308, math.inf, -math.inf, math.nan, None]
    ties = [(rnd.randint(-10 ** 9, 10 ** 9) + 0.5) / 10 ** 6 for _ in range(4000)]
    near = [math.nextafter(t, d) for t in ties[:2000] for d in (-math.inf, math.inf)] + [t / exprs.TIE_NUDGE for t in ties]
    plain = [rnd.choice((1, -1)) * 10 ** rnd.uniform(-9, 17) for _ in range(20000)] + [rnd.randint(-10 ** 6, 10 ** 6) / 100 for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in odd + ties + near + plain], "v double")
    decimal = F.round(F.col("v") * exprs.dlit(exprs.TIE_NUDGE), 6)
    pairs = df.select("v", exprs.round_value("v").alias("got"), F.when(decimal == 0, exprs.dlit(0.0)).otherwise(decimal).alias("want")).collect()
    form = lambda x: None if x is None else x.hex()  # noqa: E731  tells -0.0 from 0.0
    assert [r for r in pairs if form(r["got"]) != form(r["want"])] == []
    # the decimal form is written once in the expression, and only where a value may be a tie
    text = exprs.round_value("v")._jc.toString()
    assert text.count("round(") == 1 and "CASE WHEN" in text and text.index("round(") > text.index("ELSE")


def test_list_fields_of_other_types_null_lists_and_null_items(spark):
    """Fields are taken from whole lists: texts that are no numbers, null items and null lists count as before."""
    df = spark.createDataFrame([(1, [("a", "2.5"), None, ("a", "x"), (None, "NaN"), ("b", "Infinity")]), (2, None), (3, [])],
                               "id int, items array<struct<app_name:string, total_time:string>>")
    rows = {r["id"]: r for r in nested.usage_row_stats(df, "items", ["id"]).collect()}
    assert rows[1]["usage_events"] == 5.0 and rows[1]["usage_total_time"] == 2.5 and rows[1]["usage_unique_apps"] == 2.0
    assert all(rows[i][c] == 0.0 for i in (2, 3) for c in ("usage_events", "usage_total_time", "usage_max_time", "usage_unique_apps"))
    stats = {r["id"]: r for r in nested.list_row_stats(df, "items", ["total_time"], ["id"], "m").collect()}
    assert stats[1]["m_row_total_time_sum"] == 2.5 and stats[1]["m_row_n"] == 5.0 and stats[2]["m_row_total_time_sum"] is None
    assert [tuple(r) for r in nested.top_app_pivot(df, "items", ["id"], 2).collect()] == [(1, 2.5, math.inf)]
    distinct = {r["id"]: r["m_app_name_nunique"] for r in nested.daily_nested_distinct(df, "items", "app_name", ["id"], "m").collect()}
    assert distinct == {1: 2, 2: 0, 3: 0}
