"""Properties of folds, weights, calibration, daily counts and key joins on the driver tables."""

from pyspark.sql import Window, functions as F

from conftest import SF_SMALL, SF_MID
from daygrain.functions.ranks import bucketed_row_number
from daygrain.operators import daily, ensemble as ens, folds as fo, spine as sp
from daygrain.plans import q_model
from daygrain.sources import views


def test_folds_partition_and_balance(spark):
    lab = views.labelled(spark, SF_MID)
    f = fo.stratified_folds(lab)
    n_lab = lab.where("y is not null").count()
    assert f.count() == n_lab and f.select("target", "key").distinct().count() == n_lab
    sizes = f.groupBy("target", "fold").count().groupBy("target").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)
    per_class = f.groupBy("target", "y", "fold").count().groupBy("target", "y").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per_class)


def test_bucketed_row_number_equals_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"),
                                  F.col("id"))
    got = bucketed_row_number(df, ["g"], [F.col("h"), F.col("id")], F.substring("h", 1, 2), "rn")
    exp = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    bad = got.join(exp, ["g", "id"]).where(F.col("rn") != F.col("rn2")).count()
    assert bad == 0


def test_weights_sum_to_one_and_calibration_not_worse(spark):
    t = q_model._tuned(spark, SF_SMALL)
    sums = t["weights"].groupBy("target").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    cal = t["calibration"]
    none = {r["target"]: r["loss"] for r in cal.where("method = 'none'").collect()}
    chosen = {r["target"]: r["loss"] for r in cal.where("chosen").collect()}
    assert all(chosen[k] <= none[k] + 1e-15 for k in none)


def test_daily_counts_sum_to_rows(spark):
    v1 = daily.with_date_keys(views.sensor_scalar(spark, SF_SMALL))
    d = v1.groupBy("subject_id", "lifelog_date").agg(*daily.daily_stat_exprs("value", "v"))
    assert d.agg(F.sum("v_value_count")).first()[0] == v1.where("value is not null").count()


def test_split_rejoin_each_key_once_whatever_the_order(spark):
    s = views.spine(spark, SF_SMALL)
    feats = s.select("subject_id", "lifelog_date", F.rand(3).alias("x")).orderBy(F.rand(5))
    out = sp.split_rejoin(feats, s, ["subject_id", "lifelog_date"])
    n_train = s.where("split = 'train'").count()
    assert out.count() == n_train == out.select("subject_id", "lifelog_date").distinct().count()
