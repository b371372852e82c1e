"""One group holding a third or more of all rows: equal results, and tasks bounded by rows, not by the group."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daygrain.constants import SEED
from daygrain.operators import daily, folds as fo, medians, ranges as rg, relative, sparse
from daygrain.plans import features as ft
from daygrain.sources import views


# -- medians
@pytest.mark.parametrize("n", [1, 2, 7, 8, 3999, 4000, 4001, 4002, 9001])
def test_group_medians_around_the_sketch_bound(spark, n):
    rng = np.random.default_rng(n)
    x = np.r_[rng.normal(size=n - n // 3), np.full(n // 3, 0.5)]
    pdf = pd.DataFrame({"g": 1, "v": x})
    df = spark.createDataFrame(pdf).repartition(5)
    got = daily.daily_stats_table(df, [("v", "s", None)], ["g"]).first()
    assert got["s_v_count"] == n and got["s_v_median"] == pytest.approx(np.median(x), abs=1e-12)


def test_medians_of_hot_days_and_two_sensors(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    day = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 60, n))  # a third of all readings on one day
    v = np.where(rng.random(n) < 0.1, np.nan, np.where(day == 0, rng.lognormal(0, 3, n), rng.integers(0, 4, n)))
    pdf = pd.DataFrame({"g": day, "v": v, "error": rng.random(n) < 0.4})
    pdf.loc[pdf["g"] == 5, "error"] = False
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6)
    got = daily.daily_stats_table(df, [("v", "a", None), ("v", "e", F.col("error"))], ["g"]).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        for p, own in (("a", rows["v"]), ("e", rows[rows["error"]]["v"])):
            if p == "e" and g == 5:
                assert got.loc[g][[c for c in got.columns if c.startswith("e_")]].isna().all()
                continue
            assert got.loc[g, f"{p}_v_count"] == own.count() and got.loc[g, f"{p}_v_median"] == pytest.approx(own.median(), rel=1e-12)
            assert got.loc[g, f"{p}_v_sum"] == pytest.approx(own.sum()) and got.loc[g, f"{p}_v_std"] == pytest.approx(own.std())


def test_hot_medians_rank_few_rows(spark):
    """What is ranked of a hot group is a small part of it, in windows of a part of its interval."""
    n = 50_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    df = spark.createDataFrame(df.toPandas())
    near = df.groupBy("g").agg(medians.sketch(F.col("v")).alias("q")).select("g", F.col("q")[0].alias("lo"), F.col("q")[3].alias("hi"))
    inside = df.join(near, "g").where("v between lo and hi").count()
    assert inside < n * 0.005
    got = medians.large_medians(df, near, ["g"]).first()["median"]
    assert got == pytest.approx(df.toPandas()["v"].median(), abs=1e-15)
    odd = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 2.0), (2, float("nan")), (2, 1.0), (2, 3.0)], "g int, v double")
    ends = odd.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert {r["g"]: r["median"] for r in medians.large_medians(odd, ends, ["g"]).collect()} == {1: 2.0, 2: 3.0}


# -- order over ranges
def _series(n=3000, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        subject = "hot" if i % 3 else rnd.choice(["a", "b", "c", None])
        rows.append((subject, dt.datetime(2024, 3, 1) + dt.timedelta(seconds=rnd.randint(0, 5000)), i, rnd.choice([None, 0.0, 1.0, 2.0])))
    return rows


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_changes_in_ranges_equal_brute_force(spark, ranges):
    rows = _series()
    df = spark.createDataFrame(rows, "subject_id string, timestamp timestamp_ntz, row_id int, value double").repartition(5)
    got = {r["subject_id"]: r["s_value_changes"] for r in daily.changes_in_ranges(df, ["value"], "s", ["subject_id"], ranges=ranges).collect()}
    pdf = pd.DataFrame(rows, columns=["s", "t", "i", "v"]).sort_values(["t", "i"])
    pdf["s"] = pdf["s"].fillna("none")
    wanted = {k: int(g["v"].ne(g["v"].shift()).sum()) for k, g in pdf.groupby("s")}
    assert {k or "none": v for k, v in got.items()} == wanted


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_relative_in_ranges_equals_windows_over_whole_subjects(spark, ranges):
    rows = [(s, i, v, float(i % 7)) for s, _, i, v in _series(900, 5)]
    df = spark.createDataFrame(rows, "subject_id string, ord long, v double, w double").repartition(4)
    got = relative.relative_in_ranges(df, "subject_id", "ord", ranges=ranges)
    whole = relative.add_subject_relative_features(df.withColumn("life_key", F.lit(1)).drop("life_key"), "subject_id", "ord")
    whole = whole.drop(*[c for c in whole.columns if c.startswith("ord_")])
    key = lambda d: sorted((r.asDict() for r in d.collect()), key=lambda r: r["ord"])
    a, b = key(got), key(whole)
    assert len(a) == len(b) == 900
    for x, y in zip(a, b):
        assert x.keys() == y.keys()
        assert all(x[c] == pytest.approx(y[c], nan_ok=True) if isinstance(x[c], float) else x[c] == y[c] for c in x), (x, y)


def test_ranges_bound_the_largest_task(spark):
    df = spark.range(8000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("g"), "id")
    table = rg.in_ranges(df, ["g"], ["id"], 16)
    sizes = [r["n"] for r in rg.with_borders(table, ["g"], ["id"], 6).groupBy(rg.RANGE, "g").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1500 and sum(sizes) <= 8000 + 16 * 6  # the hot group alone has 5333 rows
    assert rg.offsets(table, ["g"]).count() <= 32


def test_global_rank(spark):
    values = [None, "b", "a", "é", "zz", "z"] + [f"v{i}" for i in range(500)]
    got = rg.global_rank(spark.createDataFrame([(v,) for v in values], "v string").repartition(6), ["v"], ranges=9).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["idx"])] == sorted(values, key=lambda v: (v is not None, (v or "").encode()))
    assert rg.global_rank(spark.createDataFrame([], "v string"), ["v"]).count() == 0


# -- sparse rows
def test_sparse_rows_have_no_limit_and_hold_non_zeros_alone(spark):
    n = 12_000  # beyond the limits of the wide forms
    df = spark.range(n).select((F.col("id") % 5).alias("subject_id"), F.lit(dt.date(2024, 1, 1)).alias("lifelog_date"),
                               F.when(F.col("id") != 7, F.concat(F.lit("c"), F.col("id"))).alias("category"))
    rows = sparse.one_hot_sparse(df, "category", "row").collect()
    assert {r["row"]["size"] for r in rows} == {n - 1}
    assert sum(len(r["row"]["indices"]) for r in rows) == n - 1 and len({tuple(r["row"]["indices"]) for r in rows}) == n
    days = sparse.category_sparse(df, "category").collect()
    assert len(days) == 5 and sum(len(r["indices"]) for r in days) == n - 1
    assert all(list(r["indices"]) == sorted(r["indices"]) and sum(r["counts"]) == len(r["indices"]) for r in days)
    with pytest.raises(ValueError, match="category_sparse"):
        daily.category_vocabulary(df, "category")


def test_sparse_equals_dense(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "id int, v string")
    rows = sparse.one_hot_sparse(df, "v", "row").withColumn("d", sparse.dense(F.col("row"), 3))
    assert {r["id"]: r["d"] for r in rows.collect()} == {1: [0, 1, 0], 2: [1, 0, 0], 3: [0, 0, 0], 4: [0, 0, 1], 5: [1, 0, 0]}
    of = sparse.vocabulary_index(df.where("v != 'c'"), "v")
    assert {r["id"]: list(r["row"]["indices"]) for r in sparse.one_hot_sparse(df, "v", "row", of).collect()} == {1: [1], 2: [0], 3: [], 4: [], 5: [0]}


# -- the chain that feeds the fits
def test_document_features_follow_their_rows(spark):
    """Each key has the features of its own document; given another document's, a fit loses."""
    from conftest import SF_MID
    from daygrain.operators import train
    feats = ft.cached_document_features(spark, SF_MID)
    own = feats.toPandas().set_index("key")
    docs = views.document_readings(spark, SF_MID).toPandas().sort_values("key")
    name = {c.rsplit("_", 1)[0]: c for c in own.columns}
    assert (own.loc[docs["key"], name["n_chars"]].to_numpy() == docs["n_chars"].to_numpy()).all()
    rolled = docs.groupby("source")["n_lines"].transform(lambda g: g.rolling(7, min_periods=1).mean())
    assert np.allclose(own.loc[docs["key"], name["n_lines_roll7_mean"]].to_numpy(), rolled.to_numpy())
    assert not any(np.isinf(own[c]).any() for c in own.columns) and len(own.columns) > 28

    lab = views.labelled(spark, SF_MID).where("target = 'quality'").select("key", "subject_id", "ord", "target", "y", "split")
    folds = fo.stratified_folds(lab, 3, SEED)
    moved = feats.withColumn("key", F.pmod(F.col("key") + 499, F.lit(1000)))
    loss = []
    for matrix in (feats, moved):
        got = train.fit_all(train.model_input(matrix, lab, folds), ["xgboost"], refit=False, profile_overrides={"xgboost": {"trees": 60, "step": 0.1}})
        oof = got["oof"].join(lab.select("key", "y"), "key").toPandas()
        loss.append(float(-(oof["y"] * np.log(oof["pred"]) + (1 - oof["y"]) * np.log(1 - oof["pred"])).mean()))
    assert loss[0] < loss[1] - 0.02, loss
