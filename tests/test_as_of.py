"""Priors as of a position: nothing from the same or a later position reaches them."""

import random

import pytest
from pyspark.sql import functions as F

from daygrain.operators import folds as fo, prior as pr, ranges as rg

SCHEMA = "key int, subject_id string, ord long, target string, y int, split string"


def _labels(n=400, seed=6):
    rnd = random.Random(seed)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None]), rnd.randint(0, 60), "t", rnd.randint(0, 1), "train") for i in range(n)]
    return rows + [(9000, "a", 5, "t", None, "predict")]


@pytest.mark.parametrize("gap,ranges", [(0, 1), (0, 9), (4, 9), (100, 3)])
def test_prior_as_of_equals_brute_force(spark, gap, ranges):
    rows = _labels()
    settings = pr.prior_settings(spark, ["t"], recent_days=7, default_recent_weight=0.4)
    got = {r["key"]: r for r in pr.prior_as_of(spark.createDataFrame(rows, SCHEMA).repartition(5), settings, gap, ranges=ranges).collect()}
    train = [r for r in rows if r[5] == "train"]
    assert got.keys() == {r[0] for r in train}
    for key, subject, at, *_ in train:
        before = sorted((r[2], r[0], r[4]) for r in train if r[2] < at - gap)
        own = sorted((r[2], r[0], r[4]) for r in train if r[2] < at - gap and r[1] == subject)
        mu = sum(b[2] for b in before) / len(before) if before else 0.5
        tail = own[-7:]
        s = (sum(o[2] for o in own) + 8 * mu) / (len(own) + 8) if own else mu
        r = (sum(o[2] for o in tail) + 4 * mu) / (len(tail) + 4) if tail else s
        assert (got[key]["hist_n"], got[key]["rec_n"]) == (len(own), len(tail))
        assert got[key]["prior"] == pytest.approx(min(max(0.6 * s + 0.4 * r, 1e-5), 1 - 1e-5), abs=1e-12)


def test_no_later_label_reaches_a_prior(spark):
    rows = _labels(200)
    settings = pr.prior_settings(spark, ["t"])
    turned = [(k, s, o, t, (1 - y if o >= 30 and y is not None else y), p) for k, s, o, t, y, p in rows]
    a, b = ({r["key"]: r["prior"] for r in pr.prior_as_of(spark.createDataFrame(x, SCHEMA), settings, gap=2).collect()} for x in (rows, turned))
    for key, _, at, _, y, _ in rows:
        if y is not None and at <= 32:
            assert a[key] == b[key]
    assert any(a[k] != b[k] for k in a)


def test_ordered_folds_and_their_history(spark):
    labels = spark.createDataFrame([r for r in _labels(103) if r[5] == "train"], SCHEMA)
    folds = fo.ordered_folds(labels, 4, ranges=5).toPandas().sort_values(["ord", "key"])
    assert folds["fold"].is_monotonic_increasing and folds.groupby("fold").size().between(25, 26).all()
    history = fo.fold_history(spark.createDataFrame(folds), gap=3).toPandas()
    first = folds.groupby("fold")["ord"].min()
    assert (history["ord"] < history["vf"].map(first) - 3).all()
    assert len(history) == sum((folds["ord"] < first[v] - 3).sum() for v in first.index)


def test_running_sums_of_hot_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"), "id", (F.col("id") % 4).alias("v"))
    got = rg.running_sums(df, ["g"], ["id"], ["v"], 11).toPandas().sort_values("id")
    assert (got["v_upto"] == got.groupby("g")["v"].cumsum()).all() and len(got) == 3000
