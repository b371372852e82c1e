"""A hot key holding a third of all rows: results stay exact (against pandas brute force)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from daygrain.operators import daily


def _rows(n=3000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:      # the hot subject-day: a third of all readings, spread over 24 hours
            sid, day = 1, 1
        else:
            sid, day = rnd.randint(2, 40), rnd.randint(1, 5)
        ts = dt.datetime(2024, 3, day, rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59))
        v = rnd.choice([None, float(rnd.randint(0, 3))])
        rows.append((sid, ts, i, v))
    return rows


import pytest


@pytest.mark.parametrize("chunk", ["hour", "minute"])
def test_hot_subject_day_exact(spark, chunk):
    rows = _rows()
    df = spark.createDataFrame(rows, "subject_id int, timestamp timestamp_ntz, row_id int, value double")
    got = {(r["subject_id"], r["lifelog_date"]): r for r in
           daily.daily_numeric_features(df, ["value"], "s", add_changes=True, chunk=chunk).collect()}
    pdf = pd.DataFrame(rows, columns=["subject_id", "timestamp", "row_id", "value"])
    pdf["lifelog_date"] = pdf["timestamp"].dt.date
    pdf = pdf.sort_values(["subject_id", "lifelog_date", "timestamp", "row_id"])
    for (sid, day), g in pdf.groupby(["subject_id", "lifelog_date"]):
        r = got[(sid, day)]
        v = g["value"]
        assert r["s_value_count"] == v.count()
        assert r["s_value_sum"] == v.sum()
        assert (r["s_value_median"] is None and pd.isna(v.median())) or r["s_value_median"] == v.median()
        assert r["s_value_changes"] == int(v.ne(v.shift()).sum())
    assert len(pdf[(pdf.subject_id == 1) & (pdf.lifelog_date == dt.date(2024, 3, 1))]) >= 1000   # the hot day


def test_approximate_median_option(spark):
    rows = _rows()
    df = daily.with_date_keys(spark.createDataFrame(rows, "subject_id int, timestamp timestamp_ntz, row_id int, "
                                                          "value double"))
    exact = df.groupBy("subject_id", "lifelog_date").agg(*daily.daily_stat_exprs("value", "e"))
    approx = df.groupBy("subject_id", "lifelog_date").agg(*daily.daily_stat_exprs("value", "a", median="approx"))
    j = exact.join(approx, ["subject_id", "lifelog_date"])
    # the sketch returns a member of the group (the exact median interpolates even-sized groups)
    assert j.where((F.col("a_value_median") < F.col("e_value_min"))
                   | (F.col("a_value_median") > F.col("e_value_max"))).count() == 0
    hot = j.where((F.col("subject_id") == 1) & (F.col("lifelog_date") == dt.date(2024, 3, 1))).first()
    assert abs(hot["a_value_median"] - hot["e_value_median"]) <= 0.5


def test_exact_medians_of_hot_and_odd_columns(spark):
    """Half of a column is one value, others have few, no or even counts of values; the answer is the exact median."""
    import numpy as np
    import pandas as pd
    from daygrain.operators.matrix import exact_medians

    rng = np.random.default_rng(5)
    n = 40_001
    pdf = pd.DataFrame({"hot": np.where(rng.random(n) < 0.499, 0.0, rng.normal(3, 1, n)), "wide": rng.normal(0, 1e6, n),
                        "none": np.nan, "two": np.nan, "one": np.nan, "ties": rng.integers(0, 3, n).astype(float)})
    pdf.loc[:1, "two"] = [1.0, 4.0]
    pdf.loc[5, "one"] = -7.0
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(8)
    got = exact_medians(df, list(pdf.columns)).first()
    for c in pdf.columns:
        want = pdf[c].median()
        assert got[f"{c}__med"] is None if np.isnan(want) else got[f"{c}__med"] == want, c
    none = exact_medians(df.limit(0), ["hot", "none"]).first()
    assert none["hot__med"] is None and none["none__med"] is None
