"""Registered queries for the spine, calendar, joins and window features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from daygrain.operators import daily, relative, spine as sp
from daygrain.plans import views_sql as S
from daygrain.plans.registry import register
from daygrain.sources import views

KEYS = ["subject_id", "lifelog_date"]
SPINE_KEYS = ["subject_id", "sleep_date", "lifelog_date"]
SECOND_SENSOR = "error"     # a sparser sensor: the readings of one event type


def _daily_tables(spark, sf_dir):
    """The spine and the daily tables of two sensors, all from one written aggregate of the readings."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    stats = daily.daily_stats_table(v1, [("value", "v1", None), ("value", "v1err", F.col("category") == SECOND_SENSOR)])
    of = lambda p: stats.select(*KEYS, *[c for c in stats.columns if c.startswith(f"{p}_")])
    return views.spine_from_days(stats.select(*KEYS)), [of("v1"), of("v1err").where("v1err_value_count is not null")]


def _daily_sql() -> str:
    def stats(p):
        return (f"count(value) AS {p}_value_count, avg(value) AS {p}_value_mean, "
                f"stddev_samp(value) AS {p}_value_std, min(value) AS {p}_value_min, max(value) AS {p}_value_max, "
                f"median(value) AS {p}_value_median, coalesce(sum(value), 0.0) AS {p}_value_sum")
    return S.V6 + f""",
dd AS (SELECT *, CAST("timestamp" AS DATE) AS lifelog_date FROM sensor_scalar),
t_all AS (SELECT subject_id, lifelog_date, {stats('v1')} FROM dd GROUP BY ALL),
t_err AS (SELECT subject_id, lifelog_date, {stats('v1err')} FROM dd WHERE category = '{SECOND_SENSOR}' GROUP BY ALL),
joined AS (SELECT s.*, t_all.* EXCLUDE (subject_id, lifelog_date), t_err.* EXCLUDE (subject_id, lifelog_date)
           FROM spine s LEFT JOIN t_all USING (subject_id, lifelog_date)
                        LEFT JOIN t_err USING (subject_id, lifelog_date))"""


_COUNT_COLS = ["v1_value_count", "v1err_value_count"]


# --- F1 -------------------------------------------------------------------------------
@register("spine_union", S.with_views(S.V6, "SELECT subject_id, sleep_date, lifelog_date, split FROM spine"))
def spine_union(spark, sf_dir):
    """train keys then predict keys with a split tag (V6 re-assembled from its two parts)."""
    s = views.spine(spark, sf_dir)
    return sp.spine_union(s.where(F.col("split") == "train"), s.where(F.col("split") == "predict"), SPINE_KEYS)


# --- B6 -------------------------------------------------------------------------------
_CAL_SQL = S.rounded(S.with_views(S.V6, f"""SELECT subject_id, lifelog_date,
  CAST(isodow(lifelog_date) - 1 AS INTEGER) AS life_dayofweek,
  CAST(day(lifelog_date) AS INTEGER) AS life_day,
  CAST(month(lifelog_date) AS INTEGER) AS life_month,
  CAST(dayofyear(lifelog_date) AS INTEGER) AS life_dayofyear,
  CAST(weekofyear(lifelog_date) AS INTEGER) AS life_weekofyear,
  CAST(isodow(sleep_date) - 1 AS INTEGER) AS sleep_dayofweek,
  CASE WHEN isodow(lifelog_date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
  sin({2 * math.pi!r}::DOUBLE * (isodow(lifelog_date) - 1) / 7.0::DOUBLE) AS life_dayofweek_sin,
  cos({2 * math.pi!r}::DOUBLE * (isodow(lifelog_date) - 1) / 7.0::DOUBLE) AS life_dayofweek_cos,
  sin({2 * math.pi!r}::DOUBLE * dayofyear(lifelog_date) / 366.0::DOUBLE) AS life_dayofyear_sin,
  cos({2 * math.pi!r}::DOUBLE * dayofyear(lifelog_date) / 366.0::DOUBLE) AS life_dayofyear_cos,
  CAST(datediff('day', lifelog_date, sleep_date) AS INTEGER) AS sleep_gap_days,
  TRY_CAST(nullif(regexp_extract(CAST(subject_id AS VARCHAR), '(\\d+)', 1), '') AS DOUBLE) AS subject_idx
FROM spine"""), ["subject_id", "lifelog_date", "life_dayofweek", "life_day", "life_month", "life_dayofyear",
                  "life_weekofyear", "sleep_dayofweek", "is_weekend", "sleep_gap_days"])


@register("calendar_features", _CAL_SQL)
def calendar_features(spark, sf_dir):
    """Calendar, cyclical and gap features of every spine row."""
    cal = sp.add_calendar_features(views.spine(spark, sf_dir))
    return cal.drop("sleep_date", "split")


# --- C1 -------------------------------------------------------------------------------
@register("spine_join", S.rounded(S.with_views(_daily_sql(), "SELECT * FROM joined"),
                                  SPINE_KEYS + ["split"] + _COUNT_COLS))
def spine_join(spark, sf_dir):
    """Spine left-joined to two daily tables (all readings; the sparser 'error' readings)."""
    return sp.join_daily(*_daily_tables(spark, sf_dir))


# --- C5 -------------------------------------------------------------------------------
@register("split_rejoin", S.rounded(S.with_views(_daily_sql(), """SELECT j.subject_id, j.lifelog_date,
       j.v1_value_mean, j.v1err_value_count FROM joined j WHERE j.split = 'train'"""),
    ["subject_id", "lifelog_date", "v1err_value_count"]))
def split_rejoin(spark, sf_dir):
    """Train rows of the feature table, matched to the train keys by join."""
    s, tables = _daily_tables(spark, sf_dir)
    feats = sp.join_daily(s.drop("split"), tables)
    return sp.split_rejoin(feats, s, KEYS).select(*KEYS, "v1_value_mean", "v1err_value_count")


# --- E1 -------------------------------------------------------------------------------
@register("days_since_first", S.with_views(S.V6, """SELECT subject_id, lifelog_date,
  CAST(datediff('day', min(lifelog_date) OVER (PARTITION BY subject_id), lifelog_date) AS INTEGER)
    AS subject_days_since_first
FROM spine"""))
def days_since_first(spark, sf_dir):
    """Days since the subject's first spine day."""
    out = relative.add_subject_relative_features(views.spine(spark, sf_dir), relative_limit=0, lag_limit=0)
    return out.select(*KEYS, "subject_days_since_first")


# --- E2-E4 ----------------------------------------------------------------------------
def _relative_sql() -> str:
    base = ["v1_value_count", "v1_value_mean", "v1_value_std", "v1_value_min", "v1_value_max",
            "v1_value_median", "v1_value_sum", "v1err_value_count", "v1err_value_mean", "v1err_value_std",
            "v1err_value_min", "v1err_value_max", "v1err_value_median", "v1err_value_sum"]
    cols = ["CAST(row_number() OVER w - 1 AS INTEGER) AS subject_row_order"]
    for n in (3, 7):
        cols += [f"avg(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) "
                 f"AS {c}_roll{n}_mean" for c in base]
    cols += [f"lag({c}) OVER w AS {c}_lag1" for c in base]
    body = (f"SELECT subject_id, lifelog_date, {', '.join(cols)} FROM joined "
            f"WINDOW w AS (PARTITION BY subject_id ORDER BY lifelog_date)")
    keep = ["subject_id", "lifelog_date", "subject_row_order", "v1_value_count_lag1", "v1err_value_count_lag1"]
    return S.rounded(S.with_views(_daily_sql(), body), keep)


@register("relative_features", _relative_sql())
def relative_features(spark, sf_dir):
    """Row order, rolling 3/7-row means and lag 1 of every sensor column, per subject."""
    feats = sp.join_daily(*_daily_tables(spark, sf_dir))
    out = relative.add_subject_relative_features(feats)
    keep = [c for c in out.columns if c.endswith(("_roll3_mean", "_roll7_mean", "_lag1"))]
    return out.select(*KEYS, "subject_row_order", *keep)


# --- A10 ------------------------------------------------------------------------------
QUICK_TRAIN, QUICK_PREDICT = 120, 80


@register("limit_rows", S.with_views(S.V6, f"""(SELECT subject_id, lifelog_date, split FROM spine WHERE split = 'train'
  ORDER BY subject_id, lifelog_date LIMIT {QUICK_TRAIN})
UNION ALL
(SELECT subject_id, lifelog_date, split FROM spine WHERE split = 'predict'
  ORDER BY subject_id, lifelog_date LIMIT {QUICK_PREDICT})"""))
def limit_rows(spark, sf_dir):
    """A10 quick mode: the first 120 train and 80 predict keys in key order (the cap is the feature)."""
    s = views.spine(spark, sf_dir).select("subject_id", "lifelog_date", "split")
    tr = s.where(F.col("split") == "train").orderBy("subject_id", "lifelog_date").limit(QUICK_TRAIN)
    pr = s.where(F.col("split") == "predict").orderBy("subject_id", "lifelog_date").limit(QUICK_PREDICT)
    return tr.unionByName(pr)


# --- flagship feature tables (rows-only: their column sets follow the data) ---------------------
@register("daily_feature_table")
def daily_feature_table(spark, sf_dir):
    """Full daily feature build: spine, calendar, scalar roll-ups, relative features, B7."""
    from daygrain.plans.features import daily_feature_table as build
    return build(spark, sf_dir)


@register("bucket_feature_table")
def bucket_feature_table(spark, sf_dir):
    """Full list-sensor feature build over (nation, month) buckets."""
    from daygrain.plans.features import bucket_feature_table as build
    return build(spark, sf_dir)
