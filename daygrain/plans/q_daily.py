"""Registered queries for scans, scalar expressions and daily roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.operators import daily
from daygrain.plans import views_sql as S
from daygrain.plans.registry import register
from daygrain.sources import views

KEYS = ["subject_id", "lifelog_date"]
V1_VALUES = ["value", "k"]


def _v1_sql_days() -> str:
    return S.V1 + """,
d AS (SELECT *, CAST("timestamp" AS DATE) AS lifelog_date, hour("timestamp") AS hr,
             CASE WHEN hour("timestamp") <= 5 THEN 'night' WHEN hour("timestamp") <= 11 THEN 'morning'
                  WHEN hour("timestamp") <= 17 THEN 'afternoon' WHEN hour("timestamp") <= 23 THEN 'evening'
             END AS time_bin
      FROM sensor_scalar)"""


# --- A2 --------------------------------------------------------------------------
@register("scan_project", S.rounded(S.with_views(S.V1, "SELECT * FROM sensor_scalar"),
                                    ["subject_id", '"timestamp"', "row_id", "k", "category"]))
def scan_project(spark, sf_dir):
    """Parquet scan with column projection and NaN/Inf normalisation (V1)."""
    return views.sensor_scalar(spark, sf_dir)


# --- B1 / B2 -----------------------------------------------------------------------
@register("date_keys", S.with_views(_v1_sql_days(),
                                    "SELECT row_id, subject_id, lifelog_date, CAST(hr AS INTEGER) AS hour FROM d"))
def date_keys(spark, sf_dir):
    """Day key and hour of every reading."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    return v1.select("row_id", "subject_id", "lifelog_date", "hour")


@register("time_bin", S.with_views(_v1_sql_days(), "SELECT row_id, time_bin FROM d"))
def time_bin(spark, sf_dir):
    """Time-of-day bin of every reading."""
    return daily.with_date_keys(views.sensor_scalar(spark, sf_dir)).select("row_id", "time_bin")


# --- D1 ----------------------------------------------------------------------------
def _d1_sql() -> str:
    cols = []
    for v in V1_VALUES:
        x = f"CAST({v} AS DOUBLE)"
        n = f"v1_{v}"
        cols += [f"count({x}) AS {n}_count", f"avg({x}) AS {n}_mean", f"stddev_samp({x}) AS {n}_std",
                 f"min({x}) AS {n}_min", f"max({x}) AS {n}_max", f"median({x}) AS {n}_median",
                 f"coalesce(sum({x}), 0.0) AS {n}_sum"]
    body = f"SELECT subject_id, lifelog_date, {', '.join(cols)} FROM d GROUP BY subject_id, lifelog_date"
    return S.rounded(S.with_views(_v1_sql_days(), body),
                     ["subject_id", "lifelog_date"] + [f"v1_{v}_count" for v in V1_VALUES])


@register("daily_stats", _d1_sql())
def daily_stats(spark, sf_dir):
    """Count, mean, std, min, max, median, sum per (subject, day)."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    return daily.daily_stats_table(v1, [(v, "v1", None) for v in V1_VALUES])


# --- D2 ----------------------------------------------------------------------------
def _d2_sql() -> str:
    cols = []
    for v in V1_VALUES:
        x = f"CAST({v} AS DOUBLE)"
        for b in ["night", "morning", "afternoon", "evening"]:
            cols.append(f"avg(CASE WHEN time_bin = '{b}' THEN {x} END) AS v1_{v}_by_time_mean_{b}")
        for b in ["night", "morning", "afternoon", "evening"]:
            cols.append(f"CASE WHEN count(*) FILTER (WHERE time_bin = '{b}') > 0 "
                        f"THEN coalesce(sum({x}) FILTER (WHERE time_bin = '{b}'), 0.0) END "
                        f"AS v1_{v}_by_time_sum_{b}")
    body = f"SELECT subject_id, lifelog_date, {', '.join(cols)} FROM d GROUP BY subject_id, lifelog_date"
    return S.rounded(S.with_views(_v1_sql_days(), body), ["subject_id", "lifelog_date"])


@register("daily_time_bins", _d2_sql())
def daily_time_bins(spark, sf_dir):
    """Mean and sum per (subject, day, time-of-day bin), as filtered aggregates."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    aggs = [e for v in V1_VALUES for e in daily.time_bin_exprs(v, "v1")]
    return v1.groupBy(*KEYS).agg(*aggs)


# --- D3 ----------------------------------------------------------------------------
def _d3_sql() -> str:
    flags = ", ".join(
        f"CASE WHEN lag(CAST({v} AS DOUBLE)) OVER w IS NULL OR {v} IS NULL "
        f"OR CAST({v} AS DOUBLE) <> lag(CAST({v} AS DOUBLE)) OVER w THEN 1 ELSE 0 END AS c_{v}"
        for v in V1_VALUES)
    sums = ", ".join(f"CAST(sum(c_{v}) AS BIGINT) AS v1_{v}_changes" for v in V1_VALUES)
    body = f"""SELECT subject_id, lifelog_date, {sums}
FROM (SELECT subject_id, lifelog_date, {flags} FROM d
      WINDOW w AS (PARTITION BY subject_id, lifelog_date ORDER BY "timestamp", row_id)) t
GROUP BY subject_id, lifelog_date"""
    return S.with_views(_v1_sql_days(), body)


@register("daily_changes", _d3_sql())
def daily_changes(spark, sf_dir):
    """D3: value changes inside each day in timestamp order (chunked, skew-safe)."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    return daily.daily_changes(v1, V1_VALUES, "v1")


@register("changes_in_ranges", S.with_views(_v1_sql_days(), """SELECT subject_id, CAST(sum(c) AS BIGINT) AS v1_value_changes
FROM (SELECT subject_id, CASE WHEN lag(value) OVER w IS NULL OR value IS NULL OR value <> lag(value) OVER w THEN 1 ELSE 0 END AS c
      FROM sensor_scalar WINDOW w AS (PARTITION BY subject_id ORDER BY "timestamp", row_id)) t
GROUP BY subject_id"""))
def changes_in_ranges(spark, sf_dir):
    """D3 over a subject's whole series: ranges of (subject, time) that hand on their last reading."""
    v1 = views.sensor_scalar(spark, sf_dir).select("subject_id", "timestamp", "row_id", "value")
    return daily.changes_in_ranges(v1, ["value"], "v1", ["subject_id"])


# --- D4 ----------------------------------------------------------------------------
_D4_SQL = S.rounded(S.with_views(_v1_sql_days(), """SELECT subject_id, lifelog_date, category, n,
       CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY subject_id, lifelog_date) AS ratio
FROM (SELECT subject_id, lifelog_date, category, count(*) AS n FROM d
      WHERE category IS NOT NULL GROUP BY ALL) t"""), ["subject_id", "lifelog_date", "category", "n"])


@register("daily_category_ratio", _D4_SQL)
def daily_category_ratio(spark, sf_dir):
    """D4 (long form): readings per category and day, and their share of the day."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    return daily.category_long(v1, "category")
