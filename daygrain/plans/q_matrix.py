"""Registered queries for the model matrix steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.functions.exprs import finite, safe_token_col
from daygrain.operators import matrix as mx, spine as sp
from daygrain.plans import views_sql as S
from daygrain.plans.q_spine import _daily_sql, _daily_tables, _COUNT_COLS, SPINE_KEYS
from daygrain.plans.registry import register
from daygrain.session import materialize
from daygrain.sources import views
from daygrain.sources.tables import read_table

FEATS = [f"{p}_value_{s}" for p in ("v1", "v1err") for s in ("count", "mean", "std", "min", "max", "median", "sum")]

_TOKEN_SQL = """WITH vals AS (
  SELECT DISTINCT v FROM (SELECT p_type AS v FROM part UNION ALL SELECT p_brand FROM part
                          UNION ALL SELECT event_type FROM events)),
t0 AS (SELECT v, substr(md5(v), 1, 8) AS d,
              lower(regexp_replace(regexp_replace(v, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS t FROM vals),
t1 AS (SELECT v, d, CASE WHEN t = '' THEN 'x_' || d ELSE t END AS t FROM t0),
t2 AS (SELECT v, d, CASE WHEN regexp_matches(substr(t, 1, 1), '^[0-9]$') THEN 'f_' || t ELSE t END AS t FROM t1)
SELECT v AS value, regexp_replace(substr(t, 1, 24), '^_+|_+$', '', 'g') || '_' || d AS token FROM t2"""


@register("safe_token", _TOKEN_SQL)
def safe_token(spark, sf_dir):
    """Column-name token (alnum runs, lower case, f_ prefix, cut at 24, md5 suffix) of category values."""
    part = read_table(spark, sf_dir, "part", ["p_type", "p_brand"])
    ev = read_table(spark, sf_dir, "events", ["event_type"])
    vals = (part.select(F.col("p_type").alias("value"))
                .unionByName(part.select(F.col("p_brand").alias("value")))
                .unionByName(ev.select(F.col("event_type").alias("value"))).distinct())
    return vals.select("value", safe_token_col("value", 24).alias("token"))


@register("null_nonfinite", S.rounded(S.with_views(S.V1, """SELECT row_id,
  CASE WHEN isnan(ln_v) OR isinf(ln_v) THEN NULL ELSE ln_v END AS ln_value
FROM (SELECT row_id, CASE WHEN value > 0 THEN ln(value) WHEN value = 0 THEN -'inf'::DOUBLE END AS ln_v
      FROM sensor_scalar)"""), ["row_id"]))
def null_nonfinite(spark, sf_dir):
    """Log of each reading with -Inf (zero readings) and NaN turned into null."""
    v1 = views.sensor_scalar(spark, sf_dir)
    return v1.select("row_id", finite(F.ln(F.col("value"))).alias("ln_value"))


@register("one_hot", S.with_views(S.V6, """SELECT subject_id, lifelog_date,
  list_transform((SELECT list(DISTINCT subject_id ORDER BY subject_id) FROM spine),
                 lambda v: CASE WHEN subject_id = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS subject_one_hot
FROM spine"""))
def one_hot(spark, sf_dir):
    """Dense one-hot vector of the subject over the sorted subject vocabulary."""
    s = views.spine(spark, sf_dir).select("subject_id", "lifelog_date")
    return mx.one_hot_array(s, "subject_id", "subject_one_hot")


@register("all_missing_counts", S.with_views(_daily_sql(), f"""SELECT feature, CAST(n AS BIGINT) AS n_non_null,
  n_rows, n = 0 AS all_missing
FROM (SELECT count(*) AS n_rows, {', '.join(f'count({c}) AS {c}' for c in FEATS)} FROM joined WHERE split = 'train')
UNPIVOT (n FOR feature IN ({', '.join(FEATS)}))"""))
def all_missing_counts(spark, sf_dir):
    """Non-null count of every feature over the training rows (0 marks a column to drop)."""
    feats = sp.join_daily(*_daily_tables(spark, sf_dir))
    return mx.non_null_counts(feats.where(F.col("split") == "train"), FEATS)


def _impute_sql() -> str:
    med = ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}__med" for c in FEATS)
    imp = ", ".join(f"coalesce(CAST(j.{c} AS DOUBLE), m.{c}__med) AS {c}" for c in FEATS)
    mom = ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in FEATS)
    out = ", ".join(f"(i.{c} - s.{c}__mean) / CASE WHEN s.{c}__std = 0 OR s.{c}__std IS NULL THEN 1.0::DOUBLE "
                    f"ELSE s.{c}__std END AS {c}" for c in FEATS)
    return S.rounded(S.with_views(_daily_sql() + f""",
med AS (SELECT {med} FROM joined WHERE split = 'train'),
imp AS (SELECT j.subject_id, j.lifelog_date, j.split, {imp} FROM joined j CROSS JOIN med m),
mom AS (SELECT {mom} FROM imp WHERE split = 'train')""", f"""SELECT i.subject_id, i.lifelog_date, {out}
FROM imp i CROSS JOIN mom s"""), ["subject_id", "lifelog_date"])


@register("median_impute", _impute_sql())
def median_impute(spark, sf_dir):
    """Exact training medians fill the gaps, then standardisation with training mean / population std."""
    feats = materialize(sp.join_daily(*_daily_tables(spark, sf_dir)), as_table=True)  # read once for medians, moments and scaling
    params = mx.fit_median_scaler(feats.where(F.col("split") == "train"), FEATS)
    return mx.apply_median_scaler(feats, params, FEATS).select("subject_id", "lifelog_date", *FEATS)
