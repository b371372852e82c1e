"""Registered queries for whole feature tables as (key, feature, value) rows, for features over ranges, and for sparse rows.

The wide tables' columns follow the data; as rows of their non-null cells they have SQL of their own, in which windows
run over (subject, feature).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrain.constants import LAG_FEATURE_LIMIT, TOP_AMBIENCE, TOP_APPS
from daygrain.operators import daily, matrix as mx, relative, sparse
from daygrain.plans import features as ft, q_nested as N, views_sql as S
from daygrain.plans.q_daily import _v1_sql_days
from daygrain.plans.q_spine import _CAL_SQL
from daygrain.plans.registry import register
from daygrain.sources import views

DAY, GK = ["subject_id", "lifelog_date"], ["subject_id", "bucket"]


def cells(feats: DataFrame, keys: list[str]) -> DataFrame:
    """A feature table as (keys, feature, feature_value) of its non-null numbers.

    A row's numbers are one array, taken apart in generated code: unpivoting writes a wide row and has a projection for each column.
    """
    columns = [c for c in mx.numeric_columns(feats) if c not in keys]
    wide = feats.select(*keys, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("_values"))
    long = wide.select(*keys, F.posexplode("_values").alias("_place", "feature_value")).where("feature_value is not null")
    names = F.array(*[F.lit(c) for c in columns])
    return long.select(*keys, F.element_at(names, F.col("_place") + 1).alias("feature"), "feature_value")


def _relative_cells(date: str) -> str:
    """E1-E4 in long form: ``sensors`` (subject_id, date, feature, p, v) has every row's sensor values, nulls too, p being the column's place."""
    return f"""rolled AS (
  SELECT subject_id, {date}, feature, v, p, avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3,
         avg(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7, lag(v) OVER w AS l1
  FROM sensors WINDOW w AS (PARTITION BY subject_id, feature ORDER BY {date})),
rows AS (SELECT DISTINCT subject_id, {date} FROM sensors),
cells AS (
  SELECT subject_id, {date}, feature, v AS feature_value FROM rolled
  UNION ALL SELECT subject_id, {date}, feature || '_roll3_mean', r3 FROM rolled
  UNION ALL SELECT subject_id, {date}, feature || '_roll7_mean', r7 FROM rolled
  UNION ALL SELECT subject_id, {date}, feature || '_lag1', l1 FROM rolled WHERE p <= {LAG_FEATURE_LIMIT}
  UNION ALL SELECT subject_id, {date}, 'subject_row_order', CAST(row_number() OVER (PARTITION BY subject_id ORDER BY {date}) - 1 AS DOUBLE) FROM rows
  UNION ALL SELECT subject_id, {date}, 'subject_days_since_first',
                   CAST(datediff('day', min({date}) OVER (PARTITION BY subject_id), {date}) AS DOUBLE) FROM rows)"""


# --- the daily table -------------------------------------------------------------------------------------------------
def _daily_cells_sql() -> str:
    def stats(v: str, p: str, where: str | None) -> list[str]:
        f = f" FILTER (WHERE {where})" if where else ""
        x = f"CAST({v} AS DOUBLE)"
        there = lambda e: f"CASE WHEN count(*){f} > 0 THEN {e} END"
        out = [there(f"CAST(count({x}){f} AS DOUBLE)") + f" AS {p}_{v}_count"]
        out += [f"{fn}({x}){f} AS {p}_{v}_{n}" for fn, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"), ("median", "median"))]
        out.append(there(f"coalesce(sum({x}){f}, 0.0::DOUBLE)") + f" AS {p}_{v}_sum")
        for b in ("night", "morning", "afternoon", "evening"):
            inside = f"time_bin = '{b}'" + (f" AND {where}" if where else "")
            out.append(f"avg({x}) FILTER (WHERE {inside}) AS {p}_{v}_by_time_mean_{b}")
            out.append(f"CASE WHEN count(*) FILTER (WHERE {inside}) > 0 THEN coalesce(sum({x}) FILTER (WHERE {inside}), 0.0::DOUBLE) END "
                       f"AS {p}_{v}_by_time_sum_{b}")
        return out
    columns = stats("value", "v1", None) + stats("k", "v1", None) + stats("value", "v1err", "category = 'error'")
    names = [c.rsplit(" AS ", 1)[1] for c in columns] + ["v1_value_changes", "v1_k_changes"]
    flags = ", ".join(f"CASE WHEN lag(CAST({v} AS DOUBLE)) OVER w IS NULL OR {v} IS NULL OR CAST({v} AS DOUBLE) <> lag(CAST({v} AS DOUBLE)) OVER w "
                      f"THEN 1 ELSE 0 END AS c_{v}" for v in ("value", "k"))
    token = N._token("category", 24)
    chain = _v1_sql_days() + "," + S.V6[len(S.V1) + 1:] + f""",
stats AS (SELECT subject_id, lifelog_date, {', '.join(columns)} FROM d GROUP BY ALL),
flagged AS (SELECT subject_id, lifelog_date, {flags} FROM d WINDOW w AS (PARTITION BY subject_id, lifelog_date ORDER BY "timestamp", row_id)),
changed AS (SELECT subject_id, lifelog_date, CAST(sum(c_value) AS DOUBLE) AS v1_value_changes, CAST(sum(c_k) AS DOUBLE) AS v1_k_changes
            FROM flagged GROUP BY ALL),
wide AS (SELECT s.subject_id, s.lifelog_date, stats.* EXCLUDE (subject_id, lifelog_date), changed.* EXCLUDE (subject_id, lifelog_date)
         FROM spine s LEFT JOIN stats USING (subject_id, lifelog_date) LEFT JOIN changed USING (subject_id, lifelog_date)),
vocabulary AS (SELECT DISTINCT category FROM d WHERE category IS NOT NULL),
totals AS (SELECT subject_id, lifelog_date, count(category) AS total FROM d GROUP BY ALL),
counted AS (SELECT subject_id, lifelog_date, category, count(*) AS n FROM d WHERE category IS NOT NULL GROUP BY ALL),
shares AS (SELECT t.subject_id, t.lifelog_date, {token.replace('category', 'v.category')} AS token, total,
                  CASE WHEN total > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) END AS n
           FROM totals t CROSS JOIN vocabulary v LEFT JOIN counted c ON c.subject_id = t.subject_id AND c.lifelog_date = t.lifelog_date AND c.category = v.category),
sensors AS (
  SELECT subject_id, lifelog_date, feature, 1 AS p, v FROM wide UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(names)}))
  UNION ALL SELECT subject_id, lifelog_date, 'v1_category_count_' || token, 1, n FROM shares
  UNION ALL SELECT subject_id, lifelog_date, 'v1_category_ratio_' || token, 1, n / total FROM shares),
calendar AS ({_CAL_SQL}),
{_relative_cells('lifelog_date')}"""
    days = [c for c in ("life_dayofweek", "life_day", "life_month", "life_dayofyear", "life_weekofyear", "sleep_dayofweek", "is_weekend", "life_dayofweek_sin",
                        "life_dayofweek_cos", "life_dayofyear_sin", "life_dayofyear_cos", "sleep_gap_days", "subject_idx")]
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in days)
    # the calendar's SQL is a statement of its own, with its views inside
    return S.rounded(S.with_views(chain, f"""SELECT * FROM cells WHERE feature_value IS NOT NULL
UNION ALL SELECT subject_id, lifelog_date, feature, feature_value
FROM (UNPIVOT (SELECT subject_id, lifelog_date, {cast} FROM calendar) ON {', '.join(days)} INTO NAME feature VALUE feature_value)"""),
                     ["subject_id", "lifelog_date", "feature"])


@register("daily_feature_cells", _daily_cells_sql())
def daily_feature_cells(spark, sf_dir):
    """The whole daily feature table (B1-B7, C1, D1-D4, E1-E4), one row a non-null cell."""
    return cells(ft.daily_feature_table(spark, sf_dir), DAY)


# --- the bucket table ------------------------------------------------------------------------------------------------
def _bucket_cells_sql() -> str:
    plan = [("v2", N.D6_STATS), ("w_hr", N.D9_STATS), ("m_usage", N.D10_STATS), ("m_ambience", N.D13_STATS)]
    named = {p: [f"{p}_{c}_{s}" for c, st in d.items() for s in st.split()] for p, d in plan}
    # the columns' places decide which of them have a lag
    order = named["v2"] + named["w_hr"] + ["w_hr_daily_mean"] + named["m_usage"] + named["m_ambience"] + ["v2_l_partkey_nunique"]
    agg = lambda p, d: ", ".join(N._agg_sql(d, p))
    nested_chain = S.V3 + ", " + S.V4[S.V4.index("sensor_usage"):] + ", " + S.V5[S.V5.index("sensor_labels"):]
    chain = nested_chain + f""",
a AS (SELECT subject_id, bucket, {agg('v2', N.D6_STATS)} FROM ({N._d5_rows_sql()}) r GROUP BY ALL),
b AS (SELECT subject_id, bucket, {agg('w_hr', N.D9_STATS)}, CASE WHEN sum(hr_n) <> 0 THEN sum(hr_sum) / sum(hr_n) END AS w_hr_daily_mean
      FROM ({N._hr_rows_sql()}) r GROUP BY ALL),
c AS (SELECT subject_id, bucket, {agg('m_usage', N.D10_STATS)} FROM ({N._USAGE_ROWS}) r GROUP BY ALL),
ls AS ({N._label_stats_sql()}),
e AS (SELECT subject_id, bucket, {agg('m_ambience', N.D13_STATS)} FROM ls GROUP BY ALL),
f AS (SELECT subject_id, bucket, CAST(count(DISTINCT x.l_partkey) AS DOUBLE) AS v2_l_partkey_nunique
      FROM sensor_nested LEFT JOIN LATERAL (SELECT unnest(items) AS x) u ON TRUE GROUP BY subject_id, bucket),
wide AS (SELECT * FROM a JOIN b USING (subject_id, bucket) JOIN c USING (subject_id, bucket) JOIN e USING (subject_id, bucket)
         JOIN f USING (subject_id, bucket)),
{N._APP_RECORDS.format(n=TOP_APPS)},
ranked_apps AS (SELECT app, row_number() OVER (ORDER BY app) AS place FROM top_apps),
app_sum AS (SELECT subject_id, bucket, app, sum(time) AS s FROM app_rec WHERE app IN (SELECT app FROM top_apps) GROUP BY ALL),
app_cells AS (SELECT w.subject_id, w.bucket, 'm_usage_app_time_' || {N._token('t.app')} AS feature, {len(order)} + t.place AS p,
                     CASE WHEN k.subject_id IS NOT NULL THEN coalesce(s.s, 0.0::DOUBLE) END AS v
              FROM wide w CROSS JOIN ranked_apps t LEFT JOIN (SELECT DISTINCT subject_id, bucket FROM app_sum) k USING (subject_id, bucket)
              LEFT JOIN app_sum s ON s.subject_id = w.subject_id AND s.bucket = w.bucket AND s.app = t.app),
top_labels AS (SELECT ambience_top_label AS l FROM ls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP_AMBIENCE}),
ranked_labels AS (SELECT l, row_number() OVER (ORDER BY l) AS place FROM top_labels),
label_n AS (SELECT subject_id, bucket, ambience_top_label AS l, count(*) AS n FROM ls WHERE ambience_top_label IN (SELECT l FROM top_labels) GROUP BY ALL),
label_cells AS (SELECT w.subject_id, w.bucket, 'm_ambience_top_count_' || {N._token('t.l')} AS feature,
                       {len(order)} + (SELECT count(*) FROM top_apps) + t.place AS p,
                       CASE WHEN k.subject_id IS NOT NULL THEN CAST(coalesce(s.n, 0) AS DOUBLE) END AS v
                FROM wide w CROSS JOIN ranked_labels t LEFT JOIN (SELECT DISTINCT subject_id, bucket FROM label_n) k USING (subject_id, bucket)
                LEFT JOIN label_n s ON s.subject_id = w.subject_id AND s.bucket = w.bucket AND s.l = t.l),
places AS (SELECT unnest([{', '.join(f"'{c}'" for c in order)}]) AS feature, unnest(range(1, {len(order) + 1})) AS p),
sensors AS (
  SELECT subject_id, bucket, feature, p, v FROM (SELECT * FROM wide UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(order)}))) u JOIN places USING (feature)
  UNION ALL SELECT * FROM app_cells UNION ALL SELECT * FROM label_cells),
{_relative_cells('bucket')}"""
    return S.rounded(S.with_views(chain, "SELECT * FROM cells WHERE feature_value IS NOT NULL"), [*GK, "feature"])


@register("bucket_feature_cells", _bucket_cells_sql())
def bucket_feature_cells(spark, sf_dir):
    """The whole bucket feature table (D5-D14, C1, E1-E4), one row a non-null cell."""
    return cells(ft.bucket_feature_table(spark, sf_dir), GK)


# --- E1-E4 over documents, in ranges ------------------------------------------------------------------------------------
_READINGS = ["n_chars", "log_chars", "n_lines"]


@register("document_relative_features", S.rounded(f"""SELECT doc_id AS key,
  CAST(doc_id - min(doc_id) OVER (PARTITION BY source) AS BIGINT) AS subject_days_since_first,
  CAST(row_number() OVER w - 1 AS BIGINT) AS subject_row_order,
  {', '.join(f"avg({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_roll{n}_mean" for n in (3, 7) for c in _READINGS)},
  {', '.join(f"lag({c}) OVER w AS {c}_lag1" for c in _READINGS)}
FROM (SELECT doc_id, source, CAST(n_chars AS DOUBLE) AS n_chars, ln(CAST(n_chars AS DOUBLE) + 1.0::DOUBLE) AS log_chars,
             CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines FROM documents) t
WINDOW w AS (PARTITION BY source ORDER BY doc_id)""", ["key", "subject_days_since_first", "subject_row_order"]))
def document_relative_features(spark, sf_dir):
    """E1-E4 of every document's readings within its source, a source being cut into ranges."""
    rows = views.document_readings(spark, sf_dir).select("key", F.col("source").alias("subject_id"), *_READINGS)
    return relative.relative_in_ranges(rows, "subject_id", "key").drop("subject_id", *_READINGS)


# --- sparse rows -------------------------------------------------------------------------------------------------------
@register("one_hot_sparse", S.with_views(S.V6, """SELECT subject_id, lifelog_date, count(DISTINCT subject_id) OVER () AS size,
  [dense_rank() OVER (ORDER BY subject_id) - 1] AS indices, [1.0::DOUBLE] AS "values"
FROM spine"""))
def one_hot_sparse(spark, sf_dir):
    """The subject's one-hot row by its non-zero alone, over a vocabulary of any size."""
    s = views.spine(spark, sf_dir).select("subject_id", "lifelog_date")
    return sparse.one_hot_sparse(s, "subject_id", "_row").select("subject_id", "lifelog_date", "_row.*")


@register("daily_category_sparse", S.with_views(_v1_sql_days(), """SELECT subject_id, lifelog_date, (SELECT count(DISTINCT category) FROM d) AS size,
  list(idx ORDER BY idx) AS indices, list(n ORDER BY idx) AS counts, list(round(n / total, 9) ORDER BY idx) AS ratios
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY subject_id, lifelog_date) AS DOUBLE) AS total
      FROM (SELECT subject_id, lifelog_date, category, count(*) AS n FROM d WHERE category IS NOT NULL GROUP BY ALL) c) t
JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS idx FROM (SELECT DISTINCT category FROM d WHERE category IS NOT NULL)) v USING (category)
GROUP BY subject_id, lifelog_date"""))
def daily_category_sparse(spark, sf_dir):
    """D4 wide: a day's category counts and shares as a sparse row over the sorted categories."""
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    return sparse.category_sparse(v1, "category").withColumn("ratios", F.transform("ratios", lambda r: F.round(r, 9)))
