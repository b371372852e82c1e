"""Registered queries for list readings (D5-D14) over the views V2-V5."""

from __future__ import annotations

from daygrain.operators import nested
from daygrain.plans import views_sql as S
from daygrain.plans.registry import register
from daygrain.sources import views
from daygrain.sources.tables import read_table

GK = ["subject_id", "bucket"]
NKEYS = views.NESTED_KEYS
TOP_N_APPS = 10      # a parameter of the operator (default 40); 10 of the 25 brands so the filter bites
TOP_N_LABELS = 50

# what the oracles aggregate, written out apart from the operators' plans
SUMS, SPREAD = "sum mean max", "mean std min max"
D6_STATS = {"v2_row_n": SUMS, **{f"v2_row_{k}_sum": SUMS for k in ("l_quantity", "l_extendedprice", "l_discount")},
            **{f"v2_row_{k}_{s}": SPREAD for k in ("l_quantity", "l_extendedprice", "l_discount")
               for s in ("mean", "std", "min", "max")}}
D9_STATS = {"hr_n": SUMS, "hr_sum": SUMS, "hr_mean": SPREAD, "hr_std": "mean max", "hr_min": "min mean",
            "hr_max": "max mean", "hr_median": "mean std"}
D10_STATS = {"usage_events": SUMS, "usage_total_time": SUMS, "usage_max_time": "mean max", "usage_unique_apps": SUMS}
D13_STATS = {"ambience_n": SUMS, "ambience_prob_sum": SUMS, "ambience_top_prob": SPREAD, "ambience_entropy": SPREAD}

# --- DuckDB expression builders (independent SQL text) -------------------------------


def _vals(items: str, field: str | None = None) -> str:
    body = f"TRY_CAST(x.{field} AS DOUBLE)" if field else "TRY_CAST(x AS DOUBLE)"
    return f"list_filter(list_transform({items}, lambda x: {body}), lambda v: v IS NOT NULL)"


def _sum(vals: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {vals}), lambda a, x: a + x)"


def _stats_cols(vals: str, name: str) -> list[str]:
    """SQL for n/sum/mean/std/min/max of a double list, over a CTE column ``vals``."""
    n, s = f"len({vals})", _sum(vals)
    mean = f"(CASE WHEN {n} > 0 THEN {s} / {n} END)"
    sq = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform({vals}, lambda x: (x - {mean}) * (x - {mean}))), lambda a, x: a + x)"
    return [f"CASE WHEN {n} > 0 THEN {mean} END AS {name}_mean",
            f"CASE WHEN {n} > 0 THEN sqrt({sq} / {n}) END AS {name}_std",
            f"CASE WHEN {n} > 0 THEN list_min({vals}) END AS {name}_min",
            f"CASE WHEN {n} > 0 THEN list_max({vals}) END AS {name}_max",
            f"CASE WHEN {n} > 0 THEN {s} END AS {name}_sum"]


def _d5_rows_sql(view: str = "sensor_nested") -> str:
    cols = ["subject_id", "bucket", "row_id", "CAST(len(items) AS DOUBLE) AS v2_row_n"]
    for k in NKEYS:
        cols += _stats_cols(_vals("items", k), f"v2_row_{k}")
    return f"SELECT {', '.join(cols)} FROM {view}"


def _agg_sql(plan: dict[str, str], prefix: str) -> list[str]:
    f = {"sum": "coalesce(sum({c}), 0.0)", "mean": "avg({c})", "max": "max({c})", "min": "min({c})",
         "std": "stddev_samp({c})"}
    return [f[s].format(c=f"CAST({c} AS DOUBLE)") + f" AS {prefix}_{c}_{s}" for c, st in plan.items() for s in st.split()]


# --- D5 ------------------------------------------------------------------------------
@register("list_row_stats",
          S.rounded(S.with_views(S.V2, "SELECT * EXCLUDE (subject_id, bucket) FROM (" + _d5_rows_sql() + ")"),
                    ["row_id"]))
def list_row_stats(spark, sf_dir):
    """Per-row n and mean/pop-std/min/max/sum of each numeric item key (V2)."""
    return nested.list_row_stats(views.sensor_nested(spark, sf_dir), "items", NKEYS, ["row_id"], "v2")


# --- D6 ------------------------------------------------------------------------------
def _d6_sql() -> str:
    body = (f"SELECT subject_id, bucket, {', '.join(_agg_sql(D6_STATS, 'v2'))} FROM ({_d5_rows_sql()}) r "
            f"GROUP BY subject_id, bucket")
    return S.rounded(S.with_views(S.V2, body), GK)


@register("daily_list_stats", _d6_sql())
def daily_list_stats(spark, sf_dir):
    """Per-bucket re-aggregation of the D5 row stats."""
    return nested.daily_nested_numeric_features(views.sensor_nested(spark, sf_dir), "items", NKEYS, "v2", GK)


# --- D7 ------------------------------------------------------------------------------
@register("daily_nested_distinct", S.with_views(S.V2, """SELECT subject_id, bucket,
       CAST(count(DISTINCT x.l_partkey) AS BIGINT) AS v2_l_partkey_nunique
FROM sensor_nested LEFT JOIN LATERAL (SELECT unnest(items) AS x) u ON TRUE
GROUP BY subject_id, bucket"""))
def daily_nested_distinct(spark, sf_dir):
    """Exact distinct nested keys per bucket (0 for buckets without items)."""
    return nested.daily_nested_distinct(views.sensor_nested(spark, sf_dir, fields=["l_partkey"]), "items", "l_partkey", GK,
                                        "v2")


# --- D8 / D9 -------------------------------------------------------------------------
def _hr_rows_sql() -> str:
    v = _vals("readings")
    n = f"len({v})"
    srt = f"list_sort({v})"
    med = (f"CASE WHEN {n} = 0 THEN NULL WHEN {n} % 2 = 1 THEN {srt}[{n} // 2 + 1] "
           f"ELSE ({srt}[{n} // 2] + {srt}[{n} // 2 + 1]) / 2.0::DOUBLE END")
    st = _stats_cols(v, "hr")
    return (f"SELECT subject_id, bucket, row_id, CAST({n} AS DOUBLE) AS hr_n, "
            f"{_sum(v)} AS hr_sum, {st[0]}, {st[1]}, {st[2]}, {st[3]}, {med} AS hr_median FROM sensor_array")


@register("array_row_stats",
          S.rounded(S.with_views(S.V3, "SELECT * EXCLUDE (subject_id, bucket) FROM (" + _hr_rows_sql() + ")"),
                    ["row_id"]))
def array_row_stats(spark, sf_dir):
    """N, sum, mean, pop std, min, max, median of each row's double list (V3)."""
    return nested.array_row_stats(views.sensor_array(spark, sf_dir), "readings", ["row_id"])


@register("vector_row_stats", S.rounded(S.with_views("""sensor_array AS (
  SELECT 0 AS subject_id, 0 AS bucket, vec_id AS row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS readings FROM embeddings)""",
    "SELECT * EXCLUDE (subject_id, bucket) FROM (" + _hr_rows_sql() + ")"), ["row_id"]))
def vector_row_stats(spark, sf_dir):
    """D8 on vectors: n, sum, mean, pop std, min, max, median of each embedding's components."""
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return nested.array_row_stats(vectors.withColumnRenamed("vec_id", "row_id"), "embedding", ["row_id"])


def _d9_sql() -> str:
    body = (f"SELECT subject_id, bucket, {', '.join(_agg_sql(D9_STATS, 'w_hr'))}, "
            f"CASE WHEN sum(hr_n) <> 0 THEN sum(hr_sum) / sum(hr_n) END AS w_hr_daily_mean "
            f"FROM ({_hr_rows_sql()}) r GROUP BY subject_id, bucket")
    return S.rounded(S.with_views(S.V3, body), GK)


@register("daily_array_stats", _d9_sql())
def daily_array_stats(spark, sf_dir):
    """Daily aggregation of D8 plus the reading-weighted mean."""
    return nested.daily_array_stats(views.sensor_array(spark, sf_dir), "readings", GK)


# --- D10 / D11 -----------------------------------------------------------------------
_USAGE_ROWS = """SELECT subject_id, bucket, row_id,
       CAST(len(items) AS DOUBLE) AS usage_events,
       list_reduce(list_prepend(0.0::DOUBLE, list_transform(items, lambda x: coalesce(TRY_CAST(x.total_time AS DOUBLE), 0.0::DOUBLE))), lambda a, x: a + x) AS usage_total_time,
       list_reduce(list_prepend(0.0::DOUBLE, list_transform(items, lambda x: coalesce(TRY_CAST(x.total_time AS DOUBLE), 0.0::DOUBLE))), lambda a, x: greatest(a, x)) AS usage_max_time,
       CAST(len(list_distinct(list_filter(list_transform(items, lambda x: CAST(x.app_name AS VARCHAR)), lambda v: v IS NOT NULL))) AS DOUBLE) AS usage_unique_apps
FROM sensor_usage"""


@register("daily_usage", S.rounded(S.with_views(S.V4, f"""SELECT subject_id, bucket,
       {', '.join(_agg_sql(D10_STATS, 'm_usage'))}
FROM ({_USAGE_ROWS}) r GROUP BY subject_id, bucket"""), GK))
def daily_usage(spark, sf_dir):
    """Per-row usage counts and times, then daily sum/mean/max."""
    return nested.daily_usage(views.sensor_usage(spark, sf_dir), "items", GK)


_APP_RECORDS = """app_rec AS (
  SELECT subject_id, bucket, CAST(x.app_name AS VARCHAR) AS app,
         coalesce(TRY_CAST(x.total_time AS DOUBLE), 0.0::DOUBLE) AS time
  FROM sensor_usage, unnest(items) AS u(x) WHERE x.app_name IS NOT NULL),
top_apps AS (
  SELECT app FROM app_rec GROUP BY app ORDER BY sum(time) DESC, app LIMIT {n})"""


@register("top_app_pivot", S.rounded(S.with_views(S.V4 + ",\n" + _APP_RECORDS.format(n=TOP_N_APPS), """
SELECT subject_id, bucket, app, sum(time) AS app_time
FROM app_rec WHERE app IN (SELECT app FROM top_apps) GROUP BY subject_id, bucket, app"""),
    ["subject_id", "bucket", "app"]))
def top_app_pivot(spark, sf_dir):
    """D11 (long form): per-bucket time of each of the global top-N apps."""
    return nested.top_app_long(views.sensor_usage(spark, sf_dir), "items", GK, TOP_N_APPS)


def _token(v: str, length: int = 40) -> str:
    t = f"lower(regexp_replace(regexp_replace({v}, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    t = f"CASE WHEN {t} = '' THEN 'x_' || substr(md5({v}), 1, 8) ELSE {t} END"
    t = f"CASE WHEN regexp_matches({t}, '^[0-9]') THEN 'f_' || {t} ELSE {t} END"
    return f"(regexp_replace(substr({t}, 1, {length}), '^_+|_+$', '', 'g') || '_' || substr(md5({v}), 1, 8))"


def _melted(wide):
    """A wide pivot as one row per (group, column)."""
    return wide.unpivot(GK, [c for c in wide.columns if c not in GK], "feature", "feature_value")


@register("top_app_wide", S.rounded(S.with_views(S.V4 + ",\n" + _APP_RECORDS.format(n=TOP_N_APPS) + """,
app_sum AS (SELECT subject_id, bucket, app, sum(time) AS s FROM app_rec
            WHERE app IN (SELECT app FROM top_apps) GROUP BY ALL),
app_keys AS (SELECT DISTINCT subject_id, bucket FROM app_sum)""", f"""
SELECT k.subject_id, k.bucket, 'm_usage_app_time_' || {_token('t.app')} AS feature, coalesce(a.s, 0.0::DOUBLE) AS feature_value
FROM app_keys k CROSS JOIN top_apps t
LEFT JOIN app_sum a ON a.subject_id = k.subject_id AND a.bucket = k.bucket AND a.app = t.app"""),
    ["subject_id", "bucket", "feature"]))
def top_app_wide(spark, sf_dir):
    """D11 (wide form, melted): one zero-filled column per top app."""
    return _melted(nested.top_app_pivot(views.sensor_usage(spark, sf_dir), "items", GK, TOP_N_APPS))


# --- D12 / D13 / D14 -----------------------------------------------------------------
def _label_rows_sql() -> str:
    probs = "list_transform(items, lambda x: coalesce(TRY_CAST(x.prob AS DOUBLE), 0.0::DOUBLE))"
    return f"""SELECT subject_id, bucket, row_id, probs, items,
       CAST(len(probs) AS DOUBLE) AS ambience_n,
       list_reduce(list_prepend(0.0::DOUBLE, probs), lambda a, x: a + x) AS tot
FROM (SELECT *, {probs} AS probs FROM sensor_labels)"""


_LABEL_STATS = """SELECT subject_id, bucket, row_id, ambience_n, tot AS ambience_prob_sum,
       CASE WHEN ambience_n > 0 THEN list_max(probs) END AS ambience_top_prob,
       CASE WHEN ambience_n > 0 AND tot > 0 THEN
         -list_reduce(list_prepend(0.0::DOUBLE, list_transform(probs,
             lambda p: (p / tot) * ln(least(greatest(p / tot, 0.00001::DOUBLE), 1.0::DOUBLE)))), lambda a, x: a + x)
       END AS ambience_entropy,
       CASE WHEN ambience_n > 0 THEN CAST(items[list_position(probs, list_max(probs))].label AS VARCHAR)
            ELSE 'missing' END AS ambience_top_label
FROM ({rows}) r"""


def _label_stats_sql() -> str:
    return _LABEL_STATS.format(rows=_label_rows_sql())


@register("label_entropy", S.rounded(S.with_views(
    S.V5, "SELECT * EXCLUDE (subject_id, bucket) FROM (" + _label_stats_sql() + ")"),
    ["row_id", "ambience_top_label"]))
def label_entropy(spark, sf_dir):
    """N, prob sum, first-argmax prob and label, entropy of each row's label list (V5)."""
    return nested.label_row_stats(views.sensor_labels(spark, sf_dir), "items", ["row_id"])


@register("daily_label_stats", S.rounded(S.with_views(S.V5, f"""SELECT subject_id, bucket,
       {', '.join(_agg_sql(D13_STATS, 'm_ambience'))}
FROM ({_label_stats_sql()}) r GROUP BY subject_id, bucket"""), GK))
def daily_label_stats(spark, sf_dir):
    """Daily re-aggregation of the D12 row stats."""
    return nested.daily_label_stats(views.sensor_labels(spark, sf_dir), "items", GK)


@register("top_label_pivot", S.with_views(S.V5 + f""",
ls AS ({_label_stats_sql()}),
top_labels AS (SELECT ambience_top_label FROM ls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP_N_LABELS})""", """
SELECT subject_id, bucket, ambience_top_label, count(*) AS n
FROM ls WHERE ambience_top_label IN (SELECT ambience_top_label FROM top_labels)
GROUP BY subject_id, bucket, ambience_top_label"""))
def top_label_pivot(spark, sf_dir):
    """D14 (long form): per-bucket counts of rows whose top label is among the N most frequent."""
    return nested.top_label_long(views.sensor_labels(spark, sf_dir), "items", GK, TOP_N_LABELS)


@register("top_label_wide", S.with_views(S.V5 + f""",
ls AS ({_label_stats_sql()}),
top_labels AS (SELECT ambience_top_label AS v FROM ls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP_N_LABELS}),
label_n AS (SELECT subject_id, bucket, ambience_top_label AS v, count(*) AS n FROM ls
            WHERE ambience_top_label IN (SELECT v FROM top_labels) GROUP BY ALL),
label_keys AS (SELECT DISTINCT subject_id, bucket FROM label_n)""", f"""
SELECT k.subject_id, k.bucket, 'm_ambience_top_count_' || {_token('t.v')} AS feature,
       CAST(coalesce(l.n, 0) AS BIGINT) AS feature_value
FROM label_keys k CROSS JOIN top_labels t
LEFT JOIN label_n l ON l.subject_id = k.subject_id AND l.bucket = k.bucket AND l.v = t.v"""))
def top_label_wide(spark, sf_dir):
    """D14 (wide form, melted): one zero-filled count per frequent top label."""
    return _melted(nested.top_label_pivot(views.sensor_labels(spark, sf_dir), "items", GK, TOP_N_LABELS))
