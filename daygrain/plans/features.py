"""Wide feature tables: the reference's feature build re-expressed as one lazy plan each.

``daily_feature_table``: spine (V6) + calendar + daily roll-ups of the scalar
sensor (all readings with changes and category shares, plus the sparser
'error' readings) + per-subject rolling / lag features + NaN/Inf -> null.

``bucket_feature_table``: (nation, month) spine from V2 + every list-sensor
roll-up (D6/D7 on V2, D9 on V3, D10/D11 on V4, D13/D14 on V5).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.constants import TOP_AMBIENCE, TOP_APPS
from daygrain.functions import lists
from daygrain.operators import daily, matrix as mx, nested, relative, spine as sp
from daygrain.session import checkpoint_dir, materialize
from daygrain.sources import files, views
from daygrain.sources.tables import table_path

KEYS = ["subject_id", "lifelog_date"]
GK = ["subject_id", "bucket"]


def daily_feature_table(spark, sf_dir: str):
    v1 = daily.with_date_keys(views.sensor_scalar(spark, sf_dir))
    vocab = daily.category_vocabulary(v1, "category")
    error = F.col("category") == "error"
    extra = [e for v in ("value", "k") for e in daily.time_bin_exprs(v, "v1")] + daily.category_exprs("category", vocab, "v1") \
        + daily.time_bin_exprs("value", "v1err", condition=error)
    # both sensors in one aggregate, written once; the spine's days are its keys
    stats = daily.daily_stats_table(v1, [("value", "v1", None), ("k", "v1", None), ("value", "v1err", error)], KEYS, extra)
    changes = daily.daily_changes(v1, ["value", "k"], "v1")
    base = sp.add_calendar_features(views.spine_from_days(stats.select(*KEYS)))
    feats = sp.join_daily(base, [stats, changes], KEYS)
    feats = relative.add_subject_relative_features(feats)
    nums = [c for c in mx.numeric_columns(feats) if c not in ("subject_id",)]
    return mx.null_nonfinite(feats, nums)


def document_features(spark, sf_dir: str, ranges: int | None = None):
    """The model's features by key: a document's readings, their course within its source (E1-E4, in ranges, as a source may hold any share
    of the documents), its language and source one-hot (B8), without NaN and infinities (B7), under safe unique names (B5)."""
    readings = views.document_readings(spark, sf_dir)
    feats = relative.relative_in_ranges(readings.withColumnRenamed("source", "subject_id"), "subject_id", "key", ranges=ranges)
    feats = mx.one_hot_columns(mx.one_hot_columns(feats, "lang", "lang"), "subject_id", "source").drop("lang", "subject_id")
    return mx.rename_unique(mx.null_nonfinite(feats, [c for c in feats.columns if c != "key"]), ["key"])


def cached_document_features(spark, sf_dir: str, base: str | None = None, force: bool = False):
    """``document_features`` through the cache by content (A3), by default in the session's shared folder."""
    base = base or f"{checkpoint_dir(spark)}/features"
    return files.cached_table(spark, base, "document_features", [table_path(sf_dir, "documents")], lambda: document_features(spark, sf_dir), force)


def bucket_feature_table(spark, sf_dir: str, top_apps: int = TOP_APPS, top_labels: int = TOP_AMBIENCE):
    """All list sensors from one materialised per-order view.

    Row statistics of the four sensors are one ``select`` of higher-order functions;
    their daily statistics (D6, D9, D10, D13) are one ``groupBy`` (one shuffle). The
    distinct count (D7) and the two top-N pivots (D11, D14) are the only other
    aggregates; all results leave hash-partitioned on the bucket key.
    """
    orders = materialize(views.sensor_orders(spark, sf_dir), as_table=True)
    # the sensors are fields of the same items: no view's lists are built anew for each row
    usage, label = ("p_brand", "l_quantity"), ("l_returnflag", "l_discount")
    rows, c2 = lists.add_list_key_stats(orders, "items", views.NESTED_KEYS, "v2")
    rows, c3 = lists.add_numeric_array_stats(rows, F.col("items")["l_extendedprice"], "hr")
    rows, c4 = lists.add_usage_stats(rows, "items", *usage)
    rows, c5 = lists.add_label_distribution_stats(rows, "items", *label)
    rows = rows.select(*GK, *c2, *c3, *c4, *[c for c in c5 if c != "ambience_top_label"])
    v2_cols = c2
    aggs = (nested.agg_plan(nested.row_stat_plan(v2_cols), "v2") + nested.agg_plan(nested.HR_PLAN, "w_hr")
            + [F.try_divide(F.sum("hr_sum"), F.nullif(F.sum("hr_n"), F.lit(0.0))).alias("w_hr_daily_mean")]
            + nested.agg_plan(nested.USAGE_PLAN, "m_usage") + nested.agg_plan(nested.AMBIENCE_PLAN, "m_ambience"))
    stats = rows.groupBy(*GK).agg(*aggs)
    tables = [
        stats,
        nested.daily_nested_distinct(orders, "items", "l_partkey", GK, "v2"),
        nested.top_app_pivot(orders, "items", GK, top_apps, app_field=usage[0], time_field=usage[1]),
        nested.top_label_pivot(orders, "items", GK, top_labels, label_field=label[0], prob_field=label[1]),
    ]
    spine = orders.select(*GK).distinct()
    feats = sp.join_daily(spine, tables, GK)
    return relative.add_subject_relative_features(feats, subject="subject_id", date="bucket")
