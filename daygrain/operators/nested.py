"""Per-row statistics of list readings and their daily re-aggregation.

Row statistics are higher-order functions over each row's own array (no
explode, no Python), so they are map-only and scale with the row count. Daily
re-aggregation is one ``groupBy`` per sensor with map-side partial aggregation.
Global top-N vocabularies are an aggregate followed by ``orderBy().limit(N)``
(a distributed top-N); the N winners are the only thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.constants import AMBIENCE_PLAN, HR_PLAN, MISSING_LABEL, ROW_OTHER_STATS, ROW_SUM_STATS, TOP_AMBIENCE, \
    TOP_APPS, USAGE_PLAN
from daygrain.functions import lists
from daygrain.functions.exprs import dlit, safe_ratio, tokens
from daygrain.session import materialize

_AGG = {
    "sum": lambda c: F.coalesce(F.sum(c), dlit(0.0)),   # pandas: sum of all-missing is 0
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "count": F.count,
}


def agg_plan(plan: dict[str, list[str]], prefix: str) -> list[Column]:
    """``{column: [stat, ...]}`` to aliased aggregates named ``{prefix}_{column}_{stat}``."""
    out = []
    for c, stats in plan.items():
        for s in stats:
            out.append(_AGG[s](F.col(c).cast("double")).alias(f"{prefix}_{c}_{s}"))
    return out


# --- D5 / D6 / D7 ------------------------------------------------------------------
def list_row_stats(df: DataFrame, list_col: str, numeric_keys: list[str], keys: list[str],
                   prefix: str) -> DataFrame:
    """One output row per input row (``keys`` are carried through)."""
    out, cols = lists.add_list_key_stats(df, list_col, numeric_keys, prefix)
    return out.select(*keys, *cols)


def row_stat_plan(columns: list[str]) -> dict[str, list[str]]:
    return {c: (ROW_SUM_STATS if c.endswith("_n") or c.endswith("_sum") else ROW_OTHER_STATS) for c in columns}


def daily_nested_numeric_features(df: DataFrame, list_col: str, numeric_keys: list[str], prefix: str,
                                  keys: list[str], unique_key: str | None = None,
                                  approx_distinct: bool = False) -> DataFrame:
    """D5 + D6 (+ D7): row stats of each list, then per-day sum/mean/max or mean/std/min/max.

    With ``unique_key`` the distinct count (D7) is a second aggregate on the same
    keys; both sides come out hash-partitioned on ``keys``, so the join adds no shuffle.
    """
    rows = list_row_stats(df, list_col, numeric_keys, keys, prefix)
    stat_cols = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(*agg_plan(row_stat_plan(stat_cols), prefix))
    if unique_key:
        out = out.join(daily_nested_distinct(df, list_col, unique_key, keys, prefix, approx_distinct),
                       list(keys), "left")
    return out


def daily_nested_distinct(df: DataFrame, list_col: str, unique_key: str, keys: list[str], prefix: str,
                          approx: bool = False) -> DataFrame:
    """Exact distinct count of a nested key per group; empty or null lists give 0.

    ``explode_outer`` keeps groups without items; the distinct aggregate is planned by
    Spark as (group, value) de-duplication with map-side partial aggregation, so a hot
    group never holds more than its distinct values. ``approx`` switches to a
    fixed-size HyperLogLog++ sketch per group.
    """
    ex = df.select(*keys, F.explode_outer(F.col(list_col)[unique_key]).alias("_v"))
    cnt = F.approx_count_distinct("_v") if approx else F.count_distinct("_v")
    return ex.groupBy(*keys).agg(cnt.cast("long").alias(f"{prefix}_{unique_key}_nunique"))


# --- D8 / D9 ------------------------------------------------------------------------
def array_row_stats(df: DataFrame, arr_col: str, keys: list[str]) -> DataFrame:
    """N, sum, mean, population std, min, max, median of each row's list."""
    out, cols = lists.add_numeric_array_stats(df, arr_col, "hr")
    return out.select(*keys, *cols)


def daily_array_stats(df: DataFrame, arr_col: str, keys: list[str], prefix: str = "w_hr") -> DataFrame:
    """Daily aggregation of D8 plus the reading-weighted mean sum(hr_sum)/sum(hr_n)."""
    rows = array_row_stats(df, arr_col, keys)
    return rows.groupBy(*keys).agg(
        *agg_plan(HR_PLAN, prefix),
        safe_ratio(F.sum("hr_sum"), F.sum("hr_n")).alias(f"{prefix}_daily_mean"))


# --- D10 / D11 ----------------------------------------------------------------------
def usage_row_stats(df: DataFrame, items: str, keys: list[str]) -> DataFrame:
    out, cols = lists.add_usage_stats(df, items)
    return out.select(*keys, *cols)


def daily_usage(df: DataFrame, items: str, keys: list[str], prefix: str = "m_usage") -> DataFrame:
    """Per-row usage stats, then daily sum/mean/max (distinct apps: a sum of per-row counts)."""
    return usage_row_stats(df, items, keys).groupBy(*keys).agg(*agg_plan(USAGE_PLAN, prefix))


def app_records(df: DataFrame, items: str, keys: list[str], app_field: str = "app_name", time_field: str = "total_time") -> DataFrame:
    """(keys, app, time) for every item with a non-null app; a bad time counts 0.0."""
    ex = df.select(*keys, F.explode(F.col(items)).alias("_it"))
    return (ex.select(*keys, F.col(f"_it.{app_field}").cast("string").alias("app"),
                      F.coalesce(F.col(f"_it.{time_field}").try_cast("double"), dlit(0.0)).alias("time"))
              .where(F.col("app").isNotNull()))


def top_values(records: DataFrame, value: str, weight: Column | None, n: int) -> DataFrame:
    """Global top-N by total weight (or by count), ties by value ascending.

    Aggregate, then ``orderBy().limit()``: Spark runs it as a distributed
    TakeOrderedAndProject, so only N rows per partition reach the final merge.
    """
    score = F.sum(weight) if weight is not None else F.count(F.lit(1)).cast("double")
    return (records.groupBy(value).agg(score.alias("_score"))
                   .orderBy(F.desc("_score"), F.asc(value)).limit(n).select(value))


def top_app_long(df: DataFrame, items: str, keys: list[str], top_n: int = TOP_APPS) -> DataFrame:
    """D11 long form: (keys, app, app_time) for the global top-N apps."""
    rec = app_records(df, items, keys)
    top = top_values(rec, "app", F.col("time"), top_n)
    # the vocabulary has at most ``top_n`` rows: a proven bound for the broadcast
    kept = rec.join(F.broadcast(top), "app", "left_semi")
    return kept.groupBy(*keys, "app").agg(F.sum("time").alias("app_time"))


def top_app_pivot(df: DataFrame, items: str, keys: list[str], top_n: int = TOP_APPS,
                  prefix: str = "m_usage_app_time", app_field: str = "app_name", time_field: str = "total_time") -> DataFrame:
    """D11 wide form: one 0-filled column per top app; groups without any top app are absent.

    The items are read once: the top-N and the columns both come from the written totals of (group, app).
    """
    rec = materialize(app_records(df, items, keys, app_field, time_field).groupBy(*keys, "app").agg(F.sum("time").alias("time")))
    # the top-N is found once; its at most ``top_n`` values are the columns and the filter
    vocab = sorted(r[0] for r in top_values(rec, "app", F.col("time"), top_n).collect())
    wide = rec.where(F.col("app").isin(vocab)).groupBy(*keys).pivot("app", vocab).agg(F.sum("time"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{a}`"), dlit(0.0)).alias(f"{prefix}_{t}")
                                for a, t in zip(vocab, tokens(vocab, 40))])


# --- D12 / D13 / D14 ---------------------------------------------------------------
def label_row_stats(df: DataFrame, items: str, keys: list[str]) -> DataFrame:
    """N, prob sum, top prob, entropy and top label of each row's label list."""
    out, cols = lists.add_label_distribution_stats(df, items)
    return out.select(*keys, *cols)


def daily_label_stats(df: DataFrame, items: str, keys: list[str], prefix: str = "m_ambience") -> DataFrame:
    """Daily sum/mean/max and mean/std/min/max of the D12 row stats."""
    return label_row_stats(df, items, keys).groupBy(*keys).agg(*agg_plan(AMBIENCE_PLAN, prefix))


def top_label_long(df: DataFrame, items: str, keys: list[str], top_n: int = TOP_AMBIENCE) -> DataFrame:
    """D14 long form: rows per (keys, top label) for the N most frequent top labels."""
    rows = label_row_stats(df, items, keys).select(*keys, "ambience_top_label")
    top = top_values(rows, "ambience_top_label", None, top_n)
    kept = rows.join(F.broadcast(top), "ambience_top_label", "left_semi")
    return kept.groupBy(*keys, "ambience_top_label").agg(F.count(F.lit(1)).alias("n"))


def top_label_pivot(df: DataFrame, items: str, keys: list[str], top_n: int = TOP_AMBIENCE,
                    prefix: str = "m_ambience_top_count", label_field: str = "label", prob_field: str = "prob") -> DataFrame:
    """D14 wide form: one 0-filled column per top label; the lists are read once, for the written counts of (group, label)."""
    rows, _ = lists.add_label_distribution_stats(df, items, label_field, prob_field)
    rows = materialize(rows.groupBy(*keys, "ambience_top_label").agg(F.count(F.lit(1)).alias("_n")))
    vocab = sorted(r[0] for r in top_values(rows, "ambience_top_label", F.col("_n"), top_n).collect())
    wide = rows.where(F.col("ambience_top_label").isin(vocab)).groupBy(*keys).pivot("ambience_top_label", vocab).agg(F.sum("_n"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long")
                                .alias(f"{prefix}_{t}") for v, t in zip(vocab, tokens(vocab, 40))])


__all__ = [
    "list_row_stats", "daily_nested_numeric_features", "daily_nested_distinct", "array_row_stats",
    "daily_array_stats", "usage_row_stats", "daily_usage", "top_app_long", "top_app_pivot",
    "label_row_stats", "daily_label_stats", "top_label_long", "top_label_pivot", "MISSING_LABEL",
]
