"""Per-row statistics of list columns as higher-order functions, in staged projections.

No explode and no Python: every statistic is a ``transform`` / ``filter`` /
``aggregate`` over the row's own array, so the work is map-only and scales with
the row count whatever a group's size. Each helper adds columns in three steps
(value arrays; count, sum, extremes and mean; passes that need the mean or the
total), so an array is built once per row and the mean is a column, not an
expression re-evaluated for every element inside a lambda. Spark does not
collapse projections that would duplicate such non-trivial expressions.
Helper columns start with ``_``; the returned list names the output columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.functions.exprs import col, dlit, finite


def non_null_values(arr, field: str | None = None) -> Column:
    """Values of ``field`` (or the elements) cast to double, nulls and bad numbers dropped."""
    vals = doubles(arr, field)
    return F.coalesce(F.filter(vals, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.array().cast("array<double>"))


def doubles(arr, field: str | None = None) -> Column:
    """``field`` of all elements (or the elements) as doubles without a call for each element; what is no number is null."""
    a = col(arr)
    return (a[field] if field else a).try_cast("array<double>")


def array_sum(vals) -> Column:
    return F.aggregate(col(vals), dlit(0.0), lambda acc, v: acc + v)


def _sq_dev(vals: str, mean: str) -> Column:
    return F.aggregate(F.col(vals), dlit(0.0), lambda acc, x: acc + (x - F.col(mean)) * (x - F.col(mean)))


def _median_of_sorted(srt: str, n: str) -> Column:
    s, k = F.col(srt), F.col(n)
    mid = F.floor(k / 2).cast("int")
    even = (F.element_at(s, F.greatest(mid, F.lit(1))) + F.element_at(s, mid + 1)) / dlit(2.0)
    return F.when(k == 0, F.lit(None).cast("double")).when(k % 2 == 1, F.element_at(s, mid + 1)).otherwise(even)


def add_list_key_stats(df: DataFrame, items, keys: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """``{prefix}_row_n`` = list length, then mean / population std / min / max / sum per numeric key
    (null when the row has no value for the key)."""
    it = col(items)
    n_name = f"{prefix}_row_n"
    df = df.withColumns({n_name: F.coalesce(F.size(it), F.lit(0)).cast("double"),
                         **{f"_v_{k}": non_null_values(it, k) for k in keys}})
    step2 = {}
    for k in keys:
        v = F.col(f"_v_{k}")
        step2[f"_n_{k}"] = F.size(v)
        step2[f"_s_{k}"] = array_sum(v)
        step2[f"{prefix}_row_{k}_min"] = F.array_min(v).cast("double")
        step2[f"{prefix}_row_{k}_max"] = F.array_max(v).cast("double")
    df = df.withColumns(step2)
    df = df.withColumns({f"{prefix}_row_{k}_mean": F.when(F.col(f"_n_{k}") > 0, F.col(f"_s_{k}") / F.col(f"_n_{k}"))
                         for k in keys})
    step4 = {}
    for k in keys:
        has = F.col(f"_n_{k}") > 0
        step4[f"{prefix}_row_{k}_std"] = F.when(has, F.sqrt(_sq_dev(f"_v_{k}", f"{prefix}_row_{k}_mean")
                                                              / F.col(f"_n_{k}")))
        step4[f"{prefix}_row_{k}_sum"] = F.when(has, F.col(f"_s_{k}"))
    df = df.withColumns(step4)
    out = [n_name] + [f"{prefix}_row_{k}_{s}" for k in keys for s in ("mean", "std", "min", "max", "sum")]
    return df, out


def add_numeric_array_stats(df: DataFrame, arr, prefix: str = "hr") -> tuple[DataFrame, list[str]]:
    """N, sum, mean, population std, min, max, median; an empty list gives n = 0, sum = 0, rest null."""
    df = df.withColumn("_hv", non_null_values(arr))
    df = df.withColumns({"_hn": F.size("_hv"), f"{prefix}_sum": array_sum("_hv"), "_hs": F.sort_array("_hv")})
    has = F.col("_hn") > 0
    df = df.withColumns({
        f"{prefix}_n": F.col("_hn").cast("double"),
        f"{prefix}_mean": F.when(has, F.col(f"{prefix}_sum") / F.col("_hn")),
        f"{prefix}_min": F.when(has, F.array_min("_hv")),
        f"{prefix}_max": F.when(has, F.array_max("_hv")),
        f"{prefix}_median": F.when(has, _median_of_sorted("_hs", "_hn")),
    })
    df = df.withColumn(f"{prefix}_std", F.when(has, F.sqrt(_sq_dev("_hv", f"{prefix}_mean") / F.col("_hn"))))
    return df, [f"{prefix}_{s}" for s in ("n", "sum", "mean", "std", "min", "max", "median")]


def add_usage_stats(df: DataFrame, items, app_field: str = "app_name",
                    time_field: str = "total_time") -> tuple[DataFrame, list[str]]:
    """D10 per row: events, total time, max time (floor 0), distinct non-null apps; a bad time counts 0.0."""
    a = F.coalesce(col(items), F.array())
    df = df.withColumns({
        "_ut": F.transform(F.coalesce(doubles(items, time_field), F.array().cast("array<double>")), lambda v: F.coalesce(finite(v), dlit(0.0))),
        "usage_events": F.size(a).cast("double"),
        "usage_unique_apps": F.size(F.coalesce(F.array_distinct(F.filter(col(items)[app_field].cast("array<string>"), lambda v: v.isNotNull())),
                                               F.array().cast("array<string>"))).cast("double"),
    })
    df = df.withColumns({
        "usage_total_time": array_sum("_ut"),
        "usage_max_time": F.aggregate(F.col("_ut"), dlit(0.0), lambda acc, v: F.greatest(acc, v)),
    })
    return df, ["usage_events", "usage_total_time", "usage_max_time", "usage_unique_apps"]


def add_label_distribution_stats(df: DataFrame, items, label_field: str = "label", prob_field: str = "prob",
                                 eps: float = 1e-5, missing: str = "missing") -> tuple[DataFrame, list[str]]:
    """N, prob sum, top prob (first argmax), entropy of the normalised probs, top label.

    A prob that is not a number counts 0.0; prob sum <= 0 gives a null entropy;
    an empty list gives the label ``missing``.
    """
    a = F.coalesce(col(items), F.array())
    df = df.withColumns({"_la": a, "_lp": F.transform(F.coalesce(doubles(items, prob_field), F.array().cast("array<double>")),
                                                     lambda v: F.coalesce(finite(v), dlit(0.0)))})
    df = df.withColumns({"_ln": F.size("_lp"), "ambience_prob_sum": array_sum("_lp"), "_lmax": F.array_max("_lp")})
    has = F.col("_ln") > 0
    tot = F.col("ambience_prob_sum")
    entropy = -F.aggregate(F.col("_lp"), dlit(0.0), lambda acc, p: acc + F.try_divide(p, tot) * F.ln(
        F.least(F.greatest(F.try_divide(p, tot), dlit(eps)), dlit(1.0))))
    df = df.withColumns({
        "ambience_n": F.col("_ln").cast("double"),
        "ambience_top_prob": F.when(has, F.col("_lmax")),
        "ambience_entropy": F.when(has & (tot > 0), entropy),
        "ambience_top_label": F.when(has, F.element_at(F.col("_la"), F.array_position("_lp", F.col("_lmax"))
                                                      .cast("int"))[label_field].cast("string"))
                               .otherwise(F.lit(missing)),
    })
    return df, ["ambience_n", "ambience_prob_sum", "ambience_top_prob", "ambience_entropy", "ambience_top_label"]


def pairs_to_label_struct(arr) -> Column:
    """M7: ``array<array<string>>`` of [label, prob, ...] pairs to ``array<struct<label, prob>>``.

    Items with fewer than two elements are dropped; a prob that is not a number is kept
    as null (counted as 0.0 by the statistics).
    """
    a = F.coalesce(col(arr), F.array())
    kept = F.filter(a, lambda x: F.size(x) >= 2)
    return F.transform(kept, lambda x: F.struct(F.element_at(x, 1).alias("label"),
                                                F.element_at(x, 2).try_cast("double").alias("prob")))
