"""Daily roll-ups of scalar sensor series.

Grain: one row per (subject, day). All statistics of one sensor come from a
single ``groupBy`` with filtered aggregates (one shuffle, map-side partial
aggregation), so a hot subject-day is pre-aggregated in every map task before
anything crosses the network. The change count (D3) needs row order; it is
computed per (subject, day, time chunk) and stitched across chunks, so no task
ever holds more than one chunk of one subject-day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.constants import MERGE_KEYS, TIME_BINS
from daygrain.functions.exprs import date_key, dlit, safe_ratio, time_bin, tokens
from daygrain.operators import ranges as rg
from daygrain.operators.medians import add_medians, sketch
from daygrain.session import materialize

DAY_KEYS = MERGE_KEYS
#: More categories than this have no wide columns; see ``sparse.category_sparse``.
MAX_WIDE = 1000


def with_date_keys(df: DataFrame, ts: str = "timestamp", day_col: str = "lifelog_date") -> DataFrame:
    """B1/B2: day key, hour and time-of-day bin from the reading timestamp."""
    return df.withColumns({
        day_col: date_key(ts),
        "hour": F.hour(ts),
        "time_bin": time_bin(F.hour(ts)),
    })


# --- D1 ------------------------------------------------------------------------
def daily_stat_exprs(value: str, prefix: str, median: str = "exact") -> list[Column]:
    """count, mean, sample std, min, max, median, sum (sum of all-missing = 0)."""
    v = F.col(value).cast("double")
    med = F.median(v) if median == "exact" else F.percentile_approx(v, 0.5, 10000).cast("double")
    name = f"{prefix}_{value}"
    return [
        F.count(v).alias(f"{name}_count"),
        F.avg(v).alias(f"{name}_mean"),
        F.stddev_samp(v).alias(f"{name}_std"),
        F.min(v).alias(f"{name}_min"),
        F.max(v).alias(f"{name}_max"),
        med.alias(f"{name}_median"),
        F.coalesce(F.sum(v), dlit(0.0)).alias(f"{name}_sum"),
    ]


def daily_stats_aggregate(df: DataFrame, sensors: list[tuple[str, str, Column | None]], keys: list[str] = DAY_KEYS, extra: list[Column] = ()):
    """(aggregate, medians to add): D1 of all sensors in one grouped pass over ``df``, with a sketch for each median."""
    aggs, values = list(extra), {}
    for i, (value, prefix, condition) in enumerate(sensors):
        v = F.col(value).cast("double")
        v = v if condition is None else F.when(condition, v)
        name = f"{prefix}_{value}"
        there = (lambda c: c) if condition is None else (lambda c, of=condition: F.when(F.count_if(of) > 0, c))
        aggs += [there(F.count(v)).alias(f"{name}_count"), F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"{name}_std"),
                 F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), sketch(v).alias(f"_q{i}"),
                 there(F.coalesce(F.sum(v), dlit(0.0))).alias(f"{name}_sum")]
        values[f"{name}_median"] = (v, f"{name}_count", f"_q{i}")
    return df.groupBy(*keys).agg(*aggs), values


def daily_stats_table(df: DataFrame, sensors: list[tuple[str, str, Column | None]], keys: list[str] = DAY_KEYS, extra: list[Column] = ()) -> DataFrame:
    """D1 of several sensors of one table: (value column, prefix, condition of its readings or None), with exact medians.

    One aggregate, written once; its buffers are of bounded size whatever a day's number of readings (``medians``), and only days
    of more than ``HOT_ROWS`` readings are looked at again. A day without any reading of a sensor has null statistics.
    """
    whole, values = daily_stats_aggregate(df, sensors, keys, extra)
    stats = materialize(whole, as_table=True)
    names = [f"{p}_{v}_{s}" for v, p, _ in sensors for s in ("count", "mean", "std", "min", "max", "median", "sum")]
    others = [c for c in stats.columns if c not in names and c not in keys and not c.startswith("_q")]
    return add_medians(stats, df, list(keys), values).select(*keys, *names, *others)


# --- D2 ------------------------------------------------------------------------
def time_bin_exprs(value: str, prefix: str, bin_col: str = "time_bin", condition: Column | None = None) -> list[Column]:
    """Mean and sum per time-of-day bin; no rows in the bin -> null, rows but all null -> sum 0."""
    v = F.col(value).cast("double")
    out = []
    within = lambda b: F.col(bin_col) == b if condition is None else (F.col(bin_col) == b) & condition
    for b, _ in TIME_BINS:
        inside = within(b)
        out.append(F.avg(F.when(inside, v)).alias(f"{prefix}_{value}_by_time_mean_{b}"))
    for b, _ in TIME_BINS:
        inside = within(b)
        out.append(F.when(F.count_if(inside) > 0, F.coalesce(F.sum(F.when(inside, v)), dlit(0.0)))
                   .alias(f"{prefix}_{value}_by_time_sum_{b}"))
    return out


# --- D4 ------------------------------------------------------------------------
def category_exprs(cat: str, vocab: list, prefix: str) -> list[Column]:
    """Wide counts (0 filled) and ratios for an explicit vocabulary.

    A day whose categories are all missing gets null counts and ratios.
    """
    total = F.count(F.col(cat))
    counts, ratios = [], []
    for v, tok in zip(vocab, tokens(vocab, 24)):
        c = F.when(total > 0, F.count_if(F.col(cat) == F.lit(v)))
        counts.append(c.alias(f"{prefix}_{cat}_count_{tok}"))
        ratios.append(safe_ratio(c, total).alias(f"{prefix}_{cat}_ratio_{tok}"))
    return counts + ratios


def category_long(df: DataFrame, cat: str, keys: list[str] = DAY_KEYS) -> DataFrame:
    """D4 in long form: (keys, category, count, ratio) for categories present on the day.

    Map-side partial counts per (day, category), then the day total over that small
    aggregate; the raw rows are shuffled once, already combined.
    """
    per = (df.where(F.col(cat).isNotNull())
             .groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*keys)
    return per.select(*keys, F.col(cat).cast("string").alias("category"), "n",
                      safe_ratio(F.col("n"), F.sum("n").over(w)).alias("ratio"))


def category_vocabulary(df: DataFrame, cat: str, limit: int = MAX_WIDE) -> list:
    """Distinct non-null categories, sorted; one wide column each.

    ``limit`` bounds what reaches the driver: more categories than that raise
    (use ``sparse.category_sparse``, which has no limit) rather than silently losing columns.
    """
    q = df.where(F.col(cat).isNotNull()).select(cat).distinct().orderBy(cat).limit(limit + 1)
    vals = [r[0] for r in q.collect()]
    if len(vals) > limit:
        raise ValueError(f"{cat} has more than {limit} categories; use sparse.category_sparse")
    return vals


# --- D3 ------------------------------------------------------------------------
def daily_changes(df: DataFrame, values: list[str], prefix: str, keys: list[str] = DAY_KEYS,
                  ts: str = "timestamp", tie: str | None = "row_id", chunk: str = "hour") -> DataFrame:
    """Count of value changes inside a day, in timestamp order.

    The first reading of the day counts 1; a missing value never equals anything
    (missing next to missing counts 1). Rows are ordered inside (keys, chunk) with
    a window (chunk = ``date_trunc(chunk, ts)``), each chunk is reduced to
    (internal changes, first value, last value), and a window over the few chunk
    rows of a day adds the changes at chunk borders.
    """
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    ck = F.date_trunc(chunk, F.col(ts)).alias("_chunk")
    base = df.select(*keys, ts, *([tie] if tie else []), ck,
                     *[F.col(v).cast("double").alias(v) for v in values])
    w_in = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    first_in_chunk = F.row_number().over(w_in) == 1
    ends = {"_is_first": first_in_chunk, "_is_last": F.lead(F.lit(1)).over(w_in).isNull()}
    flags = {}
    for v in values:
        prev = F.lag(v).over(w_in)
        changed = F.col(v).isNull() | prev.isNull() | (F.col(v) != prev)
        flags[f"_c_{v}"] = F.when(first_in_chunk, F.lit(0)).when(changed, F.lit(1)).otherwise(F.lit(0))
    flagged = base.withColumns(ends | flags)
    # a chunk has one first and one last row; numbers alone are kept of them, so the aggregate needs no sort of its own
    chunks = flagged.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_c_{v}").alias(f"_n_{v}") for v in values],
        *[F.max(F.when(F.col("_is_first"), F.col(v))).alias(f"_first_{v}") for v in values],
        *[F.max(F.when(F.col("_is_last"), F.col(v))).alias(f"_last_{v}") for v in values],
    )
    w_ch = Window.partitionBy(*keys).orderBy("_chunk")
    is_first_chunk = F.row_number().over(w_ch) == 1
    border = {}
    for v in values:
        prev_last = F.lag(f"_last_{v}").over(w_ch)
        first = F.col(f"_first_{v}")
        border[f"_b_{v}"] = F.when(is_first_chunk | first.isNull() | prev_last.isNull() | (first != prev_last),
                                   F.lit(1)).otherwise(F.lit(0))
    return (chunks.withColumns(border)
                  .groupBy(*keys)
                  .agg(*[(F.sum(f"_n_{v}") + F.sum(f"_b_{v}")).cast("long").alias(f"{prefix}_{v}_changes")
                         for v in values]))


def changes_in_ranges(df: DataFrame, values: list[str], prefix: str, keys: list[str] = DAY_KEYS, ts: str = "timestamp",
                      tie: str | None = "row_id", ranges: int | None = None) -> DataFrame:
    """D3 over ranges of (keys, time): the same counts, with no window over a group or a clock unit of it.

    A range hands its last reading to the next, so a group may hold any share of all rows, at any rate.
    """
    order = [ts] + ([tie] if tie else [])
    base = df.select(*keys, *order, *[F.col(v).cast("double").alias(v) for v in values])
    rows = rg.with_borders(rg.in_ranges(base, keys, order, ranges), keys, order, 1)
    w = Window.partitionBy(rg.RANGE, *keys).orderBy(F.desc(rg.BORDER), *order)
    changed = {}
    for v in values:
        before = F.lag(v).over(w)
        changed[f"_c_{v}"] = F.when(F.col(v).isNull() | before.isNull() | (F.col(v) != before), 1).otherwise(0)
    return (rows.withColumns(changed).where(~F.col(rg.BORDER)).groupBy(*keys)
            .agg(*[F.sum(f"_c_{v}").cast("long").alias(f"{prefix}_{v}_changes") for v in values]))


# --- D1 + D2 + D3 + D4 in one plan -----------------------------------------------
def daily_numeric_features(df: DataFrame, values: list[str], prefix: str, *, keys: list[str] = DAY_KEYS,
                           add_changes: bool = False, categorical: str | None = None,
                           vocab: list | None = None, median: str = "exact",
                           ts: str = "timestamp", tie: str | None = "row_id", chunk: str = "hour") -> DataFrame:
    """All scalar-sensor daily features of one table: one grouped pass plus the change count."""
    df = with_date_keys(df, ts) if "lifelog_date" in keys and "lifelog_date" not in df.columns else df
    if categorical and vocab is None:
        vocab = category_vocabulary(df, categorical, limit=MAX_WIDE)
    extra = [e for v in values for e in time_bin_exprs(v, prefix)] + (category_exprs(categorical, vocab, prefix) if categorical else [])
    if median == "exact":
        out = daily_stats_table(df, [(v, prefix, None) for v in values], keys, extra)
    else:
        out = df.groupBy(*keys).agg(*[e for v in values for e in daily_stat_exprs(v, prefix, median)], *extra)
    if add_changes:
        ch = daily_changes(df, values, prefix, keys=keys, ts=ts, tie=tie, chunk=chunk)
        out = out.join(ch, list(keys), "left")
    return out
