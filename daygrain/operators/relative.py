"""Per-subject window features over daily rows.

All windows share one ``partitionBy(subject).orderBy(date)`` specification, so
Spark sorts once and evaluates every rolling / lag column in a single Window
operator. Window partitions hold one subject's *daily* rows: their size is
bounded by the number of days, not by the raw sensor volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from daygrain.operators import ranges as rg
from daygrain.constants import (LAG_FEATURE_LIMIT, RELATIVE_EXCLUDED_PREFIXES, RELATIVE_FEATURE_LIMIT,
                                ROLL_WINDOWS)

RESERVED = {"subject_id", "sleep_date", "lifelog_date", "split"}


def sensor_columns(df: DataFrame, limit: int = RELATIVE_FEATURE_LIMIT, reserved=RESERVED,
                   excluded_prefixes=RELATIVE_EXCLUDED_PREFIXES) -> list[str]:
    """Numeric columns in plan order, minus reserved / calendar / relative ones, first ``limit``."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in reserved
            and not f.name.startswith(tuple(excluded_prefixes))]
    return cols[:limit]


def since_first(df: DataFrame, date: str, first: F.Column) -> F.Column:
    """Days since ``first``, or for an order that is a number the difference."""
    return F.col(date) - first if isinstance(df.schema[date].dataType, NumericType) else F.datediff(F.col(date), first)


def add_subject_relative_features(df: DataFrame, subject: str = "subject_id", date: str = "lifelog_date",
                                  relative_limit: int = RELATIVE_FEATURE_LIMIT,
                                  lag_limit: int = LAG_FEATURE_LIMIT, windows=ROLL_WINDOWS) -> DataFrame:
    """E1 days since first, E2 row order, E3 rolling means over 3 and 7 rows, E4 lag 1.

    For subjects whose rows are days; ``relative_in_ranges`` takes any number of rows a subject.
    """
    w = Window.partitionBy(subject).orderBy(date)
    sensors = sensor_columns(df, relative_limit)
    new = {
        "subject_days_since_first": since_first(df, date, F.min(date).over(Window.partitionBy(subject))),
        "subject_row_order": F.row_number().over(w) - 1,
    }
    return df.withColumns(new | _rolls_and_lags(w, sensors, lag_limit, windows))


def relative_in_ranges(df: DataFrame, subject: str, order: str, relative_limit: int = RELATIVE_FEATURE_LIMIT, lag_limit: int = LAG_FEATURE_LIMIT,
                       windows=ROLL_WINDOWS, ranges: int | None = None) -> DataFrame:
    """E1-E4 over ranges of (subject, order): a range gets the rows before it that its windows reach back to, and its row numbers and
    first value go on from the ranges before. ``order`` must be unique within a subject; null subjects are one."""
    sensors = sensor_columns(df, relative_limit, reserved=RESERVED | {subject, order})
    table = rg.in_ranges(df, [subject], [order], ranges)
    before = rg.offsets(table, [subject], order).withColumnsRenamed({rg.RANGE: "_of_range", subject: "_of_subject"})
    rows = rg.with_borders(table, [subject], [order], max(windows, default=2) - 1 or 1)
    w = Window.partitionBy(rg.RANGE, subject).orderBy(order)
    own = F.when(~F.col(rg.BORDER), F.col(order))
    new = {"_own_first": F.min(own).over(Window.partitionBy(rg.RANGE, subject)),
           "_own_order": F.count(own).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1}
    out = rows.withColumns(new | _rolls_and_lags(w, sensors, lag_limit, windows)).where(~F.col(rg.BORDER))
    on = F.col(rg.RANGE).eqNullSafe(F.col("_of_range")) & F.col(subject).eqNullSafe(F.col("_of_subject"))
    out = out.join(F.broadcast(before), on, "left").drop("_of_range", "_of_subject")
    return out.withColumns({
        "subject_days_since_first": since_first(df, order, F.coalesce("_first", "_own_first")),
        "subject_row_order": (F.coalesce("_before", F.lit(0)) + F.col("_own_order")).cast("long")}).drop(
        rg.RANGE, rg.BORDER, "_own_first", "_own_order", "_first", "_before")


def _rolls_and_lags(w, sensors: list[str], lag_limit: int, windows) -> dict:
    new = {}
    for n in windows:
        wf = w.rowsBetween(-(n - 1), Window.currentRow)
        for c in sensors:
            new[f"{c}_roll{n}_mean"] = F.avg(F.col(c).cast("double")).over(wf)
    for c in sensors[:lag_limit]:
        new[f"{c}_lag1"] = F.lag(F.col(c)).over(w)
    return new
