"""The (subject, day) spine, its joins and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from daygrain.constants import MERGE_KEYS
from daygrain.functions.exprs import dlit, first_number

TWO_PI = 2.0 * math.pi


def spine_union(train: DataFrame, predict: DataFrame, keys: list[str]) -> DataFrame:
    """train keys then predict keys, tagged; rows are identified by key, never by position."""
    return (train.select(*keys).withColumn("split", F.lit("train"))
                 .unionByName(predict.select(*keys).withColumn("split", F.lit("predict"))))


def add_calendar_features(df: DataFrame, life: str = "lifelog_date", sleep: str = "sleep_date",
                          subject: str = "subject_id") -> DataFrame:
    """B6a-e: weekday (Mon=0), day, month, day of year, ISO week, sleep weekday, weekend,
    cyclical encodings, sleep-life gap in days and the subject's first digit run."""
    dow = F.weekday(life)
    doy = F.dayofyear(life)
    return df.withColumns({
        "life_dayofweek": dow,
        "life_day": F.dayofmonth(life),
        "life_month": F.month(life),
        "life_dayofyear": doy,
        "life_weekofyear": F.weekofyear(life),
        "sleep_dayofweek": F.weekday(sleep),
        "is_weekend": dow.isin(5, 6).cast("int"),
        "life_dayofweek_sin": F.sin(dlit(TWO_PI) * dow / dlit(7.0)),
        "life_dayofweek_cos": F.cos(dlit(TWO_PI) * dow / dlit(7.0)),
        "life_dayofyear_sin": F.sin(dlit(TWO_PI) * doy / dlit(366.0)),
        "life_dayofyear_cos": F.cos(dlit(TWO_PI) * doy / dlit(366.0)),
        "sleep_gap_days": F.datediff(sleep, life),
        "subject_idx": first_number(subject),
    })


def join_daily(spine: DataFrame, tables: list[DataFrame], keys: list[str] = MERGE_KEYS) -> DataFrame:
    """Left equi-join chain; every right side is unique per key, so there is no fan-out.

    Each daily table leaves its aggregate hash-partitioned on ``keys``; Spark's
    sort-merge joins then reuse that partitioning (one exchange of the spine), and
    AQE turns small sides into broadcast joins at run time from measured sizes.
    """
    out = spine
    for t in tables:
        out = out.join(t, list(keys), "left")
    return out


def split_rejoin(features: DataFrame, spine: DataFrame, keys: list[str], split: str = "train") -> DataFrame:
    """The rows of one split, matched to their keys by join (guards against row-order misalignment)."""
    part = spine.where(F.col("split") == split).select(*keys)
    return part.join(features, list(keys), "inner")
