"""Binary log-loss per group and its macro average."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrain.functions.exprs import log_loss_term


def logloss(df: DataFrame, groups: list[str], y: str = "y", p: str = "pred", out: str = "logloss") -> DataFrame:
    """Mean of -(y ln p + (1 - y) ln(1 - p)) per group, p clipped to [eps, 1 - eps] first."""
    return df.groupBy(*groups).agg(F.avg(log_loss_term(y, p)).alias(out))


def macro_average(per_target: DataFrame, by: list[str] | None = None, col: str = "logloss",
                  out: str = "average_logloss") -> DataFrame:
    by = by or []
    return per_target.groupBy(*by).agg(F.avg(col).alias(out))
