"""Stratified folds as a column, fold complements, class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrain.constants import N_SPLITS, SEED
from daygrain.functions.ranks import bucketed_row_number
from daygrain.operators.ranges import running_sums

HASH_BUCKET_CHARS = 3   # 4096 sub-buckets per (target, class)


def class_balance(labels: DataFrame, n_splits: int = N_SPLITS, target: str = "target", y: str = "y") -> DataFrame:
    """Per target the smallest class size and the fold count max(2, min(n_splits, min_class))."""
    per = labels.where(F.col(y).isNotNull()).groupBy(target, y).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(target).agg(
        F.min("n").alias("min_class"),
        F.count(F.lit(1)).alias("n_classes"),
        F.greatest(F.lit(2), F.least(F.lit(n_splits), F.min("n"))).cast("int").alias("n_folds"))


def fold_hash(key: str = "key", seed: int = SEED) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_folds(labels: DataFrame, n_splits: int = N_SPLITS, seed: int = SEED, key: str = "key",
                     target: str = "target", y: str = "y") -> DataFrame:
    """G1: (target, key, y, fold) with folds 1..k, stratified by class, sizes differing by <= 1.

    Rows of each (target, class) are shuffled by md5(key:seed) and dealt round-robin,
    the second class continuing where the first stopped. The row number is exact
    and computed in hash sub-buckets (no single-task window per class); class sizes
    and the fold count come from the same small per-bucket count table.
    """
    from pyspark.sql import Window
    lab = labels.where(F.col(y).isNotNull()).select(key, target, y).withColumn("_h", fold_hash(key, seed))
    numbered, counts = bucketed_row_number(lab, [target, y], [F.col("_h"), F.col(key)],
                                           F.substring("_h", 1, HASH_BUCKET_CHARS), "_rn", with_counts=True)
    per = counts.groupBy(target, y).agg(F.sum("_bn").alias("_n"))
    wlow = Window.partitionBy(target).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(target)
    # targets x classes rows: broadcast
    offs = per.select(target, y,
                      F.coalesce(F.sum("_n").over(wlow), F.lit(0)).alias("_off"),
                      F.greatest(F.lit(2), F.least(F.lit(n_splits), F.min("_n").over(wall))).alias("_k"))
    return (numbered.join(F.broadcast(offs), [target, y])
                    .select(target, key, y,
                            (F.pmod(F.col("_rn") - 1 + F.col("_off"), F.col("_k")) + 1).cast("int").alias("fold")))


def ordered_folds(labels: DataFrame, n_splits: int = N_SPLITS, order: str = "ord", key: str = "key", target: str = "target", y: str = "y",
                  ranges: int | None = None) -> DataFrame:
    """(target, key, y, ord, fold): folds 1..k of about equal size in the order of time, for training on earlier folds alone."""
    lab = labels.where(F.col(y).isNotNull()).select(target, key, y, F.col(order).alias("ord")).withColumn("one", F.lit(1))
    numbered = running_sums(lab, [target], ["ord", key], ["one"], ranges)
    sizes = lab.groupBy(target).agg(F.count("*").alias("_n"))  # one row a target
    return numbered.join(F.broadcast(sizes), target).select(
        target, key, y, "ord", (F.floor((F.col("one_upto") - 1) * n_splits / F.col("_n")) + 1).cast("int").alias("fold"))


def fold_history(folds: DataFrame, gap=0, target: str = "target") -> DataFrame:
    """C6 in time: for every fold vf, the rows whose position is below the fold's first by more than ``gap``."""
    first = folds.groupBy(target, F.col("fold").alias("vf")).agg(F.min("ord").alias("_first"))  # targets x folds rows
    return folds.join(F.broadcast(first), target).where(F.col("ord") < F.col("_first") - F.lit(gap)).drop("_first")


def fold_table(folds: DataFrame, target: str = "target") -> DataFrame:
    """Distinct (target, fold) pairs: at most targets x 10 rows."""
    return folds.select(target, F.col("fold").alias("vf")).distinct()


def fold_complement(folds: DataFrame, target: str = "target") -> DataFrame:
    """For every validation fold vf, the training rows (fold <> vf), all folds in one plan.

    The fold table is bounded by targets x n_splits rows, so the join is a
    broadcast; the output is at most (k - 1) x the labelled rows.
    """
    vf = fold_table(folds, target)
    return folds.join(F.broadcast(vf), (folds[target] == vf[target]) & (folds["fold"] != vf["vf"]), "inner") \
                .drop(vf[target])
