"""Exact medians of any number of groups of any size.

A quantile sketch of bounded size is kept per group. Up to ``HOT_ROWS`` rows it holds every value, so it gives the median itself.
For larger groups it gives an interval around the middle that holds about 0.2 % of the group's rows: these are counted in
``BUCKETS`` equal parts of the interval, and only the values of the parts that hold the middle ranks are ranked. No group's
values meet in one buffer, and equal values are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.functions.exprs import dlit

#: Share of a group's rows on each side of the middle that the interval covers, ten times the sketch's error.
MARGIN, ACCURACY = 1e-3, 10000
#: Half the size up to which the sketch merges nothing; at that size ``STEP`` is less than half a row.
HOT_ROWS, STEP = 4000, 1e-5
BUCKETS = 1024
#: Hot groups up to this number are broadcast.
FEW_GROUPS = 100_000


def sketch(v: Column) -> Column:
    """An aggregate: the interval's ends and, of a small group, the two middle values."""
    return F.percentile_approx(v, [0.5 - MARGIN, 0.5, 0.5 + STEP, 0.5 + MARGIN], ACCURACY)


def small_median(q: Column, n: Column) -> Column:
    return F.when(n <= HOT_ROWS, dlit(0.5) * q[1] + dlit(0.5) * q[2])


def large_medians(long: DataFrame, near: DataFrame, group: list[str], few: bool = False) -> DataFrame:
    """(group, median) of the groups of ``near`` (group, lo, hi), from ``long`` (group, v).

    The middle ranks must lie between ``lo`` and ``hi``. NaN is the largest value. ``few``: ``near`` is small enough to be broadcast.
    """
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    width = hi - lo
    part = F.floor((v - lo) / width * dlit(BUCKETS)).cast("int")
    inside = F.when(~F.isnan(v) & (width > 0) & (width < float("inf")), F.least(part, F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    bucket = F.when(v < lo, -1).when(v > hi, BUCKETS).otherwise(inside)
    rows = long.join(F.broadcast(near) if few else near, group).where("v is not null").withColumn("bucket", bucket)
    counts = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    middle = F.explode(F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")))).alias("rank")
    sought = (ranked.select(*group, "bucket", "n", "upto", middle).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
              .select(*group, "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    # at most two rows a group
    near_rows = rows.join(F.broadcast(sought) if few else sought, [*group, "bucket"]).groupBy(*group, "bucket", "rank", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group, "bucket", "rank").orderBy("v"))
    found = near_rows.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.groupBy(*group).agg((dlit(0.5) * F.min("v") + dlit(0.5) * F.max("v")).alias("median"))


def add_medians(stats: DataFrame, df: DataFrame, keys: list[str], values: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """``stats`` (a written table) with each output column's exact median.

    ``values``: output column to (value in ``df``, count column, sketch column of ``stats``).
    """
    out = stats.withColumns({name: small_median(F.col(q), F.col(n)) for name, (_, n, q) in values.items()})
    names = list(values)
    near = stats.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(n).alias("n"), F.col(q)[0].alias("lo"), F.col(q)[3].alias("hi"))
        for i, (_, n, q) in enumerate(values.values())])).alias("x")).select(*keys, "x.*").where(F.col("n") > HOT_ROWS).drop("n")
    hot = near.count()
    if not hot:
        return out
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v"))
                                                for i, (v, _, _) in enumerate(values.values())])).alias("x")).select(*keys, "x.*")
    found = large_medians(long, near, [*keys, "i"], few=hot <= FEW_GROUPS)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"_hot_{i}") for i in range(len(names))])
    out = out.join(wide, keys, "left")
    return out.withColumns({name: F.coalesce(f"_hot_{i}", name) for i, name in enumerate(names)}).drop(*[f"_hot_{i}" for i in range(len(names))])
