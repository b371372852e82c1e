"""Row order without a window per group (D3, E1-E4, vocabulary ranks).

Rows are range-partitioned by (group, order) into ranges of about equal size and written once, so the ranges stay what they are. Windows run
inside a (range, group); a group that goes on in the next range hands it its last rows, and sums that go on are added as offsets. Of each
range, only the last rows of one group and a few counts are passed on, so a group that holds a third of all rows is as many tasks as its ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from daygrain.session import materialize

RANGE, BORDER = "_range", "_border"


def in_ranges(df: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` written with ``_range``: rows of a range come, by (group, order), before those of the next."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id()), as_table=True)


def _open_groups(table: DataFrame, group: list[str]) -> DataFrame:
    """(range, group): the last group of each range, the only one that can go on in the next; one row a range."""
    return table.groupBy(RANGE).agg(F.max(F.struct(*group)).alias("g")).select(RANGE, *[F.col(f"g.{c}").alias(c) for c in group])


def _only(table: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of ``table`` whose columns are those of a row of ``few`` (nulls are equal), which is broadcast."""
    few = few.withColumnsRenamed({c: f"_few_{c}" for c in few.columns})
    on = F.lit(True)
    for c in few.columns:
        on = on & F.col(c.removeprefix("_few_")).eqNullSafe(F.col(c))
    return table.join(F.broadcast(few), on, "left_semi")


def with_borders(table: DataFrame, group: list[str], order: list[str], back: int) -> DataFrame:
    """``table`` and, marked ``_border``, the ``back`` rows of its first group that come before each range."""
    own = _only(table, _open_groups(table, group))  # one row a range
    by = [F.col(c).desc() for c in order]
    tails = own.withColumn("_n", F.row_number().over(Window.partitionBy(RANGE).orderBy(*by))).where(F.col("_n") <= back)
    # of the few tail rows of a group, each range's last one looks back over those before it, in earlier ranges too
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(back - 1), 0)
    before = tails.withColumn("_rows", F.collect_list(row).over(w)).where("_n = 1")
    handed = before.select((F.col(RANGE) + 1).alias("_to"), F.explode("_rows").alias("_row")).select("_to", "_row.*")
    handed = handed.withColumn(RANGE, F.col("_to")).drop("_to").select(*table.columns, F.lit(True).alias(BORDER))
    return table.withColumn(BORDER, F.lit(False)).unionByName(handed)


def offsets(table: DataFrame, group: list[str], first: str | None = None) -> DataFrame:
    """(range, group, _before, _first): rows of a range's first group in earlier ranges, and its first ``first``; at most two rows a range."""
    spans = _only(table, _open_groups(table, group).select(*group).distinct()).groupBy(RANGE, *group).agg(
        F.count("*").alias("_n"), *([F.min(first).alias("_first")] if first else []))
    w = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return spans.select(RANGE, *group, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                        *([F.min("_first").over(Window.partitionBy(*group)).alias("_first")] if first else []))


def running_sums(df: DataFrame, group: list[str], order: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``<value>_upto``: the sums over the group's rows up to and with this one, by ``order``."""
    table = in_ranges(df, group, order, ranges)
    # of the groups that go on from range to range, each range's sums: at most two rows a range
    parts = _only(table, _open_groups(table, group).select(*group).distinct()).groupBy(RANGE, *group).agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col(RANGE).alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group],
                          *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_before_{v}") for v in values])
    on = F.col(RANGE) == F.col("_of")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumns({f"{v}_upto": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(F.broadcast(before), on, "left")
    return out.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.coalesce(f"_before_{v}", F.lit(0)) for v in values}).drop(
        RANGE, "_of", *[f"_of_{c}" for c in group], *[f"_before_{v}" for v in values])


def global_rank(df: DataFrame, order: list[str], out: str = "idx", ranges: int | None = None) -> DataFrame:
    """``df`` with its 0-based position by ``order``, numbered inside ranges."""
    table = in_ranges(df, [], order, ranges)
    counts = table.groupBy(RANGE).agg(F.count("*").alias("_n"))  # one row a range
    before = counts.select(RANGE, F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = table.withColumn("_in", F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)))
    return numbered.join(F.broadcast(before), RANGE).withColumn(out, F.col("_before") + F.col("_in") - 1).drop(RANGE, "_before", "_in")
