"""D4 and B8 without a limit: vocabularies numbered by a distributed rank, rows as sparse vectors.

A sparse row is (size, indices, values): only its non-zeros, by ascending index, whatever the vocabulary's size. Neither
the vocabulary nor a dense row reaches the driver; an index is found by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrain.functions.exprs import dlit
from daygrain.operators.daily import DAY_KEYS, category_long
from daygrain.operators.ranges import global_rank
from daygrain.session import materialize


def vocabulary_index(df: DataFrame, col: str) -> DataFrame:
    """(value, idx): the distinct non-null values of a column with their 0-based positions in sorted order."""
    values = df.select(F.col(col).alias("value")).where("value is not null").distinct()
    return materialize(global_rank(values, ["value"]), as_table=True)


def one_hot_sparse(df: DataFrame, col: str, out: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``out`` as a sparse row with a 1 at the value's index; none for null and for values outside the vocabulary."""
    index = vocabulary if vocabulary is not None else vocabulary_index(df, col)
    size = F.lit(index.count()).cast("long")
    found = df.join(index.withColumnRenamed("value", "_value").withColumnRenamed("idx", "_idx"), F.col(col) == F.col("_value"), "left")
    there = F.col("_idx").isNotNull()
    row = F.struct(size.alias("size"), F.when(there, F.array("_idx")).otherwise(F.array().cast("array<long>")).alias("indices"),
                   F.when(there, F.array(dlit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    return found.withColumn(out, row).drop("_value", "_idx")


def category_sparse(df: DataFrame, cat: str, keys: list[str] = DAY_KEYS, vocabulary: DataFrame | None = None) -> DataFrame:
    """D4 wide: (keys, size, indices, counts, ratios), a day's categories by index. A day without any category is not there.

    A row holds the categories of its day; the counts are partially aggregated before they meet.
    """
    long = category_long(df, cat, keys)
    index = vocabulary if vocabulary is not None else vocabulary_index(df.select(F.col(cat).cast("string").alias(cat)), cat)
    size = F.lit(index.count()).cast("long")
    cells = long.join(index.withColumnRenamed("value", "category"), "category").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("idx", "n", "ratio"))).alias("_cells"))
    return cells.select(*keys, size.alias("size"), F.col("_cells.idx").alias("indices"), F.col("_cells.n").alias("counts"), F.col("_cells.ratio").alias("ratios"))


def dense(row, size: int):
    """A sparse row's (indices, values) as an array of ``size`` doubles, for small vocabularies."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(
        F.get(row["values"], F.array_position(row["indices"], i.cast("long")).cast("int") - 1), dlit(0.0)))
