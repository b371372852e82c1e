"""From the wide feature table to a numeric model matrix.

Column sets that depend on data (subjects, all-missing columns) come from one
small aggregate each; the row data itself never leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from daygrain.functions.exprs import dlit, finite, unique_names
from daygrain.operators.medians import large_medians, sketch
from daygrain.operators.sparse import vocabulary_index
from daygrain.session import materialize

#: So many numbers of dense rows a task.
TASK_NUMBERS = 1 << 25


def numeric_columns(df: DataFrame, exclude: set[str] | list[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def null_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and +-Inf become null in every listed column (as doubles)."""
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})


def one_hot_array(df: DataFrame, col: str, out: str) -> DataFrame:
    """B8 as a dense vector column over the sorted vocabulary: zeros, a one at the value's place, zeros.

    The values' places are numbered inside ranges and joined, so no vocabulary goes with every row, and an array is filled as a whole instead
    of by a comparison an element. A row has as many numbers as the vocabulary has values (``sparse.one_hot_sparse`` has only the one), so the
    rows with their places, few bytes that Spark would leave in a task or two, are dealt to tasks by the numbers they grow to.
    """
    index = vocabulary_index(df, col)  # read for the places and counted
    n_values = index.count()
    size = F.lit(n_values).cast("int")
    found = materialize(df.join(index.select(F.col("value").alias("_value"), F.col("idx").cast("int").alias("_at")), F.col(col) == F.col("_value"), "left")
                        .drop("_value"), as_table=True)
    found = found.repartition(max(1, math.ceil(found.count() * n_values / TASK_NUMBERS)))
    zeros = lambda n: F.array_repeat(dlit(0.0), n)
    row = F.when(F.col("_at").isNull(), zeros(size)).otherwise(F.concat(zeros(F.col("_at")), F.array(dlit(1.0)), zeros(size - F.col("_at") - 1)))
    return found.withColumn(out, row).drop("_at")


def one_hot_columns(df: DataFrame, col: str, prefix: str | None = None, max_values: int = 10000) -> DataFrame:
    """B8 wide: one double dummy per distinct value (vocabulary collected, bounded by ``max_values``)."""
    prefix = prefix or col
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
            .limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} values; use sparse.one_hot_sparse")
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("double") for v in vals})


def non_null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """B9 input: (feature, n_non_null, n_rows) from one aggregate over ``df``, in long form."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], cols, "feature", "n_non_null")
    return long.select("feature", F.col("n_non_null").cast("long").alias("n_non_null"),
                       F.col("_rows").alias("n_rows"), (F.col("n_non_null") == 0).alias("all_missing"))


def drop_all_missing(train: DataFrame, others: list[DataFrame], cols: list[str]):
    """Drop from every frame the columns that are entirely null in ``train``."""
    counts = non_null_counts(train, cols).where("all_missing").select("feature").collect()
    gone = [r[0] for r in counts]
    return [train.drop(*gone)] + [o.drop(*gone) for o in others], gone


def rename_unique(df: DataFrame, keep: list[str]) -> DataFrame:
    """Safe, unique feature names (keys untouched)."""
    feats = [c for c in df.columns if c not in keep]
    names = unique_names(feats)
    return df.select(*keep, *[F.col(f"`{c}`").alias(n) for c, n in zip(feats, names)])


def exact_medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians ``<col>__med`` (null for columns without values); NaN is the largest value.

    A quantile sketch of bounded size gives each column an interval around its middle, whose parts are counted; only the
    values of the parts that hold the middle are ranked (``medians.large_medians``).
    """
    x = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    ends = x.agg(*[sketch(F.col(f"x{i}")).alias(f"r{i}") for i in range(len(cols))])
    near = ends.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"r{i}")[0].alias("lo"), F.col(f"r{i}")[3].alias("hi"))
                                           for i in range(len(cols))])).alias("s")).select("s.*")
    long = x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in range(len(cols))])).alias("s")).select("s.*")
    med = large_medians(long, near, ["i"], few=True)  # one row a column
    return med.agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"{c}__med") for i, c in enumerate(cols)])


def fit_median_scaler(train: DataFrame, cols: list[str], scale: bool = True) -> DataFrame:
    """B15 fit: exact medians, then mean and population std of the imputed training values.

    One-row results (3 x len(cols) numbers), broadcast by ``apply``.
    """
    med = exact_medians(train, cols)
    if not scale:
        return med
    imp = train.crossJoin(F.broadcast(med)).select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med")).alias(c) for c in cols])
    mom = imp.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])
    return med.crossJoin(mom)


def apply_median_scaler(df: DataFrame, params: DataFrame, cols: list[str], scale: bool = True) -> DataFrame:
    """B15 apply: impute medians; standardise (x - mean) / std with std 0 -> 1 (as scikit-learn)."""
    j = df.crossJoin(F.broadcast(params))
    out = {}
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med"))
        if scale:
            sd = F.col(f"{c}__std")
            x = (x - F.col(f"{c}__mean")) / F.when((sd == 0) | sd.isNull(), dlit(1.0)).otherwise(sd)
        out[c] = x
    return j.withColumns(out).drop(*[c for c in params.columns])
