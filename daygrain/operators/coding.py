"""Model rows: one row per key for all targets and folds, bin codes, and fold statistics by merging.

Every fit reads the same table: a key's features as an array, its labels, folds and roles as arrays by target, and a
byte code per feature (its bin). What a fit needs to know of its training rows is summed once per (target, fold, feature,
bin); the training side of a fold is the total less the fold's own part, so no fit counts or sorts its rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.functions.exprs import dlit, finite
from daygrain.session import materialize

MAX_BINS = 255
#: Quantiles come from a sketch of this relative accuracy.
SKETCH_ACCURACY = 10000


@dataclass
class Layout:
    """The bins of each feature, and where they lie in one flat histogram; a feature's last place holds its missing values.

    ``cuts`` part the bins (a value is in the bin after all cuts below it), ``values`` stand for them.
    """

    features: list[str]
    cuts: list[np.ndarray]
    values: list[np.ndarray]
    exact: np.ndarray

    def __post_init__(self):
        self.bins = np.array([len(v) for v in self.values], np.int64)
        self.offset = np.r_[0, np.cumsum(self.bins + 1)[:-1]].astype(np.int64) if len(self.bins) else np.zeros(0, np.int64)
        self.size = int((self.bins + 1).sum())
        self.feature = np.repeat(np.arange(len(self.bins)), self.bins + 1)
        self.first, self.last = self.offset[self.feature], (self.offset + self.bins)[self.feature]
        self.place = np.arange(self.size) - self.first
        self.is_value = np.arange(self.size) < self.last
        # the values as one table, features x places
        self.table = np.zeros((len(self.bins), int(self.bins.max(initial=0))))
        for own, v in zip(self.table, self.values):
            own[:len(v)] = v

    def code(self, x: np.ndarray) -> np.ndarray:
        """Rows x features to bytes; NaN is the code after the last bin."""
        out = np.empty(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.where(np.isnan(x[:, f]), self.bins[f], np.searchsorted(cuts, x[:, f], side="left"))
        return out


@dataclass
class FitTable:
    """``rows``: key, h (a hash of the key), x, codes, and y, fold, role as arrays by target (role 1: train, 2: predict, 0: neither)."""

    rows: DataFrame
    targets: list[str]
    layout: Layout
    key_type: str


def fit_table(matrix: DataFrame, labels: DataFrame, folds: DataFrame | None, features: list[str], max_bins: int = MAX_BINS) -> FitTable:
    """One row per key of ``labels`` (target, key, split, y), with the features of ``matrix`` and the folds (0 without any)."""
    rows = labels.select("target", "key", "split", F.col("y").cast("double").alias("y"))
    rows = rows.join(folds.select("target", "key", "fold"), ["target", "key"], "left") if folds is not None else \
        rows.withColumn("fold", F.lit(0))
    targets = [r[0] for r in rows.select("target").distinct().orderBy("target").collect()]
    role = F.when((F.col("split") == "train") & F.col("y").isNotNull(), 1).when(F.col("split") == "predict", 2).otherwise(0)
    one = F.struct(F.coalesce("y", dlit(0.0)).alias("y"), F.coalesce("fold", F.lit(0)).alias("fold"), role.alias("role"))
    none = F.struct(dlit(0.0).alias("y"), F.lit(0).alias("fold"), F.lit(0).alias("role"))
    said = rows.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("target") == t, one)), none).alias(f"t{i}") for i, t in enumerate(targets)])
    of = lambda name, kind: F.array(*[F.col(f"t{i}")[name].cast(kind) for i in range(len(targets))]).alias(name)
    x = F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in features]).cast("array<double>").alias("x")
    joined = materialize(said.select("key", F.xxhash64("key").alias("h"), of("y", "double"), of("fold", "int"), of("role", "int"))
                         .join(matrix.select("key", x), "key"), as_table=True)
    layout = bin_layout(joined.where(F.array_contains("role", 1)), features, max_bins)
    key_type = joined.schema["key"].dataType.simpleString()
    return FitTable(materialize(joined.withColumn("codes", _codes(F.col("x"), layout)), as_table=True), targets, layout, key_type)


def bin_layout(rows: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> Layout:
    """Bins of the feature array ``x``: a feature of at most ``max_bins`` values has one for each, others have quantiles.

    The driver sees at most ``max_bins`` numbers a feature.
    """
    if not 1 < max_bins <= MAX_BINS:
        raise ValueError(f"max_bins must be 2 to {MAX_BINS}")
    long = rows.select(F.posexplode("x").alias("i", "v")).where("v is not null")
    at = [q / max_bins for q in range(1, max_bins)]
    few = _few_values(long, max_bins)
    quantiles = long.groupBy("i").agg(F.percentile_approx("v", at, SKETCH_ACCURACY).alias("q"), F.max("v").alias("top"))
    got = {r["i"]: r for r in quantiles.join(few, "i", "left").collect()}
    cuts, values, exact = [], [], []
    for f in range(len(features)):
        r = got.get(f)
        if r is None:
            own, mid = np.zeros(1), np.zeros(0)
        elif r["values"] is not None:
            own = np.array(sorted(r["values"]))
            mid = own[:-1] / 2 + own[1:] / 2
        else:
            mid = np.unique(np.array(r["q"]))
            mid = mid[mid < r["top"]]
            own = np.r_[mid, r["top"]]
        cuts.append(mid)
        values.append(own)
        exact.append(r is None or r["values"] is not None)
    return Layout(list(features), cuts, values, np.array(exact, bool))


def _few_values(long: DataFrame, max_bins: int) -> DataFrame:
    """(i, values) of the features with at most ``max_bins`` distinct values; only theirs are collected."""
    counts = long.groupBy("i").agg(F.approx_count_distinct("v", 0.02).alias("about")).where(F.col("about") <= max_bins * 1.2)
    few = long.join(F.broadcast(counts.select("i")), "i", "left_semi").groupBy("i", "v").count()
    return (few.groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("values")).where(F.size("values") <= max_bins))


def _codes(x: Column, layout: Layout) -> Column:
    width = len(layout.features)

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        codes = layout.code(matrix_of(rows, width))
        return pa.array([r.tobytes() for r in codes], pa.binary())
    return run(x)


def matrix_of(rows: pa.Array, width: int) -> np.ndarray:
    """A list column as rows x width, missing values as NaN."""
    return rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)


# --- fold statistics ---------------------------------------------------------------------------------------------------
def fold_statistics(table: FitTable) -> DataFrame:
    """(target, vf, i, n, n_values, median, mean, std) of the training side of every fold ``vf`` (0: of all training rows).

    One pass sums counts, values and squares per (target, fold, feature, bin); every training side is the merge of the
    other folds. The median is exact: its bin and its rank there follow from the merged counts, and where a bin is not a single
    value, a second look at the rows of those bins alone (about 1 of ``max_bins`` rows) ranks them. ``mean`` and ``std`` (of the
    population) are those of the column with its missing values replaced by the median; null without any value.
    """
    layout, targets = table.layout, table.targets
    centre = np.array([float(np.median(v)) for v in layout.values])
    long = _long(table)
    x = F.col("v") - F.get(F.array(*[dlit(c) for c in centre]), F.col("i"))
    parts = materialize(long.groupBy("t", "fold", "i", "c").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")), as_table=True)
    # a fold's training side: the total less its own part; 0 stands for no fold
    vf = parts.select("t", F.col("fold").alias("vf")).distinct().union(parts.select("t", F.lit(0).alias("vf")).distinct()).distinct()
    side = parts.join(F.broadcast(vf), "t").where((F.col("fold") != F.col("vf")) | (F.col("vf") == 0))
    merged = side.groupBy("t", "vf", "i", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    bins = F.get(F.array(*[F.lit(int(b)) for b in layout.bins]), F.col("i"))
    value = F.col("c") < bins
    upto = F.sum(F.when(value, F.col("n")).otherwise(0)).over(Window.partitionBy("t", "vf", "i").orderBy("c"))
    all_values = F.sum(F.when(value, F.col("n")).otherwise(0)).over(Window.partitionBy("t", "vf", "i"))
    ranked = merged.withColumns({"upto": upto, "k": all_values, "is_value": value})
    totals = ranked.groupBy("t", "vf", "i").agg(
        F.sum("n").alias("n"), F.max("k").alias("k"), F.sum(F.when(value, F.col("s"))).alias("s"), F.sum(F.when(value, F.col("ss"))).alias("ss"))
    sought = F.explode(F.array(F.expr("(k + 1) div 2"), F.expr("k div 2 + 1"))).alias("rank")
    middle = (ranked.where(value).select("t", "vf", "i", "c", "n", "upto", sought)
              .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
              .select("t", "vf", "i", "c", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).distinct())
    middle = materialize(middle, as_table=True)  # at most two rows per (target, fold, feature)
    single = F.get(F.array(*[F.lit(bool(e)) for e in layout.exact]), F.col("i"))
    stands_for = F.get(F.get(F.array(*[F.array(*[dlit(v) for v in vs]) if e else F.array().cast("array<double>")
                                       for vs, e in zip(layout.values, layout.exact)]), F.col("i")), F.col("c"))
    known = middle.where(single).select("t", "vf", "i", stands_for.alias("v"))
    wide = middle.where(~single)
    near = (long.join(F.broadcast(wide.select("t", "i", "c").distinct()), ["t", "i", "c"])
            .groupBy("t", "fold", "i", "c", "v").agg(F.count("*").alias("n")))
    of_side = near.join(wide, ["t", "i", "c"]).where((F.col("fold") != F.col("vf")) | (F.col("vf") == 0))
    of_side = of_side.groupBy("t", "vf", "i", "c", "rank", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("t", "vf", "i", "c", "rank").orderBy("v"))
    found = of_side.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    median = known.unionByName(found.select("t", "vf", "i", "v")).groupBy("t", "vf", "i").agg(
        (dlit(0.5) * F.min("v") + dlit(0.5) * F.max("v")).alias("median"))
    at = F.get(F.array(*[dlit(c) for c in centre]), F.col("i"))
    n, gap = F.col("n").cast("double"), F.col("median") - at
    missing = n - F.col("k")
    mean = (F.col("s") + missing * gap) / n
    spread = (F.col("ss") + missing * gap * gap) / n - mean * mean
    name = F.get(F.array(*[F.lit(t) for t in targets]), F.col("t"))
    return totals.join(median, ["t", "vf", "i"], "left").select(
        name.alias("target"), "t", "vf", "i", "n", F.col("k").alias("n_values"), "median",
        (mean + at).alias("mean"), F.sqrt(F.greatest(spread, dlit(0.0))).alias("std"))


def fit_statistics_rows(table: FitTable) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """The fold statistics in arrays by (target, fold); NaN for a feature without values."""
    width = len(table.layout.features)
    out: dict = {}
    for r in fold_statistics(table).collect():
        of = out.setdefault((r["t"], r["vf"]), {k: np.full(width, np.nan) for k in ("median", "mean", "std")})
        for k in of:
            if r[k] is not None:
                of[k][r["i"]] = r[k]
    return out


def _long(table: FitTable) -> DataFrame:
    """(t, fold, i, v, c): every training value of every target."""
    width = len(table.layout.features)
    rows = table.rows.select(F.posexplode(F.arrays_zip("role", "fold")).alias("t", "of"), "x", "codes").where("of.role = 1")
    code = lambda i: F.conv(F.hex(F.substring("codes", i + 1, 1)), 16, 10).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(i.alias("i"), F.get("x", i).alias("v"), code(i).alias("c")))
    return rows.select("t", F.col("of.fold").alias("fold"), F.explode(cells).alias("z")).select("t", "fold", "z.*")


# --- blocks ------------------------------------------------------------------------------------------------------------
class Block:
    """Some rows of a fit table in arrays: codes (rows x features), y, fold, role (rows x targets), h, keys."""

    def __init__(self, codes: np.ndarray, h: np.ndarray, y: np.ndarray, fold: np.ndarray, role: np.ndarray, keys: pa.Array):
        self.codes, self.h, self.y, self.fold, self.role, self.keys = codes, h, y, fold, role, keys

    def training(self, target: int, fold: int) -> np.ndarray:
        return (self.role[:, target] == 1) & (self.fold[:, target] != fold if fold else True)


BLOCK_COLUMNS = ["key", "h", "y", "fold", "role", "codes"]


def block_of(table: pa.Table | pa.RecordBatch, n_targets: int, n_features: int) -> Block:
    column = {n: (table.column(n).combine_chunks() if isinstance(table, pa.Table) else table.column(n)) for n in BLOCK_COLUMNS}
    n = table.num_rows
    codes = np.frombuffer(b"".join(column["codes"].to_pylist()), np.uint8).reshape(n, n_features)
    arrays = [column[c].flatten().to_numpy(zero_copy_only=False).reshape(n, n_targets) for c in ("y", "fold", "role")]
    return Block(codes, column["h"].to_numpy(zero_copy_only=False).view(np.uint64), *arrays, column["key"])


def blocks(batches: Iterator[pa.RecordBatch], n_targets: int, n_features: int) -> Iterator[tuple[Block, pa.RecordBatch]]:
    for batch in batches:
        yield block_of(batch, n_targets, n_features), batch
