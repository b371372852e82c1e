"""Model fits over one table of model rows.

Layout is long throughout: ``oof(target, key, fold, model, pred)``. ``coding.fit_table`` holds one row a key for all targets
and folds. The tree profiles are fitted by ``tree_jobs`` (all targets, folds and seeds together), the linear one
by MLlib, one small distributed fit a (target, fold), on values imputed and scaled by merged fold statistics. The driver
sees split choices, class counts and a few numbers a feature, never rows.
"""

from __future__ import annotations

import math
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daygrain.constants import FINAL_BAGGING_SEEDS, MODEL_NAMES, MODEL_PROFILES, QUICK_TREE_ESTIMATORS, SEED
from daygrain.functions.exprs import clip_proba, dlit, finite, sigmoid
from daygrain.operators.coding import FitTable, fit_statistics_rows, fit_table
from daygrain.operators.tree_jobs import TREE_COLUMNS, Spec, class_counts, constant_of, counts_of, fit_trees, score_many, tree_pred
from daygrain.session import materialize


#: So many numbers of the linear fit's rows a task.
LINEAR_CELLS = 1 << 22


def enabled_models(config: dict | None = None) -> list[str]:
    """Model families switched on in ``config`` (all by default), in reference order."""
    config = config or {}
    return [m for m in MODEL_NAMES if config.get(m, {}).get("enabled", True)]


def profile(name: str, quick: bool = False, overrides: dict | None = None) -> dict:
    """A model's sizes: the full ones, or the documented quick mode's tree count; ``overrides`` win."""
    p = dict(MODEL_PROFILES[name])
    if quick and "trees" in p:
        p["trees"] = QUICK_TREE_ESTIMATORS
    p.update(overrides or {})
    return p


def seed_dependent(prof: dict) -> bool:
    """Whether a fit changes with the seed (row or feature sampling, bootstrap)."""
    return prof["kind"] == "forest" or prof["kind"] == "boost" and (prof.get("row_share", 1.0) < 1.0 or prof.get("column_share", 1.0) < 1.0)


def model_input(matrix: DataFrame, labels: DataFrame, folds: DataFrame | None) -> FitTable:
    """The model rows of all fits: every column of ``matrix`` but its key is a feature."""
    return fit_table(matrix, labels, folds, [c for c in matrix.columns if c != "key"])


def _specs(data: FitTable, folds: dict[int, list[int]], models: list[str], profiles: dict, cv: bool, refit: bool, seed: int, seeds: list[int]) -> list[Spec]:
    """CV: every (target, fold, model), with seed + fold. Refits: every (target, model, seed); a profile without chance once."""
    out = []
    for t in range(len(data.targets)):
        for m in models:
            prof = tuple(sorted(profiles[m].items()))
            if cv:
                out += [Spec(0, m, t, f, seed + f, prof) for f in folds.get(t, [])]
            if refit:
                out += [Spec(0, m, t, 0, s, prof) for s in (seeds if seed_dependent(profiles[m]) else seeds[:1])]
    return [Spec(i, s.model, s.target, s.fold, s.seed, s.profile) for i, s in enumerate(out)]


def fit_all(data: FitTable, models: list[str], *, cv: bool = True, refit: bool = True, seed: int = SEED, seeds: list[int] = FINAL_BAGGING_SEEDS,
            quick: bool = False, workers: int = 8, insample: bool = False, importance_model: str = "lightgbm",
            profile_overrides: dict | None = None, **sizes) -> dict:
    """G4 + G10 + D19 (+ G14): ``oof``, ``predictions``, ``importance`` and the refitted ``models``.

    CV fits train on the other folds and score the held-out one; refits train on all training rows and score the prediction
    rows (and the training rows when ``insample``), averaged over seeds.
    """
    profiles = {m: profile(m, quick, (profile_overrides or {}).get(m)) for m in models}
    counts = class_counts(data)
    folds: dict[int, list[int]] = {}
    for t, f in sorted(counts):
        folds.setdefault(t, []).append(f)
    specs = _specs(data, folds, models, profiles, cv, refit, seed, seeds)
    statistics = fit_statistics_rows(data) if {p["kind"] for p in profiles.values()} & {"forest", "lr"} else {}
    trees = [s for s in specs if s.settings["kind"] != "lr"]
    linear = [s for s in specs if s.settings["kind"] == "lr"]
    scores, grown, fitted = [], None, []
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        waiting = [pool.submit(_fit_linear, data, s, counts, statistics.get((s.target, s.fold)), insample) for s in linear]
        if trees:
            codes = {k: _codes_of(data, v["median"]) for k, v in statistics.items()}
            found, grown = fit_trees(data, trees, codes, insample, **sizes)
            scores.append(found)
        for w in waiting:
            pred, params = w.result()
            scores.append(pred)
            fitted.append(params)
    named = data.rows.sparkSession.createDataFrame([(s.number, data.targets[s.target], s.model, s.fold, s.seed) for s in specs],
                                                   "spec int, target string, model string, fold int, seed int")
    pred = materialize(_union(scores).join(F.broadcast(named), "spec").withColumn("pred", clip_proba("pred")), as_table=True)
    out: dict = {}
    if cv:
        out["oof"] = pred.where("fold > 0").select("target", "key", "fold", "pred", "model")
    if refit:
        out["predictions"] = pred.where("fold = 0").groupBy("target", "key", "model").agg(clip_proba(F.avg("pred")).alias("pred"))
        of_refits = F.broadcast(named.where("fold = 0").select("spec", "target", "model", "seed"))
        empty = data.rows.sparkSession.createDataFrame([], f"target string, model string, seed int, tree int, {', '.join(f'{c} array<double>' for c in TREE_COLUMNS)}")
        saved = grown.join(of_refits, "spec").select("target", "model", "seed", "tree", *TREE_COLUMNS) if grown is not None else empty
        out["importance"] = feature_importance(_split_counts(saved.where(F.col("model") == importance_model), data.layout.features))
        out["models"] = {"trees": saved, "linear": [(data.targets[s.target], s.model, s.seed, p) for s, p in zip(linear, fitted) if not s.fold and p],
                         "specs": [(data.targets[s.target], s.model, s.seed, s.settings["kind"], int(s.settings.get("trees", 0)),
                                    constant_of(counts_of(s, counts))) for s in specs if not s.fold], "features": data.layout.features}
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _codes_of(data: FitTable, medians: np.ndarray) -> np.ndarray:
    """The bins of the medians (0 for a feature without values, which no split can use)."""
    return np.array([0 if np.isnan(m) else np.searchsorted(c, m, side="left") for m, c in zip(medians, data.layout.cuts)], np.int64)


# --- the linear profile ---------------------------------------------------------------------------------------------------
def _scaled(x: Column, params: dict) -> Column:
    """Missing values as medians, then less the mean over the population's deviation (0 as 1)."""
    lits = lambda a: F.array(*[dlit(v) for v in a])
    filled = F.zip_with(x, lits(params["median"]), lambda v, m: F.coalesce(v, m))
    centred = F.zip_with(filled, lits(params["mean"]), lambda v, m: v - m)
    return F.zip_with(centred, lits(params["std"]), lambda v, s: v / s)


def _linear_pred(x: Column, params: dict) -> Column:
    weights = F.array(*[dlit(c) for c in params["coefficients"]])
    return sigmoid(F.aggregate(F.zip_with(_scaled(x, params), weights, lambda v, c: v * c), dlit(params["intercept"]), lambda a, v: a + v))


def _fit_linear(data: FitTable, spec: Spec, counts: dict, statistics: dict | None, insample: bool) -> tuple[DataFrame, dict | None]:
    """One L2-regularised logistic fit over the training side's rows: (scores, parameters)."""
    sc = data.rows.sparkSession.sparkContext
    # a pool of its own: jobs of one pool run first in, first out, those of several pools take turns
    sc.setLocalProperty("spark.scheduler.pool", f"fit-{threading.get_ident()}")
    role, fold, y = (F.get(c, F.lit(spec.target)) for c in ("role", "fold", "y"))
    train = data.rows.where((role == 1) & (fold != spec.fold if spec.fold else F.lit(True)))
    wanted = (role == 1) & (fold == spec.fold) if spec.fold else (role > 0 if insample else role == 2)
    n = counts_of(spec, counts)
    constant = constant_of(n)
    if constant is not None:
        return data.rows.where(wanted).select(F.lit(spec.number).alias("spec"), "key", dlit(constant).alias("pred")), None
    prof = spec.settings
    params = {"median": np.nan_to_num(statistics["median"]), "mean": np.nan_to_num(statistics["mean"]),
              "std": np.where(np.nan_to_num(statistics["std"]) == 0, 1.0, np.nan_to_num(statistics["std"]))}
    # every step of the fit is a job over all rows: no more tasks than the numbers ask for
    rows = train.select(y.alias("label"), array_to_vector(_scaled(F.col("x"), params)).alias("features")) \
                .coalesce(max(1, math.ceil(int(n.sum()) * len(data.layout.features) / LINEAR_CELLS)))
    model = LogisticRegression(regParam=1.0 / (float(prof["C"]) * int(n.sum())), elasticNetParam=0.0, standardization=False,
                               maxIter=int(prof["max_iter"])).fit(rows)
    params = {k: [float(v) for v in a] for k, a in params.items()} | {"coefficients": [float(c) for c in model.coefficients], "intercept": float(model.intercept)}
    return data.rows.where(wanted).select(F.lit(spec.number).alias("spec"), "key", _linear_pred(F.col("x"), params).alias("pred")), params


# --- single fits and tables of them ------------------------------------------------------------------------------------------
def fit_predict(name: str, train: DataFrame, pred_rows: DataFrame, features: list[str], seed: int, prof: dict, keys: list[str]) -> tuple[DataFrame, object]:
    """Fit one model on ``train`` (label, features) and score ``pred_rows``; a single-class training set gives a constant (D20) and no model."""
    rows = [train.select(F.struct(F.lit(0).alias("side"), F.monotonically_increasing_id().alias("n")).alias("key"), F.col("label").alias("y"),
                         F.lit("train").alias("split"), *features),
            pred_rows.select(F.struct(F.lit(1).alias("side"), F.monotonically_increasing_id().alias("n")).alias("key"),
                             F.lit(None).cast("double").alias("y"), F.lit("predict").alias("split"), *features, *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)])]
    both = materialize(rows[0].unionByName(rows[1], allowMissingColumns=True), as_table=True)
    labels = both.select(F.lit("t").alias("target"), F.to_json("key").alias("key"), "split", "y")
    out = fit_all(model_input(both.select(F.to_json("key").alias("key"), *features), labels, None), [name], cv=False, seeds=[seed],
                  profile_overrides={name: prof})
    pred = out["predictions"].select(F.col("key").alias("_key"), "pred")
    own = both.where("split = 'predict'").select(F.to_json("key").alias("_key"), *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)])
    single = out["models"]["specs"][0][-1] is not None
    return own.join(pred, "_key").drop("_key"), None if single else out["models"]


def cross_validated_oof(matrix: DataFrame, folds: DataFrame, features: list[str], models: list[str], *,
                        seed: int = SEED, quick: bool = False, workers: int = 8,
                        profile_overrides: dict | None = None) -> DataFrame:
    """Out-of-fold predictions of every (target, fold, model); fold seed = seed + fold."""
    labels = folds.select("target", "key", "y").withColumn("split", F.lit("train"))
    data = model_input(matrix.select("key", *features), labels, folds)
    return fit_all(data, models, refit=False, seed=seed, quick=quick, workers=workers, profile_overrides=profile_overrides)["oof"]


def refit_predict(matrix: DataFrame, labels: DataFrame, features: list[str], models: list[str], *,
                  seeds: list[int] = FINAL_BAGGING_SEEDS, quick: bool = False, workers: int = 8,
                  insample: bool = False, importance_model: str = "lightgbm",
                  profile_overrides: dict | None = None) -> dict:
    """G10 + D19 (+ G14): seed-bagged refits on all training rows."""
    data = model_input(matrix.select("key", *features), labels, None)
    return fit_all(data, models, cv=False, seeds=seeds, quick=quick, workers=workers, insample=insample, importance_model=importance_model,
                   profile_overrides=profile_overrides)


def _split_counts(trees: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): how many splits of the trees use each feature."""
    counts = trees.select(F.explode("feature").alias("i")).where("i >= 0").groupBy("i").count()
    names = trees.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    return names.join(counts, "i", "left").select("feature", F.coalesce("count", F.lit(0)).cast("double").alias("importance"))


def feature_importance(rows: DataFrame) -> DataFrame:
    """Importance summed over targets and seeds, ranked descending."""
    return rows.groupBy("feature").agg(F.sum("importance").alias("importance")) \
               .orderBy(F.desc("importance"), F.asc("feature"))


# --- A9: fitted models ------------------------------------------------------------------------
def save_models(spark: SparkSession, path: str, models: dict, single_class: DataFrame) -> None:
    """The refitted trees, the linear parameters by feature, and an index of all (target, model, seed).

    A fit on a single class has no model; the index holds its constant.
    """
    models["trees"].write.mode("overwrite").partitionBy("model").parquet(f"{path}/fitted_trees")
    linear = [(t, m, s, i, f, p["median"][i], p["mean"][i], p["std"][i], p["coefficients"][i], p["intercept"])
              for t, m, s, p in models["linear"] for i, f in enumerate(models["features"])]
    spark.createDataFrame(linear, "target string, model string, seed int, position int, feature string, median double, mean double, std double, "
                          "coefficient double, intercept double").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted_linear")
    index = spark.createDataFrame(models["specs"], "target string, model string, seed int, kind string, trees int, constant double")
    index = index.join(F.broadcast(single_class.withColumnRenamed("constant", "single")), "target", "left")
    index.withColumn("constant", F.coalesce("constant", "single")).drop("single").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted_index")
    spark.createDataFrame(list(enumerate(models["features"])), "position int, feature string") \
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted_features")


def single_class_targets(labels: DataFrame) -> DataFrame:
    """(target, constant) of targets whose training rows have at most one class; without any row 0.5."""
    train = labels.where(F.col("split") == "train")
    known = train.groupBy("target").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = hi or lo is null")
    none = labels.select("target").distinct().join(train.select("target").distinct(), "target", "left_anti")
    return known.select("target", F.coalesce(F.col("lo").cast("double"), dlit(0.5)).alias("constant")) \
                .unionByName(none.withColumn("constant", dlit(0.5)))


def score_saved(spark: SparkSession, path: str, matrix: DataFrame) -> DataFrame:
    """(target, key, model, pred) of any rows with the saved features, averaged over seeds as in the refits; no fit.

    The index has targets x models x seeds rows. The rows are written once, dealt to as many tasks as a shuffle has.
    """
    features = [r["feature"] for r in spark.read.parquet(f"{path}/fitted_features").orderBy("position").collect()]
    index = spark.read.parquet(f"{path}/fitted_index").orderBy("target", "model", "seed").collect()
    named = spark.createDataFrame([(i, r["target"], r["model"], r["seed"], r["kind"], r["trees"]) for i, r in enumerate(index)],
                                  "spec int, target string, model string, seed int, kind string, n_trees int")
    x = F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in features]).alias("x")
    rows = materialize(matrix.select("key", x).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), as_table=True)
    parts = []
    for r in index:
        mine = (F.col("target") == r["target"]) & (F.col("model") == r["model"]) & (F.col("seed") == r["seed"])
        if r["constant"] is not None:
            pred = clip_proba(dlit(r["constant"]))
        elif r["kind"] == "lr":
            own = spark.read.parquet(f"{path}/fitted_linear").where(mine).orderBy("position").collect()
            params = {k: [o[k] for o in own] for k in ("median", "mean", "std")}
            params |= {"coefficients": [o["coefficient"] for o in own], "intercept": own[0]["intercept"]}
            pred = clip_proba(_linear_pred(F.col("x"), params))
        else:
            continue
        parts.append(rows.select(F.lit(r["target"]).alias("target"), "key", F.lit(r["model"]).alias("model"), pred.alias("pred")))
    grown = [i for i, r in enumerate(index) if r["constant"] is None and r["kind"] != "lr"]
    if grown:
        trees = spark.read.parquet(f"{path}/fitted_trees").join(F.broadcast(named.where(F.col("spec").isin(grown))), ["target", "model", "seed"])
        totals = score_many(rows, trees.select("spec", "tree", *TREE_COLUMNS), len(features)).join(F.broadcast(named), "spec")
        parts.append(totals.select("target", "key", "model", tree_pred(F.col("total"), F.col("kind"), F.col("n_trees")).alias("pred")))
    return _union(parts).groupBy("target", "key", "model").agg(clip_proba(F.avg("pred")).alias("pred"))
