"""Blending, alpha and calibration grid searches, final blend, report.

A search is the mean of one vector of losses a row (``_grid_losses``), combined in the map tasks: rows are never
multiplied by the grid, and each map task sends one row a group. The argmin is a window over at most grid-size rows per (target, ...).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from daygrain.constants import (ALPHA_GRID, EPS, FALLBACK_ALPHA, MODEL_BLEND_POWER, SHRINK_GRID,
                                TEMPERATURE_GRID, WEAK_MODEL_LOSS_RATIO, linspace)
from daygrain.functions.exprs import clip_proba, dlit, log_loss_term, logit, sigmoid
from daygrain.operators.metrics import macro_average
from daygrain.session import materialize

LOSS_DIGITS = 12   # losses equal to 12 places count as ties, broken by grid order (first wins)


# --- G5 ------------------------------------------------------------------------------
def model_scores(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(target, *by, model, score): log-loss of each model's out-of-fold predictions."""
    by = by or []
    return oof.groupBy("target", *by, "model").agg(F.avg(log_loss_term("y", "pred")).alias("score"))


def blend_weights(scores: DataFrame, power=MODEL_BLEND_POWER, ratio=WEAK_MODEL_LOSS_RATIO,
                  by: list[str] | None = None) -> DataFrame:
    """Keep models with score <= best * ratio, weight them by 1 / max(score, eps)^power, normalise.

    ``power`` / ``ratio`` are numbers or column names (per-trial parameters).
    """
    by = by or []
    pw = F.col(power) if isinstance(power, str) else dlit(power)
    rt = F.col(ratio) if isinstance(ratio, str) else dlit(ratio)
    w = Window.partitionBy("target", *by)
    best = F.min("score").over(w)
    near = F.col("score") <= best * rt
    kept = near | ~F.max(near).over(w)  # with a ratio below 1 none is near: all stay
    inv = F.when(kept, dlit(1.0) / F.pow(F.greatest(F.col("score"), dlit(EPS)), pw)).otherwise(dlit(0.0))
    with_inv = scores.withColumn("_inv", inv)
    return with_inv.withColumn("weight", F.col("_inv") / F.sum("_inv").over(w)).drop("_inv")


def blend_pred(oof: DataFrame, weights: DataFrame, by: list[str] | None = None, clip: bool = True,
               keys: list[str] | None = None) -> DataFrame:
    """(target, *by, key, ..., model_pred) = clip(sum_m w_m * pred_m).

    ``weights`` has at most targets x models (x trials) rows and is broadcast.
    """
    by = by or []
    keys = keys or ["key"]
    wt = weights.select("target", *by, "model", "weight")
    on = ["target", "model"] + [b for b in by if b in oof.columns]
    j = oof.join(F.broadcast(wt), on)
    s = F.sum(F.col("weight") * F.col("pred"))
    out = j.groupBy("target", *by, *keys).agg((clip_proba(s) if clip else s).alias("model_pred"))
    return out


# --- grids -----------------------------------------------------------------------------
def alpha_values() -> list[float]:
    return linspace(*ALPHA_GRID)


def calibration_grid_rows() -> list[tuple]:
    """(grid_order, method, value): none, then shrink values, then temperatures (order = preference)."""
    rows = [(0, "none", None)]
    rows += [(i + 1, "mean_shrink", v) for i, v in enumerate(linspace(*SHRINK_GRID))]
    n = len(rows)
    rows += [(n + i, "temperature", v) for i, v in enumerate(linspace(*TEMPERATURE_GRID))]
    return rows


def _argmin(df: DataFrame, groups: list[str], loss: str = "loss") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.round(F.col(loss), LOSS_DIGITS), F.col("grid_order"))
    return df.withColumn("chosen", F.row_number().over(w) == 1)


def blend_with_prior(model_pred, prior, alpha) -> F.Column:
    return clip_proba(alpha * model_pred + (dlit(1.0) - alpha) * prior)


def chosen_alpha(alphas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The chosen alpha as the reference keeps it: the value of its two-decimal key (0.35, not 0.35000000000000003)."""
    by = by or []
    return alphas.where("chosen").select("target", *by, F.col("alpha_key").cast("double").alias("alpha"))


def _grid_losses(rows: DataFrame, groups: list[str], schema: str, entries: list[tuple], loss) -> DataFrame:
    """(groups, the entry's columns, loss): the mean of each row's vector of losses, ``loss`` (entry) being one of them."""
    spark = rows.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    literal = F.array(*[F.struct(*[F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(e, schema.split(", "))]) for e in entries])
    vectors = rows.select(*groups, array_to_vector(F.transform(literal, loss)).alias("_v"))
    means = vectors.groupBy(*groups).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"))
    cells = means.select(*groups, F.posexplode("_m").alias("_i", "loss"))
    grid = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], f"_i int, {schema}")
    return cells.join(F.broadcast(grid), "_i").select(*groups, *names, "loss")


# --- G6 --------------------------------------------------------------------------------
def alpha_search(spark: SparkSession, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(target, *by, grid_order, alpha, alpha_key, loss, chosen) over rows (y, model_pred, prior)."""
    by = by or []
    entries = [(i, float(a), f"{a:.2f}") for i, a in enumerate(alpha_values())]
    loss = lambda e: log_loss_term(F.col("y"), blend_with_prior(F.col("model_pred"), F.col("prior"), e["alpha"]))
    return _argmin(_grid_losses(rows, ["target", *by], "grid_order int, alpha double, alpha_key string", entries, loss), ["target", *by])


# --- G7 / G8 ------------------------------------------------------------------------------
def calibrate(pred, method, value, target_mean) -> F.Column:
    """Apply one calibration: none -> clip; mean_shrink; temperature around the mean logit."""
    p = clip_proba(pred)
    shrink = clip_proba((dlit(1.0) - value) * pred + value * target_mean)
    ml = logit(target_mean)
    temp = clip_proba(sigmoid(ml + value * (logit(pred) - ml)))
    return (F.when(method == "mean_shrink", shrink)
             .when(method == "temperature", temp)
             .otherwise(p))


def calibration_search(spark: SparkSession, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(target, *by, grid_order, method, value, target_mean, loss, chosen) over rows (y, final_pred)."""
    by = by or []
    tm = rows.groupBy("target", *by).agg(F.avg(F.col("y").cast("double")).alias("target_mean"))
    # each row's logits once; every entry is then a few operations on them
    x = rows.join(F.broadcast(tm), ["target", *by]).withColumns({"_ml": logit("target_mean"), "_gap": logit("final_pred") - logit("target_mean")})

    def loss(e):
        shrunk = (dlit(1.0) - e["value"]) * F.col("final_pred") + e["value"] * F.col("target_mean")
        cand = F.when(e["method"] == "mean_shrink", shrunk).when(e["method"] == "temperature", sigmoid(F.col("_ml") + e["value"] * F.col("_gap"))) \
                .otherwise(F.col("final_pred"))
        return log_loss_term(F.col("y"), clip_proba(cand))
    found = _grid_losses(x, ["target", *by, "target_mean"], "grid_order int, method string, value double", calibration_grid_rows(), loss)
    return _argmin(found, ["target", *by]).select("target", *by, "grid_order", "method", "value", "target_mean", "loss", "chosen")


def apply_calibration(rows: DataFrame, chosen: DataFrame, pred: str = "final_pred",
                      by: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Join the chosen (method, value, target_mean) per target and apply it."""
    by = by or []
    if not enabled:
        return rows.withColumn("calibrated", clip_proba(pred))
    c = chosen.where("chosen").select("target", *by, "method", "value", "target_mean")
    return (rows.join(F.broadcast(c), ["target", *by])
                .withColumn("calibrated", calibrate(F.col(pred), F.col("method"), F.col("value"),
                                                    F.col("target_mean"))))


# --- D21 ---------------------------------------------------------------------------------
def seed_bagging(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over seeds of each (keys) prediction, then clipped."""
    return preds.groupBy(*keys).agg(clip_proba(F.avg("pred")).alias("pred"))


# --- CV tuning end to end (G5 -> G6 -> G7 -> G8) ------------------------------------------------
def tune(spark: SparkSession, oof: DataFrame, prior: DataFrame, *, power=MODEL_BLEND_POWER,
         ratio=WEAK_MODEL_LOSS_RATIO, by: list[str] | None = None, postprocess: bool = True,
         checkpoint: bool = True, weights: DataFrame | None = None, scores: DataFrame | None = None) -> dict:
    """Tune weights, alpha and calibration on out-of-fold rows.

    ``oof``: (target, *by, key, y, model, pred); ``prior``: (target, *by, key, prior).
    Returns DataFrames: scores, weights, model_pred, alphas, calibration, final.
    """
    by = by or []
    if weights is None:
        scores = model_scores(oof, by)
        weights = blend_weights(scores, power, ratio, by)
    mp = blend_pred(oof, weights, by, keys=["key", "y"])
    # the tuning rows are scanned by every grid below: materialise them once
    rows = materialize(mp.join(prior, ["target", *by, "key"])) if checkpoint else mp.join(prior, ["target", *by, "key"])
    alphas = alpha_search(spark, rows, by)
    best = chosen_alpha(alphas, by)
    final = (rows.join(F.broadcast(best), ["target", *by])
                 .withColumn("final_pred", blend_with_prior(F.col("model_pred"), F.col("prior"), F.col("alpha"))))
    if postprocess:
        cal = calibration_search(spark, final, by)
    else:
        cal = (final.groupBy("target", *by).agg(F.avg(F.col("y").cast("double")).alias("target_mean"))
                    .select("target", *by, F.lit(0).alias("grid_order"), F.lit("none").alias("method"),
                            F.lit(None).cast("double").alias("value"), "target_mean",
                            F.lit(None).cast("double").alias("loss"), F.lit(True).alias("chosen")))
    final = apply_calibration(final, cal, "final_pred", by, enabled=postprocess)
    return {"scores": scores, "weights": weights, "model_pred": mp, "alphas": alphas,
            "calibration": cal, "final": final}


# --- G11 ---------------------------------------------------------------------------------------
def final_blend(preds: DataFrame, prior: DataFrame, weights: DataFrame | None, alphas: DataFrame | None,
                calibration: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """Prediction rows: sum_m w_m * pred_m (not clipped, as in the CV-weights path), alpha blend
    with the prior, then the chosen calibration. Without CV results alpha is 0.80 and the
    weights come from in-sample scores (see ``insample_weights``)."""
    by = by or []
    mp = blend_pred(preds, weights, by, clip=False, keys=["key"])
    if alphas is not None:
        a = chosen_alpha(alphas, by)
    else:
        a = weights.select("target", *by).distinct().withColumn("alpha", dlit(FALLBACK_ALPHA))
    rows = (mp.join(prior, ["target", *by, "key"]).join(F.broadcast(a), ["target", *by])
              .withColumn("final_pred", blend_with_prior(F.col("model_pred"), F.col("prior"), F.col("alpha"))))
    if calibration is None:
        return rows.withColumn("calibrated", clip_proba("final_pred"))
    return apply_calibration(rows, calibration, "final_pred", by)


def insample_weights(insample: DataFrame, power=MODEL_BLEND_POWER, ratio=WEAK_MODEL_LOSS_RATIO) -> DataFrame:
    """Weights from in-sample predictions when cross-validation is skipped."""
    return blend_weights(model_scores(insample), power, ratio)


# --- G13 ---------------------------------------------------------------------------------------
def cv_report(t: dict, prior_col: str = "prior") -> DataFrame:
    """One row per target: rows, three log-losses, their final one's average over targets, model scores and
    weights (maps), alpha, alpha curve (map), calibration (struct)."""
    final = t["final"]
    losses = final.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(log_loss_term("y", "calibrated")).alias("oof_logloss"),
        F.avg(log_loss_term("y", "model_pred")).alias("model_only_logloss"),
        F.avg(log_loss_term("y", prior_col)).alias("prior_only_logloss"))
    maps = t["weights"].groupBy("target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("model_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "weight")))).alias("model_weights"))
    al = t["alphas"].groupBy("target").agg(
        F.max(F.when(F.col("chosen"), F.col("alpha_key").cast("double"))).alias("model_alpha"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("alpha_key", "loss")))).alias("alpha_scores"))
    cal = t["calibration"].where("chosen").select(
        "target", F.struct("method", "value", F.col("loss").alias("logloss"), "target_mean").alias("postprocess"))
    report = losses.join(maps, "target").join(al, "target").join(cal, "target")
    return report.crossJoin(F.broadcast(macro_average(losses, col="oof_logloss")))
