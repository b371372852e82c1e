"""End-to-end run: labelled rows -> folds -> out-of-fold fits -> priors -> tuning -> refit -> final blend.

Every stage is a Spark job over DataFrames; reused tables (labelled rows, the
model matrix, OOF predictions) are checkpointed once in the shared checkpoint
folder, so later stages read compact data and survive executor loss.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from daygrain.constants import MODEL_BLEND_POWER, N_SPLITS, QUICK_N_SPLITS, SEED, WEAK_MODEL_LOSS_RATIO
from daygrain.operators import ensemble as ens, folds as fo, matrix as mx, prior as pr, train
from daygrain.plans.features import cached_document_features
from daygrain.session import materialize
from daygrain.sources import files, views


def full_run(spark: SparkSession, sf_dir: str, *, models: list[str] | None = None, n_splits: int | None = None,
             seed: int = SEED, power: float = MODEL_BLEND_POWER, ratio: float = WEAK_MODEL_LOSS_RATIO,
             run_cv: bool = True, postprocess: bool = True, quick: bool = False, workers: int = 8,
             prior_params: dict | None = None, profile_overrides: dict | None = None,
             refit: bool = True, features_cache: str | None = None) -> dict:
    """One trial. ``quick`` is the documented quick mode without its row caps: 120 trees a model, 3 folds.

    The features come from ``features_cache`` (by default a folder of the shared one) if they were built there from the same
    input files; a search therefore builds them once.
    """
    models = models or train.enabled_models()
    n_splits = n_splits or (QUICK_N_SPLITS if quick else N_SPLITS)
    lab = materialize(views.labelled(spark, sf_dir).select("key", "subject_id", "ord", "target", "y", "split"))
    matrix = cached_document_features(spark, sf_dir, features_cache)
    # Columns without any value among the training keys go
    train_keys = lab.where(F.col("split") == "train").select("key").distinct()
    (_, matrix), _ = mx.drop_all_missing(matrix.join(train_keys, "key", "left_semi"), [matrix], [c for c in matrix.columns if c != "key"])
    features = [c for c in matrix.columns if c != "key"]
    targets = [r[0] for r in lab.select("target").distinct().orderBy("target").collect()]
    settings = pr.prior_settings(spark, targets, **(prior_params or {}))
    out = {"labels": lab, "matrix": matrix, "features": features}
    weights = alphas = cal = None
    folds = materialize(fo.stratified_folds(lab, n_splits, seed)) if run_cv else None
    data = train.model_input(matrix, lab, folds)
    fits = train.fit_all(data, models, cv=run_cv, refit=refit or not run_cv, seed=seed,
                         quick=quick, workers=workers, insample=not run_cv,
                         profile_overrides=profile_overrides)
    if run_cv:
        oof_y = fits["oof"].join(folds.select("target", "key", "y"), ["target", "key"])
        prior = pr.prior_oof(lab, folds, settings).drop("fold")
        t = ens.tune(spark, oof_y.select("target", "key", "y", "model", "pred"), prior, power=power, ratio=ratio,
                     postprocess=postprocess)
        weights, alphas, cal = t["weights"], t["alphas"], (t["calibration"] if postprocess else None)
        out.update({"folds": folds, "oof": oof_y, "prior_oof": prior, "tuned": t, "report": ens.cv_report(t)})
    out["settings"] = settings
    if not refit and run_cv:
        return out
    preds = fits["predictions"]
    predict_keys = lab.where(F.col("split") == "predict").select("target", "key")
    pred_rows = preds.join(predict_keys, ["target", "key"])
    if not run_cv:
        # Weights from in-sample predictions, alpha 0.80, no calibration
        insample = preds.join(lab.where(F.col("split") == "train").select("target", "key", "y"), ["target", "key"])
        weights = ens.insample_weights(insample, power, ratio)
    prior_p = pr.prior_predict(lab, settings)
    final = ens.final_blend(pred_rows, prior_p, weights, alphas, cal)
    out.update({"refit": preds, "importance": fits["importance"], "final": final, "weights": weights, "models": fits["models"]})
    return out


def publish(run: dict, base: str, single_file: bool = False) -> tuple[str, int]:
    """The final predictions as the next version (one row a key, one column a target), and beside the versions the
    out-of-fold rows, the importance and the report. Returns the version's path and number; concurrent runs get versions of their own."""
    targets = [r[0] for r in run["final"].select("target").distinct().orderBy("target").collect()]
    wide = run["final"].groupBy("key").pivot("target", targets).agg(F.first("calibrated"))
    path, n = files.write_versioned(wide, f"{base.rstrip('/')}/predictions")
    files.write_csv(run["importance"], f"{base.rstrip('/')}/reports/version={n}/importance", single_file)
    if "oof" in run:
        files.write_csv(run["oof"].select("target", "key", "fold", "model", "pred", "y"), f"{base.rstrip('/')}/reports/version={n}/oof", single_file)
        files.write_json(run["report"], f"{base.rstrip('/')}/reports/version={n}/cv_results", single_file=True)
    return path, n
