"""Registered rows-only queries over real fits (G2-G4, G10, G11, D19), at the full sizes of the profiles.

No SQL engine can reproduce the fitted models, so these carry no oracle; the
steps after fitting are checked exactly by the V7 queries in ``q_model``, the trees
by exhaustive search in the tests. The queries share one run per (application, data
folder): its tables are written to the shared folder, so re-reading them costs a scan, not a refit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.operators import train
from daygrain.plans.registry import register
from daygrain.plans.run import full_run
from daygrain.session import scratch_path
from daygrain.sources import files

_RUNS: dict = {}


def _run(spark, sf_dir):
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _RUNS:
        _RUNS[k] = full_run(spark, sf_dir)
    return _RUNS[k]


@register("oof_models")
def oof_models(spark, sf_dir):
    """Out-of-fold probability of every (target, key, model) from five model profiles."""
    return _run(spark, sf_dir)["oof"].select("target", "key", "fold", "model", "pred")


@register("refit_predictions")
def refit_predictions(spark, sf_dir):
    """Seed-bagged (42, 2025, 777) refits scored on the prediction rows."""
    return _run(spark, sf_dir)["refit"]


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Importance of the first boosted profile summed over targets and seeds."""
    return _run(spark, sf_dir)["importance"]


@register("model_final")
def model_final(spark, sf_dir):
    """G11 over real fits: CV weights and alpha, prior, calibration, per prediction row."""
    return _run(spark, sf_dir)["final"].select("target", "key", "model_pred", "prior", "final_pred", "calibrated")


@register("model_report")
def model_report(spark, sf_dir):
    """G13 over real fits (flat)."""
    run = _run(spark, sf_dir)
    return run["report"].select("target", "oof_logloss", "model_only_logloss", "prior_only_logloss", "model_alpha",
                      F.col("postprocess.method").alias("method"), F.col("postprocess.value").alias("value"),
                      "n_rows", F.lit(len(run["features"])).alias("n_features"), "average_logloss")


@register("scored_without_refit")
def scored_without_refit(spark, sf_dir):
    """The prediction rows scored from the saved bundle of the run's refits, without a fit; equal to ``refit_predictions``."""
    run = _run(spark, sf_dir)
    if "bundle" not in run:
        run["bundle"] = scratch_path(spark, "bundle")
        files.save_bundle(run["bundle"], run, {})
    rows = run["labels"].where("split = 'predict'").select("target", "key")
    return train.score_saved(spark, run["bundle"], run["matrix"].join(rows.select("key").distinct(), "key", "left_semi")).join(rows, ["target", "key"])
