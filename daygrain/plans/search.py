"""H6-H10 with A6/A7: the reference's tuning loop re-aimed as Spark work.

Trials are drawn as a DataFrame (hash-based, see ``operators/sweep.py``). Each distinct fit configuration (tree counts, fold
count) runs one cross-validated fit pass; its trials are scored by sweeps over that pass's stored
out-of-fold rows (H7). A failing configuration records log-loss ``inf`` and its
error for each of its trials (H10). Results append to the history (A6); the
incumbent follows strict improvement in trial order and its overrides replace
the previous ones (H9), saved as best parameters (A7); the next trial perturbs it.
"""

from __future__ import annotations

import datetime as dt
import math
import time
import traceback

from pyspark.sql import SparkSession, functions as F

from daygrain.constants import N_SPLITS, SEED, TARGET_PRIOR_SETTINGS
from daygrain.operators import prior as pr, sweep as sw
from daygrain.plans.run import full_run
from daygrain.session import materialize, scratch
from daygrain.sources import files

FIT_PATHS = {
    "training.models.lightgbm.n_estimators": ("lightgbm", "trees"),
    "training.models.xgboost.n_estimators": ("xgboost", "trees"),
    "training.models.catboost.iterations": ("catboost", "trees"),
    "training.models.extra_trees.n_estimators": ("extra_trees", "trees"),
}


def fit_config(overrides: dict) -> tuple:
    """Hashable fit configuration of a trial: (n_splits, ((model, trees), ...))."""
    trees = tuple(sorted((FIT_PATHS[p][0], int(v)) for p, v in overrides.items() if p in FIT_PATHS))
    return int(overrides.get("training.n_splits", N_SPLITS)), trees


#: Trials drawn from one incumbent, and scored together. One: each trial is drawn from the incumbent after the one before it (H9).
BATCH = 1


def search(spark: SparkSession, sf_dir: str, n_trials: int, history_path: str, best_path: str, *,
           strategy: str = "mixed", seed: int = SEED, space=None, models: list[str] | None = None,
           quick: bool = False, workers: int = 8, batch: int = BATCH) -> dict:
    """``n_trials`` further trials in batches of ``batch``; each batch is drawn from the incumbent after the one before it.

    A fit configuration is fitted once a search, whichever trials share it. History and best parameters are written after every
    batch, so a search that is stopped loses one batch. Intermediate tables are removed at the end.
    """
    space = space or sw.SEARCH_SPACE
    last = files.load_history(spark, history_path).agg(F.max("trial_id")).first()[0]
    start = int(last or 0) + 1
    best_params, best_loss = files.load_best(spark, best_path)
    records, fitted = [], {}
    with scratch(spark):
        for first in range(start, start + n_trials, batch):
            # a batch is a handful of rows: collecting it is parameter-sized
            table = sw.trials(spark, min(batch, start + n_trials - first), strategy=strategy, seed=seed,
                              incumbent=best_params, space=space, start=first)
            done = _run_batch(spark, sf_dir, table, models, seed, quick, workers, fitted)
            for r in done:
                if r["error"] is None and r["logloss"] < best_loss:
                    best_loss, best_params = r["logloss"], dict(r["param_overrides"])
            files.append_history(spark, done, history_path)
            if best_params is not None:
                files.save_best(spark, best_path, best_params, best_loss, dt.datetime.now().isoformat())
            records += done
    return {"records": records, "best_params": best_params, "best_logloss": best_loss}


def _fit(spark: SparkSession, sf_dir: str, config: tuple, models, seed: int, quick: bool, workers: int) -> tuple:
    """(out-of-fold rows, prior components, targets) of a fit configuration, written for the sweeps of all its trials."""
    n_splits, trees = config
    run = full_run(spark, sf_dir, models=models, n_splits=n_splits, seed=seed, workers=workers, quick=quick, refit=False,
                   profile_overrides={m: {"trees": n} for m, n in trees})
    comps = pr.oof_prior_components(run["labels"], run["folds"], run["settings"]).select(
        "target", "key", "mu", "hist_s", "hist_n", "rec_s", "rec_n")
    targets = [r[0] for r in run["labels"].select("target").distinct().collect()]
    return materialize(run["oof"].select("target", "key", "y", "model", "pred")), materialize(comps), targets


def _run_batch(spark: SparkSession, sf_dir: str, table, models, seed: int, quick: bool, workers: int, fitted: dict) -> list[dict]:
    """History records of the trials in ``table``, by trial id."""
    trials = [(r["trial_id"], r["strategy"], dict(r["overrides"] or {})) for r in table.orderBy("trial_id").collect()]
    groups: dict = {}
    for t in trials:
        groups.setdefault(fit_config(t[2]), []).append(t)
    records = []
    for config, members in groups.items():
        t0 = time.time()
        try:
            if config not in fitted:
                fitted[config] = _fit(spark, sf_dir, config, models, seed, quick, workers)
            oof, comps, targets = fitted[config]
            overrides = {t: v["recent_weight"] for t, v in TARGET_PRIOR_SETTINGS.items()
                         if t in targets and "recent_weight" in v}
            params = sw.trial_params(table.where(F.col("trial_id").isin([t[0] for t in members])))
            with scratch(spark):
                scores = {r["trial_id"]: r["logloss"] for r in sw.oof_sweep(spark, oof, comps, overrides, params).collect()}
            err = None
        except Exception:   # H10: the search goes on
            scores, err = {}, traceback.format_exc()
        each = (time.time() - t0) / len(members)
        for tid, st, ov in members:
            records.append({"trial_id": tid, "logloss": scores.get(tid, math.inf), "elapsed_sec": round(each, 1),
                            "param_overrides": ov, "strategy": st, "error": err,
                            "timestamp": dt.datetime.now().isoformat()})
    return sorted(records, key=lambda r: r["trial_id"])
