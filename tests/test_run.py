"""End-to-end runs on sf0.001: CV mode, fit-free mode (G14), the search loop (H6-H10) and the bundle."""

import math
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from daygrain.constants import SEARCH_SPACE
from daygrain.operators import train
from daygrain.plans.run import full_run, publish
from daygrain import session
from daygrain.plans import search as search_plan
from daygrain.plans.search import fit_config, search
from daygrain.sources import files


def test_enabled_models():
    assert train.enabled_models() == ["lightgbm", "xgboost", "catboost", "extra_trees", "logistic"]
    assert train.enabled_models({"catboost": {"enabled": False}, "logistic": {"enabled": False}}) == \
        ["lightgbm", "xgboost", "extra_trees"]


def test_profile_sizes():
    assert [train.profile(m).get("trees") for m in train.enabled_models()] == [800, 700, 800, 700, None]
    assert [train.profile(m, quick=True).get("trees") for m in train.enabled_models()] == [120] * 4 + [None]
    assert train.profile("xgboost", quick=True, overrides={"trees": 900})["trees"] == 900


def test_cv_run_and_bundle(spark, tmpdir_path):
    run = full_run(spark, SF_SMALL, models=["xgboost", "logistic"], n_splits=3, workers=4,
                   profile_overrides={"xgboost": {"trees": 5}})
    n_pred = run["labels"].where("split = 'predict'").count()
    fin = run["final"]
    assert fin.count() == n_pred
    assert fin.where((F.col("calibrated") < 1e-5) | (F.col("calibrated") > 1 - 1e-5)).count() == 0
    assert run["oof"].count() == 2 * run["labels"].where("split = 'train'").count()
    files.save_bundle(os.path.join(tmpdir_path, "bundle"), run, {"models": ["xgboost", "logistic"]})
    back = spark.read.parquet(os.path.join(tmpdir_path, "bundle", "model_weights"))
    assert back.count() == run["weights"].count()
    saved = train.score_saved(spark, os.path.join(tmpdir_path, "bundle"), run["matrix"])
    both = run["refit"].join(saved.withColumnRenamed("pred", "again"), ["target", "key", "model"])
    assert both.count() == run["refit"].count() > 0
    assert both.where(F.abs(F.col("pred") - F.col("again")) > 1e-9).count() == 0
    rep = run["report"].collect()
    base = os.path.join(tmpdir_path, "out")
    assert [publish(run, base)[1] for _ in range(2)] == [1, 2]
    sent = files.read_csv(spark, files.latest_version(spark, f"{base}/predictions"), "key long, quality double, toxic double")
    both = sent.unpivot(["key"], ["quality", "toxic"], "target", "p").join(run["final"], ["target", "key"])
    assert both.count() == n_pred and both.where(F.abs(F.col("p") - F.col("calibrated")) > 1e-12).count() == 0
    assert abs(rep[0]["average_logloss"] - sum(r["oof_logloss"] for r in rep) / len(rep)) < 1e-12


def test_fit_free_mode(spark):
    run = full_run(spark, SF_SMALL, models=["logistic"], run_cv=False, workers=2)
    assert "report" not in run
    assert run["final"].count() == run["labels"].where("split = 'predict'").count()
    assert {r["weight"] for r in run["weights"].collect()} == {1.0}


def test_search_loop(spark, tmpdir_path):
    space = [s for s in SEARCH_SPACE if not s[0].startswith("training.models")]
    hist, best = os.path.join(tmpdir_path, "hist"), os.path.join(tmpdir_path, "best")
    before = list(session._WRITTEN)
    out = search(spark, SF_SMALL, 3, hist, best, space=space, models=["logistic"], workers=2)
    ids = [r["trial_id"] for r in out["records"]]
    assert ids == [1, 2, 3] and out["records"][0]["param_overrides"] == {}
    assert all(math.isfinite(r["logloss"]) for r in out["records"])
    h = files.load_history(spark, hist)
    assert h.count() == 3
    assert files.load_best(spark, best)[1] == min(r["logloss"] for r in out["records"])
    assert session._WRITTEN[len(before):] == []
    out2 = search(spark, SF_SMALL, 1, hist, best, space=space, models=["logistic"], workers=2)
    assert out2["records"][0]["trial_id"] == 4


def test_each_trial_follows_the_incumbent_and_shares_fits(spark, tmpdir_path, monkeypatch):
    """The second trial perturbs what the first one left; trials of one fit configuration are fitted once."""
    fits, drawn = [], []
    real, trials = search_plan._fit, search_plan.sw.trials
    monkeypatch.setattr(search_plan, "_fit", lambda *a: fits.append(a[2]) or real(*a))
    monkeypatch.setattr(search_plan.sw, "trials", lambda *a, **k: drawn.append(k["incumbent"]) or trials(*a, **k))
    space = [s for s in SEARCH_SPACE if not s[0].startswith("training.models") and s[0] != "training.n_splits"]
    out = search(spark, SF_SMALL, 3, os.path.join(tmpdir_path, "h"), os.path.join(tmpdir_path, "b"), space=space, models=["logistic"], workers=2)
    assert len(fits) == 1 and len(drawn) == 3
    best = (None, math.inf)
    for r, incumbent in zip(out["records"], drawn):
        assert incumbent == best[0]
        if r["logloss"] < best[1]:
            best = (r["param_overrides"], r["logloss"])
    assert all(math.isfinite(r["logloss"]) for r in out["records"])


def test_fit_config_groups_trials():
    a = fit_config({"training.model_blend_power": 3.0})
    b = fit_config({"training.prior.subject_smoothing": 5.0})
    c = fit_config({"training.n_splits": 7.0, "training.models.xgboost.n_estimators": 900.0})
    assert a == b == (5, ()) and c == (7, (("xgboost", 900),))
