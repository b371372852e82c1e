"""Registered queries for folds, priors, log-loss, blending and calibration on V7.

V7 (documents x labels, two targets) plays the labelled rows; its three fixed
pseudo-predictions play three models' out-of-fold outputs, so every step after
fitting has a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.constants import EPS, MODEL_BLEND_POWER, N_SPLITS, RECENT_SMOOTHING, SEED, SUBJECT_SMOOTHING, \
    DEFAULT_RECENT_WEIGHT, RECENT_DAYS, WEAK_MODEL_LOSS_RATIO
from daygrain.operators import ensemble as ens, folds as fo, metrics, prior as pr
from daygrain.plans import views_sql as S
from daygrain.plans.registry import register
from daygrain.session import materialize
from daygrain.sources import views

TARGETS = views.V7_TARGETS


# --- Spark side: shared pieces -------------------------------------------------------------
def _labels(spark, sf_dir):
    # the labelled table is read by folds, priors and tuning: materialise it once per query
    return materialize(views.labelled(spark, sf_dir).select("key", "subject_id", "ord", "target", "y", "split"))


def _settings(spark):
    return pr.prior_settings(spark, TARGETS)


def _folds(spark, sf_dir):
    return fo.stratified_folds(_labels(spark, sf_dir), N_SPLITS, SEED)


def _oof_preds(spark, sf_dir):
    return materialize(views.model_predictions(spark, sf_dir).where(F.col("split") == "train")
                       .select("target", "key", "y", "model", "pred"))


def _tuned(spark, sf_dir, lab=None):
    lab = lab if lab is not None else _labels(spark, sf_dir)
    prior = pr.prior_oof(lab, fo.stratified_folds(lab, N_SPLITS, SEED), _settings(spark)).drop("fold")
    return ens.tune(spark, _oof_preds(spark, sf_dir), prior)


# --- SQL side: one CTE chain, written directly ------------------------------------------------
def _clip(x: str) -> str:
    return f"least(greatest({x}, {EPS!r}::DOUBLE), (1.0::DOUBLE - {EPS!r}::DOUBLE))"


def _ll(y: str, p: str) -> str:
    q = _clip(p)
    return f"-(CAST({y} AS DOUBLE) * ln({q}) + (1.0::DOUBLE - CAST({y} AS DOUBLE)) * ln(1.0::DOUBLE - {q}))"


def _logit(p: str) -> str:
    q = _clip(p)
    return f"ln({q} / (1.0::DOUBLE - {q}))"


def _prior_formula(s, r, w) -> str:
    s, r, w = [x if isinstance(x, str) else f"{x!r}::DOUBLE" for x in (s, r, w)]
    subj = f"(CASE WHEN hist_n > 0 THEN (CAST(hist_s AS DOUBLE) + {s} * mu) / (CAST(hist_n AS DOUBLE) + {s}) ELSE mu END)"
    rec = f"(CASE WHEN coalesce(rec_n, 0) > 0 THEN (CAST(rec_s AS DOUBLE) + {r} * mu) / (CAST(rec_n AS DOUBLE) + {r}) ELSE {subj} END)"
    return _clip(f"(1.0::DOUBLE - {w}) * {subj} + {w} * {rec}")


def _grid_values(rows, cols):
    out = []
    for r in rows:
        vals = []
        for v in r:
            if v is None:
                vals.append("NULL::DOUBLE")
            elif isinstance(v, float):
                vals.append(f"{v!r}::DOUBLE")
            elif isinstance(v, str):
                vals.append(f"'{v}'")
            else:
                vals.append(str(v))
        out.append("(" + ", ".join(vals) + ")")
    return f"(VALUES {', '.join(out)}) AS g({cols})"


def _calibrate_sql(p: str, method: str, value: str, tm: str) -> str:
    ml = _logit(tm)
    temp = _clip(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({ml} + {value} * ({_logit(p)} - {ml}))))")
    shrink = _clip(f"(1.0::DOUBLE - {value}) * {p} + {value} * {tm}")
    return (f"CASE WHEN {method} = 'mean_shrink' THEN {shrink} WHEN {method} = 'temperature' THEN {temp} "
            f"ELSE {_clip(p)} END")


S_SM, R_SM, W_DEF, N_REC = SUBJECT_SMOOTHING, RECENT_SMOOTHING, DEFAULT_RECENT_WEIGHT, RECENT_DAYS

def _chain(n_rec: str, weight: str) -> str:
    """``n_rec``: SQL of a target's recent rows; ``weight``: SQL of its recent weight. Both may name the column ``target``."""
    return S.PREDS + f""",
lab AS (SELECT key, subject_id, ord, target, y, split FROM labelled),
tr AS (SELECT * FROM lab WHERE split = 'train'),
cls AS (SELECT target, y, count(*) AS n FROM tr GROUP BY target, y),
bal AS (SELECT target, min(n) AS min_class, count(*) AS n_classes,
               CAST(greatest(2, least({N_SPLITS}, min(n))) AS INTEGER) AS n_folds FROM cls GROUP BY target),
offs AS (SELECT target, y, coalesce(sum(n) OVER (PARTITION BY target ORDER BY y
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cls),
rk AS (SELECT target, key, y, row_number() OVER (PARTITION BY target, y
              ORDER BY md5(CAST(key AS VARCHAR) || ':{SEED}'), key) - 1 AS r FROM tr),
folds AS (SELECT rk.target, rk.key, rk.y, CAST((rk.r + offs.off) % bal.n_folds + 1 AS INTEGER) AS fold
          FROM rk JOIN offs USING (target, y) JOIN bal USING (target)),
trf AS (SELECT tr.target, tr.key, tr.subject_id, tr.ord, tr.y, f.fold FROM tr JOIN folds f USING (target, key)),
mu AS (SELECT v.target, v.fold, avg(CAST(h.y AS DOUBLE)) AS mu
       FROM (SELECT DISTINCT target, fold FROM trf) v JOIN trf h ON h.target = v.target AND h.fold <> v.fold
       GROUP BY v.target, v.fold),
hist AS (SELECT v.target, v.key, v.fold, count(h.key) AS hist_n, coalesce(sum(h.y), 0) AS hist_s
         FROM trf v LEFT JOIN trf h ON h.target = v.target AND h.subject_id = v.subject_id AND h.fold <> v.fold
         GROUP BY v.target, v.key, v.fold),
tail AS (SELECT target, vf, subject_id, sum(y) AS rec_s, count(*) AS rec_n FROM (
           SELECT h.target, v.vf, h.subject_id, h.y,
                  row_number() OVER (PARTITION BY h.target, v.vf, h.subject_id ORDER BY h.ord DESC, h.key DESC) AS rn
           FROM trf h JOIN (SELECT DISTINCT target, fold AS vf FROM trf) v ON h.target = v.target AND h.fold <> v.vf)
         WHERE rn <= {n_rec} GROUP BY target, vf, subject_id),
prior_oof AS (SELECT v.target, v.key, v.fold, {_prior_formula(S_SM, R_SM, weight.replace('target', 'v.target'))} AS prior
              FROM trf v JOIN mu USING (target, fold) JOIN hist USING (target, key, fold)
              LEFT JOIN tail t ON t.target = v.target AND t.vf = v.fold AND t.subject_id = v.subject_id),
prp AS (SELECT * FROM lab WHERE split = 'predict'),
gm AS (SELECT target, CAST(sum(y) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mu FROM tr GROUP BY target),
sp AS (SELECT target, subject_id, sum(y) AS hist_s, count(*) AS hist_n FROM tr GROUP BY target, subject_id),
tp AS (SELECT target, subject_id, sum(y) AS rec_s, count(*) AS rec_n FROM (
         SELECT *, row_number() OVER (PARTITION BY target, subject_id ORDER BY ord DESC, key DESC) AS rn FROM tr)
       WHERE rn <= {n_rec} GROUP BY target, subject_id),
prior_predict AS (SELECT p.target, p.key, {_prior_formula(S_SM, R_SM, weight.replace('target', 'p.target')).replace('hist_n', 'coalesce(hist_n, 0)').replace('hist_s', 'coalesce(hist_s, 0)')} AS prior
                  FROM prp p JOIN gm USING (target) LEFT JOIN sp USING (target, subject_id)
                  LEFT JOIN tp USING (target, subject_id)),
po AS (SELECT target, key, y, model, pred FROM preds WHERE split = 'train'),
scores AS (SELECT target, model, avg({_ll('y', 'pred')}) AS score FROM po GROUP BY target, model),
w1 AS (SELECT *, CASE WHEN score <= min(score) OVER (PARTITION BY target) * {WEAK_MODEL_LOSS_RATIO!r}::DOUBLE
                      THEN 1.0::DOUBLE / pow(greatest(score, {EPS!r}::DOUBLE), {MODEL_BLEND_POWER!r}::DOUBLE)
                      ELSE 0.0::DOUBLE END AS inv FROM scores),
weights AS (SELECT target, model, score, inv / sum(inv) OVER (PARTITION BY target) AS weight FROM w1),
mp AS (SELECT po.target, po.key, po.y, {_clip('sum(weights.weight * po.pred)')} AS model_pred
       FROM po JOIN weights USING (target, model) GROUP BY po.target, po.key, po.y),
ar AS (SELECT mp.*, prior_oof.prior FROM mp JOIN prior_oof USING (target, key)),
alphas AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(loss, 12), grid_order) = 1 AS chosen FROM (
             SELECT ar.target, g.grid_order, g.alpha, g.alpha_key,
                    avg({_ll('ar.y', _clip('g.alpha * ar.model_pred + (1.0::DOUBLE - g.alpha) * ar.prior'))}) AS loss
             FROM ar CROSS JOIN {_grid_values([(i, float(a), f"{a:.2f}") for i, a in enumerate(ens.alpha_values())], 'grid_order, alpha, alpha_key')}
             GROUP BY ar.target, g.grid_order, g.alpha, g.alpha_key)),
fin AS (SELECT ar.*, {_clip('a.alpha * ar.model_pred + (1.0::DOUBLE - a.alpha) * ar.prior')} AS final_pred
        FROM ar JOIN (SELECT target, CAST(alpha_key AS DOUBLE) AS alpha FROM alphas WHERE chosen) a USING (target)),
tmean AS (SELECT target, avg(CAST(y AS DOUBLE)) AS target_mean FROM fin GROUP BY target),
cal AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(loss, 12), grid_order) = 1 AS chosen FROM (
          SELECT fin.target, g.grid_order, g.method, g.value, tmean.target_mean,
                 avg({_ll('fin.y', _calibrate_sql('fin.final_pred', 'g.method', 'g.value', 'tmean.target_mean'))}) AS loss
          FROM fin JOIN tmean USING (target)
          CROSS JOIN {_grid_values(ens.calibration_grid_rows(), 'grid_order, method, value')}
          GROUP BY fin.target, g.grid_order, g.method, g.value, tmean.target_mean)),
calibrated AS (SELECT fin.*, {_calibrate_sql('fin.final_pred', 'c.method', 'c.value', 'c.target_mean')} AS calibrated
               FROM fin JOIN (SELECT * FROM cal WHERE chosen) c USING (target)),
pp AS (SELECT target, key, model, pred FROM preds WHERE split = 'predict'),
fmp AS (SELECT pp.target, pp.key, sum(weights.weight * pp.pred) AS model_pred
        FROM pp JOIN weights USING (target, model) GROUP BY pp.target, pp.key),
ffin AS (SELECT fmp.target, fmp.key, fmp.model_pred, prior_predict.prior,
                {_clip('a.alpha * fmp.model_pred + (1.0::DOUBLE - a.alpha) * prior_predict.prior')} AS final_pred
         FROM fmp JOIN prior_predict USING (target, key) JOIN (SELECT target, CAST(alpha_key AS DOUBLE) AS alpha FROM alphas WHERE chosen) a USING (target)),
final_blend AS (SELECT ffin.*, {_calibrate_sql('ffin.final_pred', 'c.method', 'c.value', 'c.target_mean')} AS calibrated
                FROM ffin JOIN (SELECT * FROM cal WHERE chosen) c USING (target))"""


CHAIN = _chain(str(N_REC), f"{W_DEF!r}::DOUBLE")


def _q(body: str, keep: list[str] | None = None) -> str:
    sql = S.with_views(CHAIN, body)
    return S.rounded(sql, keep) if keep is not None else sql


# --- D15 / G1 / C6 ----------------------------------------------------------------------------
@register("class_balance", _q("SELECT target, min_class, n_classes, n_folds FROM bal"))
def class_balance(spark, sf_dir):
    """Smallest class and fold count per target."""
    return fo.class_balance(_labels(spark, sf_dir), N_SPLITS)


@register("stratified_folds", _q("SELECT target, key, y, fold FROM folds"))
def stratified_folds(spark, sf_dir):
    """G1: stratified, seeded fold of every labelled row (exact bucketed row numbers)."""
    return _folds(spark, sf_dir)


@register("fold_complement", _q("""SELECT f.target, f.key, f.y, f.fold, v.vf
FROM folds f JOIN (SELECT DISTINCT target, fold AS vf FROM folds) v ON f.target = v.target AND f.fold <> v.vf"""))
def fold_complement(spark, sf_dir):
    """Training rows of every validation fold, all folds in one plan."""
    return fo.fold_complement(_folds(spark, sf_dir)).select("target", "key", "y", "fold", "vf")


# --- D16 / D17 / C3 / G9 ------------------------------------------------------------------------
@register("subject_prior", _q(f"""SELECT target, subject_id, gm.mu AS global_mean,
  (CAST(hist_s AS DOUBLE) + {S_SM!r}::DOUBLE * gm.mu) / (CAST(hist_n AS DOUBLE) + {S_SM!r}::DOUBLE) AS subject_prior
FROM sp JOIN gm USING (target)""", ["target", "subject_id"]))
def subject_prior(spark, sf_dir):
    """Smoothed per-subject mean (s = 8) next to the target's global mean."""
    return pr.subject_prior(_labels(spark, sf_dir))


@register("recent_prior", _q(f"""SELECT target, subject_id, rec_n AS n_recent,
  (CAST(rec_s AS DOUBLE) + {R_SM!r}::DOUBLE * gm.mu) / (CAST(rec_n AS DOUBLE) + {R_SM!r}::DOUBLE) AS recent_prior
FROM tp JOIN gm USING (target)""", ["target", "subject_id", "n_recent"]))
def recent_prior(spark, sf_dir):
    """Smoothed mean of each subject's last N rows (r = 4, N = 10)."""
    return pr.recent_prior(_labels(spark, sf_dir), _settings(spark))


@register("prior_lookup", _q(f"""SELECT p.target, p.key, p.subject_id, gm.mu AS global_mean,
  coalesce((CAST(sp.hist_s AS DOUBLE) + {S_SM!r}::DOUBLE * gm.mu) / (CAST(sp.hist_n AS DOUBLE) + {S_SM!r}::DOUBLE),
           gm.mu) AS prior
FROM prp p JOIN gm USING (target) LEFT JOIN sp USING (target, subject_id)""", ["target", "key", "subject_id"]))
def prior_lookup(spark, sf_dir):
    """Subject prior of every prediction row, global mean for unseen subjects."""
    lab = _labels(spark, sf_dir)
    rows = lab.where(F.col("split") == "predict").select("target", "key", "subject_id")
    return pr.prior_lookup(rows, pr.subject_prior(lab))


@register("prior_oof", _q("SELECT target, key, fold, prior FROM prior_oof", ["target", "key", "fold"]))
def prior_oof(spark, sf_dir):
    """G9 out of fold: every validation row scored from the other folds' history."""
    lab = _labels(spark, sf_dir)
    return pr.prior_oof(lab, fo.stratified_folds(lab, N_SPLITS, SEED), _settings(spark))


@register("prior_predict", _q("SELECT target, key, prior FROM prior_predict", ["target", "key"]))
def prior_predict(spark, sf_dir):
    """G9 for prediction rows, from all training rows."""
    return pr.prior_predict(_labels(spark, sf_dir), _settings(spark))


# Settings of their own for each target: all weight on a long tail, and a short one.
PER_TARGET = {"quality": {"recent_days": 30, "recent_weight": 1.0}, "toxic": {"recent_days": 3, "recent_weight": 0.6}}
_PER_TARGET_CHAIN = _chain("CASE target WHEN 'quality' THEN 30 ELSE 3 END", "(CASE target WHEN 'quality' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END)")


@register("prior_oof_per_target", S.rounded(S.with_views(_PER_TARGET_CHAIN, "SELECT target, key, fold, prior FROM prior_oof"),
                                            ["target", "key", "fold"]))
def prior_oof_per_target(spark, sf_dir):
    """G9 with each target's own number of recent rows and recent weight, on validation rows."""
    lab = _labels(spark, sf_dir)
    return pr.prior_oof(lab, fo.stratified_folds(lab, N_SPLITS, SEED), pr.prior_settings(spark, TARGETS, target_settings=PER_TARGET))


@register("prior_predict_per_target", S.rounded(S.with_views(_PER_TARGET_CHAIN, "SELECT target, key, prior FROM prior_predict"),
                                                ["target", "key"]))
def prior_predict_per_target(spark, sf_dir):
    """G9 with each target's own settings, on prediction rows."""
    return pr.prior_predict(_labels(spark, sf_dir), pr.prior_settings(spark, TARGETS, target_settings=PER_TARGET))


# --- C6 / G9 in the order of time ---------------------------------------------------------------
GAP = 3


def _as_of_sql() -> str:
    return CHAIN + f""",
until AS (SELECT v.target, v.key, count(h.key) AS hist_n, coalesce(sum(h.y), 0) AS hist_s
         FROM tr v LEFT JOIN tr h ON h.target = v.target AND h.subject_id = v.subject_id AND h.ord < v.ord - {GAP} GROUP BY v.target, v.key),
asof_mu AS (SELECT v.target, v.key, coalesce(avg(CAST(h.y AS DOUBLE)), 0.5::DOUBLE) AS mu
            FROM tr v LEFT JOIN tr h ON h.target = v.target AND h.ord < v.ord - {GAP} GROUP BY v.target, v.key),
asof_tail AS (SELECT target, key, sum(y) AS rec_s, count(*) AS rec_n FROM (
                SELECT v.target, v.key, h.y, row_number() OVER (PARTITION BY v.target, v.key ORDER BY h.ord DESC, h.key DESC) AS rn
                FROM tr v JOIN tr h ON h.target = v.target AND h.subject_id = v.subject_id AND h.ord < v.ord - {GAP})
              WHERE rn <= {N_REC} GROUP BY target, key),
prior_as_of AS (SELECT a.target, a.key, CAST(hist_n AS BIGINT) AS hist_n, CAST(coalesce(rec_n, 0) AS BIGINT) AS rec_n, {_prior_formula(S_SM, R_SM, W_DEF)} AS prior
                FROM until a JOIN asof_mu USING (target, key) LEFT JOIN asof_tail USING (target, key)),
in_time AS (SELECT target, key, y, ord, CAST(floor((row_number() OVER (PARTITION BY target ORDER BY ord, key) - 1) * {N_SPLITS} / count(*) OVER (PARTITION BY target)) + 1
                   AS INTEGER) AS fold FROM tr),
firsts AS (SELECT target, fold AS vf, min(ord) AS first_ord FROM in_time GROUP BY target, fold)"""


@register("prior_as_of", S.rounded(S.with_views(_as_of_sql(), "SELECT target, key, hist_n, rec_n, prior FROM prior_as_of"), ["target", "key", "hist_n", "rec_n"]))
def prior_as_of(spark, sf_dir):
    """G9 as of each row: only labels more than three positions before it, by prefix sums over ranges."""
    return pr.prior_as_of(_labels(spark, sf_dir), _settings(spark), gap=GAP)


@register("fold_history", S.with_views(_as_of_sql(), f"""SELECT t.target, t.key, t.y, t.ord, t.fold, f.vf
FROM in_time t JOIN firsts f ON t.target = f.target AND t.ord < f.first_ord - {GAP}"""))
def fold_history(spark, sf_dir):
    """C6 in time: the training rows of every fold of ordered folds, with a gap of three positions."""
    folds = materialize(fo.ordered_folds(_labels(spark, sf_dir).where("split = 'train'")), as_table=True)
    return fo.fold_history(folds, GAP).select("target", "key", "y", "ord", "fold", "vf")


# --- D18 / G5 / D21 -------------------------------------------------------------------------------
@register("logloss", _q("SELECT target, model, score AS logloss FROM scores", ["target", "model"]))
def logloss(spark, sf_dir):
    """Log-loss of each model's predictions per target."""
    return metrics.logloss(_oof_preds(spark, sf_dir), ["target", "model"])


@register("blend_weights", _q("SELECT target, model, score, weight FROM weights", ["target", "model"]))
def blend_weights(spark, sf_dir):
    """Performance weights (power 2.5, weak ratio 1.18) per target and model."""
    return ens.blend_weights(ens.model_scores(_oof_preds(spark, sf_dir))).select("target", "model", "score",
                                                                                  "weight")


@register("blend_pred", _q("SELECT target, key, model_pred FROM mp", ["target", "key"]))
def blend_pred(spark, sf_dir):
    """Clipped weighted blend of the models' out-of-fold predictions."""
    oof = _oof_preds(spark, sf_dir)
    return ens.blend_pred(oof, ens.blend_weights(ens.model_scores(oof)))


@register("seed_bagging", _q(f"""SELECT target, key, {_clip('avg(pred)')} AS pred
FROM preds GROUP BY target, key""", ["target", "key"]))
def seed_bagging(spark, sf_dir):
    """Clipped mean over replicate predictions (the three V7 columns as seeds)."""
    return ens.seed_bagging(views.model_predictions(spark, sf_dir), ["target", "key"])


# --- G6 / G7 / G8 / G11 / G13 -----------------------------------------------------------------------
@register("alpha_search", _q("SELECT target, grid_order, alpha, alpha_key, loss, chosen FROM alphas",
                             ["target", "grid_order", "alpha_key", "chosen"]))
def alpha_search(spark, sf_dir):
    """Log-loss of the prior/model blend on the 21-point alpha grid; first minimum chosen."""
    return _tuned(spark, sf_dir)["alphas"]


@register("calibration_search", _q("SELECT target, grid_order, method, value, target_mean, loss, chosen FROM cal",
                                   ["target", "grid_order", "method", "chosen"]))
def calibration_search(spark, sf_dir):
    """None / 41 mean-shrink / 86 temperature candidates; first minimum chosen."""
    return _tuned(spark, sf_dir)["calibration"]


@register("calibrated", _q("SELECT target, key, final_pred, calibrated FROM calibrated", ["target", "key"]))
def calibrated(spark, sf_dir):
    """The chosen calibration applied to the tuned out-of-fold blend."""
    return _tuned(spark, sf_dir)["final"].select("target", "key", "final_pred", "calibrated")


@register("final_blend", _q("SELECT target, key, model_pred, prior, final_pred, calibrated FROM final_blend",
                            ["target", "key"]))
def final_blend(spark, sf_dir):
    """Prediction rows blended with CV weights and alpha, plus prior and calibration."""
    lab = _labels(spark, sf_dir)
    t = _tuned(spark, sf_dir, lab)
    preds = views.model_predictions(spark, sf_dir).where(F.col("split") == "predict") \
                 .select("target", "key", "model", "pred")
    prior = pr.prior_predict(lab, _settings(spark))
    out = ens.final_blend(preds, prior, t["weights"], t["alphas"], t["calibration"])
    return out.select("target", "key", "model_pred", "prior", "final_pred", "calibrated")


@register("cv_report", _q(f"""SELECT c.target,
  avg({_ll('c.y', 'c.calibrated')}) AS oof_logloss,
  avg({_ll('c.y', 'c.model_pred')}) AS model_only_logloss,
  avg({_ll('c.y', 'c.prior')}) AS prior_only_logloss,
  any_value(CAST(a.alpha_key AS DOUBLE)) AS model_alpha, any_value(k.method) AS method, any_value(k.value) AS value,
  any_value(k.loss) AS post_logloss, any_value(k.target_mean) AS target_mean, count(*) AS n_rows,
  avg(avg({_ll('c.y', 'c.calibrated')})) OVER () AS average_logloss
FROM calibrated c JOIN (SELECT * FROM alphas WHERE chosen) a USING (target)
JOIN (SELECT * FROM cal WHERE chosen) k USING (target) GROUP BY c.target""", ["target", "method", "n_rows"]))
def cv_report(spark, sf_dir):
    """G13 (flat): per-target rows, final, model-only and prior-only log-loss, alpha, calibration; the average over targets."""
    rep = ens.cv_report(_tuned(spark, sf_dir))
    return rep.select("target", "oof_logloss", "model_only_logloss", "prior_only_logloss", "model_alpha",
                      F.col("postprocess.method").alias("method"), F.col("postprocess.value").alias("value"),
                      F.col("postprocess.logloss").alias("post_logloss"),
                      F.col("postprocess.target_mean").alias("target_mean"), "n_rows", "average_logloss")
