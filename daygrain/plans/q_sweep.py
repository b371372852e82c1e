"""Registered queries for the parameter search (H7, H9, E8) over V7's stored out-of-fold rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrain.constants import N_PARAMS_PER_TRIAL_MAX, N_PARAMS_PER_TRIAL_MIN, N_SPLITS, SEED, TARGET_PRIOR_SETTINGS
from daygrain.operators import folds as fo, prior as pr, sweep as sw
from daygrain.plans import views_sql as S
from daygrain.plans.q_model import (CHAIN, TARGETS, _calibrate_sql, _clip, _grid_values, _labels, _ll,
                                    _oof_preds, _prior_formula, _settings)
from daygrain.operators import ensemble as ens
from daygrain.plans.registry import register

N_TRIALS = 12
PARAM_COLS = [c for c, _ in sw.FIT_FREE.values()]


def _uniform_sql(tag: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:' || trial_id || ':{tag}'), 1, 13))::BIGINT / 4503599627370496.0)"


def _value_sql(kind: str, params, t: str) -> str:
    """The value at quantile ``t`` of one entry of the search space."""
    if kind == "uniform":
        lo, hi = params
        return f"round({lo}::DOUBLE + {t} * ({hi}::DOUBLE - {lo}::DOUBLE), 6)"
    if kind == "loguniform":
        lo, hi = params
        return f"round(exp(ln({lo}::DOUBLE) + {t} * (ln({hi}::DOUBLE) - ln({lo}::DOUBLE))), 8)"
    values = list(range(params[0], params[1] + 1, params[2])) if kind == "int" else list(params)
    return f"[{', '.join(f'{float(v)}::DOUBLE' for v in values)}][(floor({t} * {len(values)})::BIGINT % {len(values)}) + 1]"


def _trials_sql() -> str:
    """Trial 1 is the baseline, trial 2 the low-discrepancy point, the others change a few entries at random."""
    space = {path: (i, kind, params) for i, (path, kind, params) in enumerate(sw.FIT_FREE_SPACE)}
    picks = "[" + ", ".join(_uniform_sql(f"pick:{p}") for p in space) + "]"
    changed = (f"{N_PARAMS_PER_TRIAL_MIN} + floor({_uniform_sql('n_params')} * "
               f"{N_PARAMS_PER_TRIAL_MAX - N_PARAMS_PER_TRIAL_MIN + 1})")
    cols = []
    for path, (col, default) in sw.FIT_FREE.items():
        if path not in space:
            cols.append(f"{float(default)}::DOUBLE AS {col}")
            continue
        i, kind, params = space[path]
        base = i + 2
        point = (f"list_sum([(floor((trial_id + 1) / pow({base}, k)) % {base}) / pow({base}, k + 1) for k in range(20)])")
        cols.append(f"CASE WHEN trial_id = 1 THEN {float(default)}::DOUBLE WHEN trial_id = 2 THEN {_value_sql(kind, params, point)} "
                    f"WHEN len([x for x in {picks} if x < {_uniform_sql(f'pick:{path}')}]) < {changed} "
                    f"THEN {_value_sql(kind, params, _uniform_sql(f'value:{path}'))} ELSE {float(default)}::DOUBLE END AS {col}")
    return f"SELECT trial_id::INTEGER AS trial_id, {', '.join(cols)} FROM range(1, {N_TRIALS + 1}) AS t(trial_id)"


def _weight_overrides():
    return {t: v["recent_weight"] for t, v in TARGET_PRIOR_SETTINGS.items() if t in TARGETS and "recent_weight" in v}


def _sweep(spark, sf_dir):
    lab = _labels(spark, sf_dir)
    folds = fo.stratified_folds(lab, N_SPLITS, SEED)
    comps = pr.oof_prior_components(lab, folds, _settings(spark)).select(
        "target", "key", "mu", "hist_s", "hist_n", "rec_s", "rec_n")
    params = sw.trial_params(sw.trials(spark, N_TRIALS, space=sw.FIT_FREE_SPACE))
    res = sw.oof_sweep(spark, _oof_preds(spark, sf_dir), comps, _weight_overrides(), params)
    return res.join(params, "trial_id").select("trial_id", *PARAM_COLS, "logloss")


def _sweep_sql() -> str:
    alpha_g = _grid_values([(i, float(a), f"{a:.2f}") for i, a in enumerate(ens.alpha_values())],
                           "grid_order, alpha, alpha_key")
    cal_g = _grid_values(ens.calibration_grid_rows(), "grid_order, method, value")
    prior = _prior_formula("tr.subject_smoothing", "tr.recent_smoothing", "tr.default_recent_weight")
    return CHAIN + f""",
trials AS ({_trials_sql()}),
comps AS (SELECT v.target, v.key, mu.mu, hist.hist_s, hist.hist_n, t.rec_s, t.rec_n
          FROM trf v JOIN mu USING (target, fold) JOIN hist USING (target, key, fold)
          LEFT JOIN tail t ON t.target = v.target AND t.vf = v.fold AND t.subject_id = v.subject_id),
priort AS (SELECT tr.trial_id, c.target, c.key, {prior} AS prior FROM comps c CROSS JOIN trials tr),
w1t AS (SELECT tr.trial_id, s.target, s.model,
               CASE WHEN s.score <= min(s.score) OVER (PARTITION BY tr.trial_id, s.target) * tr.ratio
                    THEN 1.0::DOUBLE / pow(greatest(s.score, 0.00001::DOUBLE), tr.power) ELSE 0.0::DOUBLE END AS inv
        FROM scores s CROSS JOIN trials tr),
wt AS (SELECT trial_id, target, model, inv / sum(inv) OVER (PARTITION BY trial_id, target) AS weight FROM w1t),
mpt AS (SELECT w.trial_id, po.target, po.key, po.y, {_clip('sum(w.weight * po.pred)')} AS model_pred
        FROM po JOIN wt w USING (target, model) GROUP BY w.trial_id, po.target, po.key, po.y),
art AS (SELECT mpt.*, priort.prior FROM mpt JOIN priort USING (trial_id, target, key)),
alt AS (SELECT *, row_number() OVER (PARTITION BY trial_id, target ORDER BY round(loss, 12), grid_order) = 1 AS chosen
        FROM (SELECT art.trial_id, art.target, g.grid_order, g.alpha, g.alpha_key,
                     avg({_ll('art.y', _clip('g.alpha * art.model_pred + (1.0::DOUBLE - g.alpha) * art.prior'))}) AS loss
              FROM art CROSS JOIN {alpha_g} GROUP BY art.trial_id, art.target, g.grid_order, g.alpha, g.alpha_key)),
fint AS (SELECT art.*, {_clip('a.alpha * art.model_pred + (1.0::DOUBLE - a.alpha) * art.prior')} AS final_pred
         FROM art JOIN (SELECT trial_id, target, CAST(alpha_key AS DOUBLE) AS alpha FROM alt WHERE chosen) a USING (trial_id, target)),
tmt AS (SELECT trial_id, target, avg(CAST(y AS DOUBLE)) AS target_mean FROM fint GROUP BY trial_id, target),
calt AS (SELECT *, row_number() OVER (PARTITION BY trial_id, target ORDER BY round(loss, 12), grid_order) = 1 AS chosen
         FROM (SELECT fint.trial_id, fint.target, g.grid_order, g.method, g.value, tmt.target_mean,
                      avg({_ll('fint.y', _calibrate_sql('fint.final_pred', 'g.method', 'g.value', 'tmt.target_mean'))}) AS loss
               FROM fint JOIN tmt USING (trial_id, target) CROSS JOIN {cal_g}
               GROUP BY fint.trial_id, fint.target, g.grid_order, g.method, g.value, tmt.target_mean)),
cbt AS (SELECT fint.*, {_calibrate_sql('fint.final_pred', 'c.method', 'c.value', 'c.target_mean')} AS calibrated
        FROM fint JOIN (SELECT * FROM calt WHERE chosen) c USING (trial_id, target)),
ptt AS (SELECT trial_id, target, avg({_ll('y', 'calibrated')}) AS logloss FROM cbt GROUP BY trial_id, target),
sweep AS (SELECT p.trial_id, {', '.join('t.' + c for c in PARAM_COLS)}, avg(p.logloss) AS logloss
          FROM ptt p JOIN trials t USING (trial_id) GROUP BY p.trial_id, {', '.join('t.' + c for c in PARAM_COLS)}),
hist_t AS (SELECT *, CAST(NULL AS VARCHAR) AS error FROM sweep)"""


_SWEEP = _sweep_sql()


@register("oof_sweep", S.rounded(S.with_views(_SWEEP, "SELECT * FROM sweep"), ["trial_id"]))
def oof_sweep(spark, sf_dir):
    """H7: tuned OOF log-loss of 12 search trials (baseline, low-discrepancy, random) in one plan."""
    return _sweep(spark, sf_dir)


@register("trial_best", S.rounded(S.with_views(_SWEEP, f"""SELECT trial_id, {', '.join(PARAM_COLS)}, logloss
FROM hist_t WHERE error IS NULL ORDER BY round(logloss, 12), trial_id LIMIT 1"""), ["trial_id"]))
def trial_best(spark, sf_dir):
    """H9: the incumbent after the sweep: first trial reaching the lowest log-loss."""
    hist = _sweep(spark, sf_dir).withColumn("logloss", F.round("logloss", 12)) \
                                .withColumn("error", F.lit(None).cast("string"))
    return sw.trial_best(hist).drop("error")


@register("top_trials", S.rounded(S.with_views(_SWEEP, f"""SELECT trial_id, {', '.join(PARAM_COLS)}, logloss
FROM hist_t WHERE error IS NULL ORDER BY round(logloss, 12), trial_id LIMIT 5"""), ["trial_id"]))
def top_trials(spark, sf_dir):
    """The five best trials without error."""
    hist = _sweep(spark, sf_dir).withColumn("logloss", F.round("logloss", 12)) \
                                .withColumn("error", F.lit(None).cast("string"))
    return sw.top_trials(hist, 5).drop("error")
