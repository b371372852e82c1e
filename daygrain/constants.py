"""Fixed values that must equal the reference's for the same results.

They are stated plainly, in the reference's natural order.
"""

# --- fixed values: targets, key columns and probability clip ----------------
TARGETS = ["Q1", "Q2", "Q3", "S1", "S2", "S3", "S4"]
KEY_COLUMNS = ["subject_id", "sleep_date", "lifelog_date"]
MERGE_KEYS = ["subject_id", "lifelog_date"]
EPS = 1e-5

# --- fixed values: time-of-day bins, upper hour bound inclusive -------------
TIME_BINS = [("night", 5), ("morning", 11), ("afternoon", 17), ("evening", 23)]

# --- fixed values: daily statistics -----------------------------------------
DAILY_STATS = ["count", "mean", "std", "min", "max", "median", "sum"]
ROW_SUM_STATS = ["sum", "mean", "max"]          # re-aggregation of *_n and *_sum
ROW_OTHER_STATS = ["mean", "std", "min", "max"]  # re-aggregation of other row stats
LIST_KEY_STATS = ["mean", "std", "min", "max", "sum"]

# --- fixed values: feature limits -------------------------------------------
TOP_APPS = 40
TOP_AMBIENCE = 50
RELATIVE_FEATURE_LIMIT = 350
LAG_FEATURE_LIMIT = 120
RELATIVE_EXCLUDED_PREFIXES = ("life_", "sleep_", "is_weekend", "subject_idx", "subject_days", "subject_row")
ROLL_WINDOWS = (3, 7)
MISSING_LABEL = "missing"

# --- fixed values: training defaults ----------------------------------------
SEED = 42
N_SPLITS = 5
RECENT_DAYS = 10
MODEL_BLEND_POWER = 2.5
WEAK_MODEL_LOSS_RATIO = 1.18
SUBJECT_SMOOTHING = 8.0
RECENT_SMOOTHING = 4.0
DEFAULT_RECENT_WEIGHT = 0.3
TARGET_PRIOR_SETTINGS = {
    "Q1": {"recent_days": 10, "recent_weight": 0.0},
    "Q2": {"recent_days": 15, "recent_weight": 1.0},
    "S3": {"recent_days": 30, "recent_weight": 1.0},
}
FINAL_BAGGING_SEEDS = [42, 2025, 777]
FALLBACK_ALPHA = 0.80
MODEL_NAMES = ["lightgbm", "xgboost", "catboost", "extra_trees", "logistic"]

# --- fixed values: daily statistics of each row value ---------------------------
HR_PLAN = {
    "hr_n": ["sum", "mean", "max"],
    "hr_sum": ["sum", "mean", "max"],
    "hr_mean": ["mean", "std", "min", "max"],
    "hr_std": ["mean", "max"],
    "hr_min": ["min", "mean"],
    "hr_max": ["max", "mean"],
    "hr_median": ["mean", "std"],
}
USAGE_PLAN = {
    "usage_events": ["sum", "mean", "max"],
    "usage_total_time": ["sum", "mean", "max"],
    "usage_max_time": ["mean", "max"],
    "usage_unique_apps": ["sum", "mean", "max"],
}
AMBIENCE_PLAN = {
    "ambience_n": ["sum", "mean", "max"],
    "ambience_prob_sum": ["sum", "mean", "max"],
    "ambience_top_prob": ["mean", "std", "min", "max"],
    "ambience_entropy": ["mean", "std", "min", "max"],
}

# --- fixed values: model profiles -----------------------------------------------------------
MODEL_PROFILES = {
    "lightgbm": {"kind": "boost", "growth": "leaf", "trees": 800, "step": 0.025, "leaves": 11, "min_rows": 12, "min_hessian": 1e-3,
                 "row_share": 0.85, "column_share": 0.82, "l1": 0.08, "l2": 2.5},
    "xgboost": {"kind": "boost", "growth": "level", "trees": 700, "step": 0.025, "depth": 3, "min_hessian": 4.0,
                "row_share": 0.85, "column_share": 0.82, "l1": 0.05, "l2": 2.0},
    "catboost": {"kind": "boost", "growth": "symmetric", "trees": 800, "step": 0.025, "depth": 4, "l2": 6.0},
    "extra_trees": {"kind": "forest", "trees": 700, "min_rows": 4, "column_share": 0.65},
    "logistic": {"kind": "lr", "C": 0.45, "max_iter": 4000},
}

# --- fixed values: search grids (start, stop, count; both ends included) ----
ALPHA_GRID = (0.0, 1.0, 21)
SHRINK_GRID = (0.0, 0.4, 41)
TEMPERATURE_GRID = (0.5, 1.35, 86)

# --- fixed values: quick mode ------------------------------------------------
QUICK_N_SPLITS = 3
QUICK_MAX_TRAIN_ROWS = 120
QUICK_MAX_TEST_ROWS = 80
QUICK_TREE_ESTIMATORS = 120

# --- fixed values: parameter search space (path, kind, params) --------------
SEARCH_SPACE = [
    ("training.model_blend_power", "uniform", (1.5, 5.0)),
    ("training.weak_model_loss_ratio", "uniform", (1.05, 1.35)),
    ("training.prior.subject_smoothing", "uniform", (3.0, 20.0)),
    ("training.prior.recent_smoothing", "uniform", (1.0, 10.0)),
    ("training.prior.default_recent_weight", "uniform", (0.0, 0.7)),
    ("training.models.lightgbm.n_estimators", "int", (500, 1500, 100)),
    ("training.models.xgboost.n_estimators", "int", (400, 1400, 100)),
    ("training.models.catboost.iterations", "int", (500, 1500, 100)),
    ("training.models.extra_trees.n_estimators", "int", (400, 1200, 100)),
    ("training.n_splits", "choice", [5, 7, 10]),
]
N_PARAMS_PER_TRIAL_MIN = 1
N_PARAMS_PER_TRIAL_MAX = 3
PERTURB_SHARE = 0.6


def linspace(start: float, stop: float, count: int) -> list[float]:
    """Evenly spaced grid, both ends included (small, parameter-sized)."""
    if count == 1:
        return [float(start)]
    step = (stop - start) / (count - 1)
    vals = [i * step + start for i in range(count)]
    vals[-1] = float(stop)
    return vals
