"""Smoothed per-subject priors, fold-aware and for prediction rows.

Subject statistics of a fold's history are totals minus the fold's own sums, all from
one aggregate at (target, subject, fold), so the subject prior needs no row expansion. The recent prior (last N rows of
a subject's history) expands the labelled rows by the validation folds (at
most ``n_splits`` x) and keeps the top N per (target, fold, subject) with a
literal ``rn <= N`` filter, which Spark runs as a partial WindowGroupLimit in
every map task before the shuffle; a hot subject never ships more than N rows
per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from daygrain.constants import (DEFAULT_RECENT_WEIGHT, RECENT_DAYS, RECENT_SMOOTHING, SUBJECT_SMOOTHING,
                                TARGET_PRIOR_SETTINGS)
from daygrain.functions.exprs import clip_proba, dlit
from daygrain.operators import ranges as rg
from daygrain.session import materialize


class PriorSettings:
    """Per-target prior parameters: a handful of rows, kept on the driver and broadcast when joined."""

    SCHEMA = ("target string, recent_days int, recent_weight double, "
              "subject_smoothing double, recent_smoothing double")

    def __init__(self, rows: list[tuple]):
        self.rows = rows

    @property
    def max_days(self) -> int:
        return max(r[1] for r in self.rows)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


def prior_settings(spark: SparkSession | None, targets: list[str], *, recent_days: int = RECENT_DAYS,
                   default_recent_weight: float = DEFAULT_RECENT_WEIGHT,
                   subject_smoothing: float = SUBJECT_SMOOTHING, recent_smoothing: float = RECENT_SMOOTHING,
                   target_settings: dict | None = None) -> PriorSettings:
    """One row per target; per-target overrides as in the reference's target settings."""
    ts = TARGET_PRIOR_SETTINGS if target_settings is None else target_settings
    rows = []
    for t in targets:
        cfg = ts.get(t, {})
        rows.append((t, int(cfg.get("recent_days", recent_days)),
                     float(cfg.get("recent_weight", default_recent_weight)),
                     float(subject_smoothing), float(recent_smoothing)))
    return PriorSettings(rows)


def _settings_df(settings, spark: SparkSession) -> DataFrame:
    return settings.to_df(spark) if isinstance(settings, PriorSettings) else settings


def _max_days(settings) -> int:
    if isinstance(settings, PriorSettings):
        return settings.max_days
    return int(settings.agg(F.max("recent_days")).first()[0])


def _tail(rows: DataFrame, groups: list[str], ord_col: str, max_n: int) -> DataFrame:
    """Last ``recent_days`` rows (by ``ord_col``) per group; ``max_n`` is the literal upper bound."""
    w = Window.partitionBy(*groups).orderBy(F.col(ord_col).desc(), F.col("key").desc())
    return (rows.withColumn("_rn", F.row_number().over(w))
                .where(F.col("_rn") <= F.lit(max_n))
                .where(F.col("_rn") <= F.col("recent_days")))


# --- fold-aware (OOF) -------------------------------------------------------------------
def oof_prior_components(labels: DataFrame, folds: DataFrame, settings, *,
                         subject: str = "subject_id", ord_col: str = "ord", checkpoint: bool = True) -> DataFrame:
    """Per validation row: history mean ``mu``, subject history (hist_s, hist_n), recent tail (rec_s, rec_n)."""
    max_n = _max_days(settings)
    settings = _settings_df(settings, labels.sparkSession)
    tr = (labels.where(F.col("split") == "train")
                .select("target", "key", subject, ord_col)
                .join(folds.select("target", "key", "y", "fold"), ["target", "key"]))
    if checkpoint:
        # every statistic below re-reads the labelled rows: read them from one materialised copy
        tr = materialize(tr)
    # one aggregate over the rows; totals and global means come from its (target, subject, fold) rows
    cells = tr.groupBy("target", subject, "fold").agg(F.sum("y").alias("Sf"), F.count(F.lit(1)).alias("Nf"))
    w_t = Window.partitionBy("target")
    mu = (cells.groupBy("target", "fold").agg(F.sum("Sf").alias("Sf"), F.sum("Nf").alias("Nf"))
               .select("target", "fold", ((F.sum("Sf").over(w_t) - F.col("Sf")).cast("double")
                                          / (F.sum("Nf").over(w_t) - F.col("Nf")).cast("double")).alias("mu")))
    # recent tail: training rows expanded by the validation folds they serve (fold <> vf)
    vf = mu.select("target", F.col("fold").alias("vf"))
    exp = (tr.join(F.broadcast(vf), (tr.target == vf.target) & (tr.fold != vf.vf)).drop(vf.target)
             .join(F.broadcast(settings.select("target", "recent_days")), "target"))
    tail = (_tail(exp, ["target", "vf", subject], ord_col, max_n)
            .groupBy("target", F.col("vf").alias("fold"), subject)
            .agg(F.sum("y").alias("rec_s"), F.count(F.lit(1)).alias("rec_n")))
    w_s = Window.partitionBy("target", subject)
    stats = (cells.select("target", "fold", subject, (F.sum("Sf").over(w_s) - F.col("Sf")).alias("hist_s"),
                          (F.sum("Nf").over(w_s) - F.col("Nf")).alias("hist_n"))
                  .join(tail, ["target", "fold", subject], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (tr.select("target", "key", subject, "y", "fold")
              .join(F.broadcast(mu), ["target", "fold"])
              .join(stats, ["target", "fold", subject], "left")
              .select("target", "key", subject, "y", "fold", "mu",
                      zero("hist_s"), zero("hist_n"), zero("rec_s"), zero("rec_n")))


def prior_value(subject_smoothing=None, recent_smoothing=None, recent_weight=None) -> F.Column:
    """G9 over component columns: clip((1 - w) * subject + w * recent), with C3/C4 fallbacks.

    Subject: (hist_s + s * mu) / (hist_n + s), global mean when the subject has no history.
    Recent: (rec_s + r * mu) / (rec_n + r), subject prior when the tail is empty.
    """
    s = F.col("subject_smoothing") if subject_smoothing is None else subject_smoothing
    r = F.col("recent_smoothing") if recent_smoothing is None else recent_smoothing
    w = F.col("recent_weight") if recent_weight is None else recent_weight
    mu = F.col("mu")
    subj = F.when(F.col("hist_n") > 0,
                  (F.col("hist_s").cast("double") + s * mu) / (F.col("hist_n").cast("double") + s)).otherwise(mu)
    rec = F.when(F.col("rec_n") > 0,
                 (F.col("rec_s").cast("double") + r * mu) / (F.col("rec_n").cast("double") + r)).otherwise(subj)
    return clip_proba((dlit(1.0) - w) * subj + w * rec)


def prior_oof(labels: DataFrame, folds: DataFrame, settings, **kw) -> DataFrame:
    """G9 on validation rows: (target, key, fold, prior), each row scored by the other folds."""
    comp = oof_prior_components(labels, folds, settings, **kw)
    return (comp.join(F.broadcast(_settings_df(settings, labels.sparkSession)), "target")
                .select("target", "key", "fold", prior_value().alias("prior")))


# --- prediction rows -------------------------------------------------------------------
def predict_prior_components(labels: DataFrame, settings, *, subject: str = "subject_id",
                             ord_col: str = "ord", checkpoint: bool = True) -> DataFrame:
    """Per prediction row: components from all training rows of the target."""
    max_n = _max_days(settings)
    settings = _settings_df(settings, labels.sparkSession)
    tr = labels.where(F.col("split") == "train").select("target", "key", subject, ord_col, "y")
    if checkpoint:
        tr = materialize(tr)
    pr = labels.where(F.col("split") == "predict").select("target", "key", subject)
    g = tr.groupBy("target").agg((F.sum("y").cast("double") / F.count(F.lit(1)).cast("double")).alias("mu"))
    s = tr.groupBy("target", subject).agg(F.sum("y").alias("hist_s"), F.count(F.lit(1)).alias("hist_n"))
    tail = (_tail(tr.join(F.broadcast(settings.select("target", "recent_days")), "target"),
                  ["target", subject], ord_col, max_n)
            .groupBy("target", subject).agg(F.sum("y").alias("rec_s"), F.count(F.lit(1)).alias("rec_n")))
    return (pr.join(F.broadcast(g), "target")
              .join(s, ["target", subject], "left")
              .join(tail, ["target", subject], "left")
              .select("target", "key", subject, "mu",
                      F.coalesce("hist_s", F.lit(0)).alias("hist_s"), F.coalesce("hist_n", F.lit(0)).alias("hist_n"),
                      F.coalesce("rec_s", F.lit(0)).alias("rec_s"), F.coalesce("rec_n", F.lit(0)).alias("rec_n")))


def prior_predict(labels: DataFrame, settings, **kw) -> DataFrame:
    comp = predict_prior_components(labels, settings, **kw)
    return comp.join(F.broadcast(_settings_df(settings, labels.sparkSession)), "target").select("target", "key", prior_value().alias("prior"))


# --- as of a day ---------------------------------------------------------------------------
def _history(rows: DataFrame, group: list[str], gap, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """As-of merge by prefix sums: (queries with n and s of the group's labels before ord - gap, labels with their number and sum so far)."""
    label = rows.select("target", "subject_id", "key", F.col("ord").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n"), F.col("y").cast("long").alias("s"))
    # a query stands before the labels of its own position
    query = rows.select("target", "subject_id", "key", (F.col("ord") - F.lit(gap)).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"))
    merged = rg.running_sums(label.unionByName(query), group, ["at", "kind", "key"], ["n", "s"], ranges)
    sums = [F.col("n_upto").alias("n"), F.col("s_upto").alias("s")]
    return merged.where("kind = 0").select("target", "key", "subject_id", *sums), merged.where("kind = 1").select(*group, *sums)


def prior_as_of(labels: DataFrame, settings, gap=0, subject: str = "subject_id", ord_col: str = "ord", ranges: int | None = None) -> DataFrame:
    """(target, key, hist_n, rec_n, prior) of every labelled row from labels strictly before it: those with ord < ord - gap.

    The global mean, the subject's history and its last N labels are all as of that position (0.5 before any label), so no
    label of the same or a later position reaches a prior. Sums come from ranges of (target, subject, position); a tail
    is the difference of two prefix sums, N labels apart. ``ord`` must be a number and (ord, key) unique in a target.
    """
    settings = _settings_df(settings, labels.sparkSession)
    rows = materialize(labels.where(F.col("split") == "train").where("y is not null").select(
        "target", F.col(subject).alias("subject_id"), "key", F.col(ord_col).alias("ord"), "y"), as_table=True)
    every, _ = _history(rows, ["target"], gap, ranges)
    own, sums = _history(rows, ["target", "subject_id"], gap, ranges)
    own = own.join(F.broadcast(settings), "target").withColumn("from_n", F.col("n") - F.col("recent_days"))
    start = sums.select(F.col("target").alias("_t"), F.col("subject_id").alias("_s"), F.col("n").alias("_n"), F.col("s").alias("start_s"))
    tail = own.join(start, (F.col("target") == F.col("_t")) & F.col("subject_id").eqNullSafe(F.col("_s")) & (F.col("from_n") == F.col("_n")), "left")
    mu = every.select("target", "key", F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n")).otherwise(dlit(0.5)).alias("mu"))
    comp = tail.join(mu, ["target", "key"]).withColumns({
        "hist_n": F.col("n"), "hist_s": F.col("s"), "rec_n": F.least("n", "recent_days"), "rec_s": F.col("s") - F.coalesce("start_s", F.lit(0))})
    return comp.select("target", "key", F.col("hist_n").cast("long").alias("hist_n"), F.col("rec_n").cast("long").alias("rec_n"), prior_value().alias("prior"))


# --- D16 / D17 / C3 on their own ---------------------------------------------------------
def subject_prior(labels: DataFrame, smoothing: float = SUBJECT_SMOOTHING, subject: str = "subject_id") -> DataFrame:
    """(target, subject, global mean, smoothed subject mean) over all training rows."""
    tr = labels.where(F.col("split") == "train")
    g = tr.groupBy("target").agg(F.avg(F.col("y").cast("double")).alias("global_mean"))
    s = tr.groupBy("target", subject).agg(F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return (s.join(F.broadcast(g), "target")
             .select("target", subject, "global_mean",
                     ((F.col("_s").cast("double") + dlit(smoothing) * F.col("global_mean"))
                      / (F.col("_n").cast("double") + dlit(smoothing))).alias("subject_prior")))


def recent_prior(labels: DataFrame, settings, subject: str = "subject_id",
                 ord_col: str = "ord") -> DataFrame:
    """Smoothed mean of the last N training rows of every subject (N per target)."""
    max_n = _max_days(settings)
    settings = _settings_df(settings, labels.sparkSession)
    tr = labels.where(F.col("split") == "train")
    g = tr.groupBy("target").agg(F.avg(F.col("y").cast("double")).alias("global_mean"))
    tail = _tail(tr.join(F.broadcast(settings.select("target", "recent_days", "recent_smoothing")), "target"),
                 ["target", subject], ord_col, max_n)
    agg = tail.groupBy("target", subject, "recent_smoothing").agg(F.sum("y").alias("_s"),
                                                                   F.count(F.lit(1)).alias("_n"))
    return (agg.join(F.broadcast(g), "target")
               .select("target", subject, F.col("_n").alias("n_recent"),
                       ((F.col("_s").cast("double") + F.col("recent_smoothing") * F.col("global_mean"))
                        / (F.col("_n").cast("double") + F.col("recent_smoothing"))).alias("recent_prior")))


def prior_lookup(rows: DataFrame, priors: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subject prior for each row, the target's global mean for subjects never seen."""
    g = priors.select("target", "global_mean").distinct()
    return (rows.join(F.broadcast(g), "target")
                .join(priors.select("target", subject, "subject_prior"), ["target", subject], "left")
                .withColumn("prior", F.coalesce("subject_prior", "global_mean"))
                .drop("subject_prior"))
