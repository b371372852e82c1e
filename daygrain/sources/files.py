"""CSV / parquet / JSON sources and sinks, history, versions, bundles.

All paths are Hadoop paths (local, HDFS, object stores); listings go through
the Hadoop FileSystem API of the session, never through a machine-local folder.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

HISTORY_SCHEMA = ("trial_id int, logloss double, elapsed_sec double, param_overrides map<string,double>, "
                  "submission_path string, timestamp string, strategy string, error string")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


# --- A1 -------------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


# --- A3 -------------------------------------------------------------------------------
def create_new(spark: SparkSession, path: str) -> bool:
    """Creates an empty file unless it exists; of several writers at once one gets True.

    Distributed file systems create without overwriting in one step; on a local one the Java call that does so is used.
    """
    fs, p = _fs(spark, path)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(p.getParent())
        return bool(spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile())
    try:
        fs.create(p, False).close()
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    return True


def fingerprint(spark: SparkSession, name: str, inputs: list[str], **params) -> str:
    """A digest of a plan's name and parameters and of its input files' paths, sizes and times."""
    files = []
    for path in inputs:
        fs, p = _fs(spark, path)
        found = fs.listFiles(p, True)
        while found.hasNext():
            st = found.next()
            files.append([st.getPath().toString(), st.getLen(), st.getModificationTime()])
    return hashlib.sha256(json.dumps([name, params, sorted(files)], sort_keys=True, default=str).encode()).hexdigest()[:32]


def _built(spark: SparkSession, key: str) -> list[str]:
    """The finished tables of a key, the one that was finished first in front."""
    if not exists(spark, key):
        return []
    fs, p = _fs(spark, key)
    marks = [(st.getModificationTime(), st.getPath().getName()) for st in fs.listStatus(p)]
    return [n.removeprefix("ready-") for _, n in sorted(marks) if n.startswith("ready-")]


def cached_table(spark: SparkSession, base: str, name: str, inputs: list[str], build: Callable[[], DataFrame], force: bool = False, **params) -> DataFrame:
    """Read-through cache by content: the table built from the same plan, parameters and input files, or a new one.

    Changed inputs have another key, so a stale table is never read. Data are written first, into a folder of their own, and an empty
    file that names the folder is made last: a build that is cut short is not seen, and of several builders at once the table that
    was finished first is read from then on. ``force`` builds anew and drops the marks of earlier tables.
    """
    key = f"{base.rstrip('/')}/{name}-{fingerprint(spark, name, inputs, **params)}"
    before = _built(spark, key)
    if force or not before:
        own = uuid.uuid4().hex
        build().write.parquet(f"{key}/data-{own}")
        for old in before if force else ():
            fs, p = _fs(spark, f"{key}/ready-{old}")
            fs.delete(p, False)
        create_new(spark, f"{key}/ready-{own}")
    return spark.read.parquet(f"{key}/data-{_built(spark, key)[0]}")


# --- A4 / A5 ---------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; ``single_file`` only for small reports (one writer task)."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines (nested structs and maps kept), UTF-8; ``single_file`` only for small reports (one writer task)."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


# --- A6 / A7 / H10 -----------------------------------------------------------------------
def append_history(spark: SparkSession, records: list[dict], path: str) -> None:
    """Append trial records (a failed trial carries logloss = inf and its error text).

    Each call writes a folder of its own, so that appends at the same time do not meet in one commit.
    """
    rows = []
    for r in records:
        rows.append((int(r["trial_id"]), float(r.get("logloss", math.inf)), float(r.get("elapsed_sec", 0.0)),
                     {k: float(v) for k, v in (r.get("param_overrides") or {}).items()},
                     r.get("submission_path"), r.get("timestamp"), r.get("strategy"), r.get("error")))
    spark.createDataFrame(rows, HISTORY_SCHEMA).coalesce(1).write.mode("error").json(f"{path.rstrip('/')}/batch-{uuid.uuid4().hex}")


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant reader: blank and broken lines are dropped; ``Infinity`` parses as a double."""
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return (spark.read.schema(HISTORY_SCHEMA).option("mode", "DROPMALFORMED")
                 .option("allowNonNumericNumbers", True).option("recursiveFileLookup", True).json(path))


def best_from_history(history: DataFrame):
    """(params, logloss) of the first trial with the lowest finite log-loss, else (None, inf)."""
    ok = history.where(F.col("error").isNull() & (F.col("logloss") < float("inf")))
    row = ok.agg(F.min_by(F.struct("param_overrides", "logloss"), F.struct("logloss", "trial_id")).alias("b")).first()
    if row is None or row["b"] is None:
        return None, math.inf
    return dict(row["b"]["param_overrides"] or {}), float(row["b"]["logloss"])


def save_best(spark: SparkSession, path: str, params: dict, logloss: float, saved_at: str) -> None:
    df = spark.createDataFrame([(float(logloss), {k: float(v) for k, v in params.items()}, saved_at)],
                               "logloss double, params map<string,double>, saved_at string")
    write_json(df, path, single_file=True)


def load_best(spark: SparkSession, path: str):
    if not exists(spark, path):
        return None, math.inf
    row = spark.read.schema("logloss double, params map<string,double>, saved_at string") \
               .option("allowNonNumericNumbers", True).json(path).first()
    if row is None:
        return None, math.inf
    return dict(row["params"] or {}), float(row["logloss"]) if row["logloss"] is not None else math.inf


# --- A8 -----------------------------------------------------------------------------------
def _numbered(spark: SparkSession, base: str, pattern: str) -> list[int]:
    if not exists(spark, base):
        return []
    fs, p = _fs(spark, base)
    names = (st.getPath().getName() for st in fs.listStatus(p))
    return sorted(int(m[1]) for m in (re.fullmatch(pattern, n) for n in names) if m)


def versions(spark: SparkSession, base: str) -> list[int]:
    """The complete versions: those whose writer has finished."""
    return [n for n in _numbered(spark, base, r"version=(\d+)") if exists(spark, f"{base.rstrip('/')}/version={n}/_SUCCESS")]


def claim_version(spark: SparkSession, base: str) -> int:
    """The next number that no other writer has: its claim is a file that only one of them can create."""
    claims = f"{base.rstrip('/')}/_claims"
    n = max([0, *_numbered(spark, claims, r"(\d+)"), *_numbered(spark, base, r"version=(\d+)")]) + 1
    while not create_new(spark, f"{claims}/{n}"):
        n += 1
    return n


def write_versioned(df: DataFrame, base: str, fmt: str = "csv") -> tuple[str, int]:
    """Write to ``base/version=N``, N being claimed first; the highest complete version is "latest".

    Writers at the same time get different numbers, and none overwrites another's.
    """
    n = claim_version(df.sparkSession, base)
    path = f"{base.rstrip('/')}/version={n}"
    w = df.write.mode("error")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return path, n


def latest_version(spark: SparkSession, base: str) -> str | None:
    v = versions(spark, base)
    return f"{base.rstrip('/')}/version={v[-1]}" if v else None


# --- A9 ------------------------------------------------------------------------------------
def save_bundle(path: str, run: dict, config: dict) -> None:
    """Feature columns, fitted models, blend weights, alphas, calibration, report and config beside each other."""
    from daygrain.operators import train
    spark = run["matrix"].sparkSession
    spark.createDataFrame([(i, c) for i, c in enumerate(run["features"])], "position int, feature string") \
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/feature_columns")
    if "models" in run:
        train.save_models(spark, path, run["models"], train.single_class_targets(run["labels"]))
    run["weights"].write.mode("overwrite").parquet(f"{path}/model_weights")
    if "tuned" in run:
        run["tuned"]["alphas"].where("chosen").write.mode("overwrite").parquet(f"{path}/model_alpha")
        run["tuned"]["calibration"].where("chosen").write.mode("overwrite").parquet(f"{path}/calibration")
        write_json(run["report"], f"{path}/cv_results", single_file=True)
    spark.createDataFrame([(json.dumps(config, default=str),)], "config string") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/config")
