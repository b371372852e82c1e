"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Defaults for local runs and tests. On a cluster the submitter's settings win:
# ``get_session`` fills only keys that are still unset.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # a small Python task answers in a few milliseconds; over loopback TCP it waits for a delayed acknowledgement
    "spark.python.unix.domain.socket.enabled": "true",
    # model fits are submitted from a thread pool: let their small jobs interleave
    "spark.scheduler.mode": "FAIR",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "daygrain", extra: dict | None = None) -> SparkSession:
    """Session with the defaults above for every key that is still unset.

    An active session keeps all its settings. Otherwise the keys named by the submitter
    (spark-submit, spark-defaults.conf) are read first and left as they are; only
    ``extra``, ``master`` and ``shuffle_partitions``, which the caller asks for, override.
    """
    asked = dict(extra or {})
    if shuffle_partitions:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in asked.items():
            if active.conf.isModifiable(k):
                active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    named = SparkConf()  # loads spark.* of the submitter
    for k, v in _LOCAL_DEFAULTS.items():
        if not named.contains(k):
            builder = builder.config(k, v)
    for k, v in asked.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Root of the shared folder for lineage cuts.

    ``spark.checkpoint.dir`` as the session names it. Only on a local master, as in
    tests, is a scratch folder made where it is unset; on a cluster that is an error,
    since a folder of one machine is not seen by the others. The context's own
    checkpoint folder is registered once and never again (Spark makes a new
    sub-folder on every registration).
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="daygrain-ckpt-", dir=os.environ.get("DAYGRAIN_SCRATCH", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


#: Tables written by ``materialize`` and not yet removed, in order.
_WRITTEN: list[str] = []


def materialize(df, as_table: bool = True, by: list[str] = ()):
    """Cut the lineage of a reused intermediate table in the shared checkpoint folder.

    The table is written there as parquet and read back, so a lost executor re-reads files instead of recomputing from
    the sources; ``scratch`` removes it. ``as_table=False`` makes a reliable ``checkpoint()``, which Spark's own cleaner removes.
    ``by``: columns of few values with a folder for each.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not as_table:
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "tables")
    df.write.mode("error").partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the intermediate tables that were written inside; what is still needed must be written elsewhere before."""
    start = len(_WRITTEN)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _WRITTEN[start:]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        del _WRITTEN[start:]
