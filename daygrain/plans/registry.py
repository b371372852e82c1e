"""Named queries (``queries()``) and their DuckDB oracles (``oracle_sql()``).

Every query reads the driver tables through the views V1..V7 and returns a
lazy DataFrame whose double columns are rounded to 6 places; every oracle is
independent SQL over the same tables, rounded the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrain.functions.exprs import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def _load_all():
    # importing the modules fills QUERIES / ORACLES
    from daygrain.plans import q_daily, q_nested, q_spine, q_matrix, q_model, q_fit, q_sweep, q_cells  # noqa: F401


def all_queries() -> dict:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load_all()
    return dict(ORACLES)
