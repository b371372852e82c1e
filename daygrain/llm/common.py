"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daygrain.session import materialize, scratch_path
from daygrain.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A null id takes part as this value: all null ids count as one id after all others.
NULL_ID = 2**63 - 1


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` does just that, and much faster than ``translate``, where no other character has a lower case.
    """
    return F.when(c.rlike(r"[\p{javaUpperCase}\p{Lt}&&[^A-Z]]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def as_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    return materialize(df, as_table=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Shared:
    """A broadcast value with a key under which a worker may keep what it builds from it."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


__all__ = ["DataFrame", "LOWER", "NULL_ID", "Shared", "SparkSession", "UPPER", "as_table", "ascii_lower", "fresh",
           "materialize", "read_table", "scratch_path"]
