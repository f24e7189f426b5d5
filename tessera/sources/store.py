"""Feature tables: made once, kept as Parquet by name and split, joined on the row id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import join_all
from tessera.sources.readers import exists

FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def feature(name: str):
    """Register a function from the stacked rows (``row_id, split, ...``) to features
    (``row_id, split`` and its own columns)."""

    def put(f):
        if name in FEATURES:
            raise ValueError(f"feature {name!r} stands twice")
        FEATURES[name] = f
        return f

    return put


def make(rows: DataFrame, folder: str, names: list[str] | None = None, force: bool = False) -> list[str]:
    """Write the tables of features that are not there yet; returns those made."""
    made = []
    for n in names or sorted(FEATURES):
        path = f"{folder.rstrip('/')}/{n}"
        if force or not exists(rows.sparkSession, path):
            FEATURES[n](rows).write.mode("overwrite").partitionBy("split").parquet(path)
            made.append(n)
    return made


def load(spark: SparkSession, folder: str, names: list[str], split: str) -> DataFrame:
    """Features of one split side by side; equal column names are an error."""
    tables = [spark.read.parquet(f"{folder.rstrip('/')}/{n}").where(F.col("split") == split).drop("split") for n in names]
    return join_all(tables, ["row_id"])
