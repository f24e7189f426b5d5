"""A registry of queries: a function and, where SQL can express it, its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unique row key of lineitem (order and line number alone repeat).
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded as doubles, so that the order of summation does not show."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def whole(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def spread(df: DataFrame, key: str) -> DataFrame:
    """For heavy work per row: deal a table of fewer files than cores to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df
