"""Statistics of array columns and of vector dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_statistics(v: Column) -> dict[str, Column]:
    """Mean, median, sum, max, min and population variance across an array."""
    x = F.transform(v, lambda e: e.cast("double"))
    n = F.nullif(F.size(x), F.lit(0))
    total = F.aggregate(x, F.lit(0.0), lambda a, e: a + e)
    squares = F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)
    s = F.array_sort(x)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return {"mean": total / n, "median": median, "sum": total, "max": F.array_max(x), "min": F.array_min(x), "var": squares / n - (total / n) * (total / n)}


def group_statistics(df: DataFrame, key: list[str], vector: str, std=F.stddev_samp) -> DataFrame:
    """``key, dim`` and mean, std, median, min, max, sum of each dimension in a group."""
    rows = df.select(*key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy(*key, "dim").agg(F.avg("x").alias("mean"), std("x").alias("std"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"))
