"""Sources and sinks: CSV, Parquet, JSON, run folders, folds, predictions, models."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "utf-8") -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, where: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet with equality filters and a projection, both pushed to the scan."""
    df = spark.read.parquet(path)
    for c, v in (where or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df.select(*columns) if columns else df


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All run folders that a pattern names, with their folder as ``run``."""
    return spark.read.parquet(pattern).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written in full."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def convert(spark: SparkSession, source: str, target: str, schema=None) -> None:
    """CSV to Parquet."""
    read_csv(spark, source, schema).write.mode("overwrite").parquet(target)


def write_folds(df: DataFrame, path: str, ids: list[str]) -> None:
    df.select(*ids, "fold").write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str, row_id: str) -> None:
    df.select(row_id, "prediction").write.mode("overwrite").parquet(path)


def write_submission(predictions: DataFrame, sample: DataFrame, path: str, row_id: str, target: str) -> None:
    """CSV with a row for each of the sample; a missing or extra row is an error."""
    p = predictions.select(F.col(row_id).alias("__id"), F.col("prediction").alias("__p"))
    rows = sample.select(row_id).join(p, F.col(row_id) == F.col("__id"), "full")
    bad = rows.agg(F.coalesce(F.sum((F.col(row_id).isNull() | F.col("__p").isNull()).cast("long")), F.lit(0))).first()[0]
    if bad:
        raise ValueError(f"{bad} rows of predictions and sample do not match")
    rows.select(row_id, F.col("__p").alias(target)).write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, value: dict) -> None:
    """Metrics and settings; numbers of other libraries become plain ones."""

    def plain(x):
        if hasattr(x, "tolist"):
            return x.tolist()
        return str(x)

    Path(path).write_text(json.dumps(value, default=plain, indent=2))


def downcast(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest type that holds their range."""
    whole = [c for c, t in df.dtypes if t in ("bigint", "int", "smallint")]
    if not whole:
        return df
    r = df.agg(*[f(c).alias(f"{n}_{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]).first()
    casts = {}
    for c in whole:
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        if lo is not None:
            casts[c] = F.col(c).cast(next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= lo and hi < 1 << b))
    return df.withColumns(casts)
