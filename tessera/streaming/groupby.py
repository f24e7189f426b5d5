"""Group-by features over a stream: windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.groupby import AGGREGATES

#: Aggregates that a stream can keep as partial sums.
STREAMABLE = ("mean", "std", "min", "max", "sum", "count")


def windowed(stream: DataFrame, time: str, key: list[str], var: str, aggs: tuple[str, ...] = ("mean", "sum", "count"), size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``window, key, {agg}_{var}`` of a stream or a batch, late rows up to ``late`` counted."""
    bad = [a for a in aggs if a not in STREAMABLE]
    if bad:
        raise ValueError(f"not for streams: {bad}")
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, size, slide or size).alias("window"), *key).agg(*[AGGREGATES[a](F.col(var)).alias(f"{a}_{var}") for a in aggs])
