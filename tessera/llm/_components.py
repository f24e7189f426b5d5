"""Connected components of an edge table by alternating star contraction.

Each round is two aggregations and joins over the edges; no group is collected.
Rounds are cut by tables in shared storage, of which only the newest stays; their
number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import dropped, stored


def _print(df: DataFrame):
    return df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` of any direction → ``(u, v)``: every node that is not the
    smallest of its component, with that smallest node.  Null ends are dropped."""
    e = edges.where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _print(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct(), name)
        dropped(last)
        after = _print(e)
        if after == before:
            break
        before = after
    return e
