"""Row numbers and running sums that no single task has to make alone.

A window over a whole table, or over a group with a third of all rows, runs in one
task.  Here rows are dealt to buckets by a hash or by ranges first; counts of buckets
give each its offset, and windows run inside buckets only.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import double_array, hash_number, missing


def hashed_row_number(df: DataFrame, ids: list[str], within: list[str], seed: int = 0, buckets: int = 256, name: str = "rn") -> DataFrame:
    """Row number (from 1) in the order of a hash of ``ids`` inside each ``within`` group."""
    out = df.withColumn("__h", hash_number(*[F.col(c) for c in ids], seed=seed))
    out = out.withColumn("__b", F.floor(F.col("__h") * buckets / F.lit(1 << 32)).cast("int"))
    counts = out.groupBy(*within, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    on = [out[c].eqNullSafe(offsets[f"__{c}"]) for c in within] + [out["__b"] == offsets["__ob"]]
    inside = Window.partitionBy(*within, "__b").orderBy("__h", *ids)
    rows = out.join(offsets, on).withColumn(name, (F.row_number().over(inside) + F.col("__o")).cast("long"))
    return rows.drop("__h", "__b", "__ob", "__o", *[f"__{c}" for c in within])


def running_sums(df: DataFrame, value: str, sums: list[str], within: list[str] | None = None, buckets: int = 64, descending: bool = False) -> DataFrame:
    """``run_{c}``: sum of c over all rows up to and with the row's value, inside each
    ``within`` group.  Values must be distinct there (aggregate first)."""
    within = within or []
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    b = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(value) > c)) if cuts else F.lit(0)
    rows = df.withColumn("__bucket", b)
    order = (lambda c: F.col(c).desc()) if descending else F.col
    inside = Window.partitionBy(*within, "__bucket").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy(order("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*within, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    totals = totals.select(*[F.col(c).alias(f"__k_{c}") for c in within], F.col("__bucket").alias("__of"), *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    on = [rows[c].eqNullSafe(totals[f"__k_{c}"]) for c in within] + [rows["__bucket"] == totals["__of"]]
    out = rows.join(totals, on).withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"__o_{c}") for c in sums})
    return out.drop("__bucket", "__of", *[f"__o_{c}" for c in sums], *[f"__k_{c}" for c in within])


def exact_quantiles(df: DataFrame, column: str, at: list[float], buckets: int = 4096) -> list[float]:
    """The values that ``percentile`` gives, which gathers all distinct ones in one task.

    Cuts from a sketch deal the values to buckets, whose exact counts tell where each wanted
    value stands; only the buckets that hold one are sorted.  Poor cuts make buckets larger,
    never a result different.  Empty if there is no value."""
    from pyspark.ml.feature import Bucketizer

    rows = df.select(missing(F.col(column).cast("double")).alias("__x")).where("__x is not null")
    cuts = rows.agg(F.percentile_approx("__x", double_array([k / buckets for k in range(1, buckets)]), 10_000)).first()[0]
    if not cuts:
        return []
    splits = [-inf, *sorted(set(cuts)), inf]
    rows = Bucketizer(splits=splits, inputCol="__x", outputCol="__b").transform(rows).withColumn("__b", F.col("__b").cast("int"))
    counts = dict(rows.groupBy("__b").count().collect())
    ends = list(accumulate(counts.get(b, 0) for b in range(len(splits) - 1)))
    starts = [0, *ends]
    places = [(ends[-1] - 1) * a for a in at]
    wanted = [(b := bisect_right(ends, r), r - starts[b]) for r in sorted({r for p in places for r in (floor(p), ceil(p))})]
    need = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({b}, {r}L)' for b, r in wanted)} AS t(__of, __r)")  # two rows a quantile at most
    held = rows.where(f"__b in ({','.join(str(b) for b in sorted({b for b, _ in wanted}))})").groupBy("__b", "__x").agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy("__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__to", F.sum("__n").over(inside))
    found = held.join(F.broadcast(need), (F.col("__b") == F.col("__of")) & (F.col("__r") < F.col("__to")) & (F.col("__r") >= F.col("__to") - F.col("__n")))
    value = {starts[b] + r: x for b, r, x in found.select("__b", "__r", "__x").collect()}
    between = lambda p, low, high: value[low] if value[low] == value[high] else (high - p) * value[low] + (p - low) * value[high]
    return [between(p, floor(p), ceil(p)) for p in places]


def nth_in_group(df: DataFrame, group: list[str], order: list[str | Column], last: int | None = None, name: str = "nth") -> DataFrame:
    """Position of a row in its group, from 0; positions from ``last`` on share it."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn(name, (F.least(n, F.lit(last)) if last is not None else n).cast("long"))


def forward_backward_fill(df: DataFrame, columns: list[str], group: list[str], order: list[str]) -> DataFrame:
    """Last known value before a row, else the first known after it, inside its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns})
