"""Operator 9: pack documents into token sequences by large-item matching and best fit.

A document is its ids and a closing id 0; one longer than the capacity is cut into
full pieces behind a first piece that holds the rest.  Only the number of pieces of
each length decides a packing, so the plan is made on that histogram (at most
``capacity`` rows, whatever the input) and bins of equal content are handled as one
pattern with a multiplicity:

* pieces above one third of the capacity stand at most two to a bin; the largest is
  paired greedily with the largest that still fits;
* smaller pieces, longest first, go to the bin with the smallest gap that takes them,
  else to a new bin.

Pieces then take their places by rank among those of equal length.  Ranks come from
counts per task and length, summed over tasks, so a length that holds a third of all
pieces is never gathered anywhere.

Defined cases: null text is empty: one piece, the closing id; very long texts are cut into
pieces, none is left out; repeated rows, and rows that tie in doc_id, are packed each; a null
doc_id stays null; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import partial
from itertools import groupby
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _tokens
from tessera.llm._tables import arrow_map, stored

CAPACITY = 2048


def _pieces(batches, path, capacity):
    import pyarrow as pa
    from pyspark import TaskContext

    ids = _tokens.encoder(path, added=True)
    part = TaskContext.get().partitionId()
    rank = np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        doc, piece, start, length, crc, rk = [], [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = np.append(ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
            first = len(t) % capacity or capacity
            cuts = [0, *range(first, len(t) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                doc.append(key)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(crc32(t[a:b].tobytes()))
                rk.append(rank[b - a])
                rank[b - a] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rk, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"],
        )


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """``(bins, lengths)``: so many bins with just these pieces, for a histogram of lengths."""
    done: list[tuple[int, tuple[int, ...]]] = []
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def put(gap, bins, content):
        if not bins:
            return
        if not gap:
            done.append((bins, content))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((bins, content))

    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            put(capacity - a, left.pop(a), (a,))
            large.pop()
            continue
        b = large[i]
        pairs = min(left[a], left[b]) if a != b else left[a] // 2
        if a == b and not pairs:
            # One is left over; it pairs with the next smaller, if there is any.
            if i == 0:
                put(capacity - a, left.pop(a), (a,))
                large.pop()
                continue
            b, pairs = large[i - 1], 1
        put(capacity - a - b, pairs, (a, b))
        for n in (a, b):
            left[n] -= pairs
        for n in {a, b}:
            if not left[n]:
                del left[n]
                large.remove(n)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            i = bisect_left(order, n)
            if i == len(order):
                per = capacity // n
                full, rest = divmod(c, per)
                put(capacity - per * n, full, (n,) * per)
                put(capacity - rest * n, 1 if rest else 0, (n,) * rest)
                break
            gap = order[i]
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            per = gap // n
            full = min(bins, c // per)
            put(gap - per * n, full, content + (n,) * per)
            c -= full * per
            rest = min(c, per) if full < bins and c < per else 0
            if rest:
                put(gap - rest * n, 1, content + (n,) * rest)
                c -= rest
            put(gap, bins - full - (1 if rest else 0), content)
    return done + [x for rows in gaps.values() for x in rows]


def _places(spark: SparkSession, counts: dict[int, int], capacity: int) -> DataFrame:
    """Intervals of ranks by length: with q = r - low, the piece of rank r in ``[low, high)``
    goes to sequence ``base + q // per``, as number ``q % per`` of equal pieces from ``at``
    on.  The number of rows is bounded by the plan (distinct lengths), not by the data."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins, content in plan_patterns(counts, capacity):
        at = 0
        for n, run in groupby(content):
            per = len(list(run))
            low = used.get(n, 0)
            used[n] = low + bins * per
            rows.append((n, low, low + bins * per, per, base, at))
            at += n * per
        base += bins
    return spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "of_length long, low long, high long, per long, base long, at long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = stored(
        arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partial(_pieces, path=path or _tokens.default_path(), capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"),
        "pieces",
    )
    by_task = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_task.select("part", "length", before.alias("first"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("k"))
    places = F.broadcast(_places(spark, counts, capacity))
    q = F.col("rank") - F.col("low")
    found = ranked.join(places, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(q / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + q % F.col("per") * F.col("length")).cast("long").alias("offset"))
