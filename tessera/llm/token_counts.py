"""Operator 3: exact token counts from a histogram of encoded lengths.

Documents are encoded once and aggregated to ``(n_tokens, documents)``; each Python
task already sends one row a distinct length.  Running sums from the far end over the
histogram answer, for every context limit, how many documents are longer, how many
tokens they hold, and the total after truncation; sums from the near end give
quantiles.

The histogram is cut into blocks of ``BLOCK`` lengths, so no task needs all lengths:
sums run inside a block, and the far smaller table of blocks brings the rest.

Defined cases: null text is the empty text, of length 0; very long texts are encoded whole;
repeated rows, and rows that tie in any column, count each; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _tokens
from tessera.llm._tables import arrow_map, stored

BLOCK = 256


def _lengths(batches, path):
    import pyarrow as pa

    ids = _tokens.encoder(path, added=True)
    counts: dict[int, int] = {}
    for batch in batches:
        for text in batch.column(0):
            n = len(ids(text.as_py() or ""))
            counts[n] = counts.get(n, 0) + 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "documents"])


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens, documents``: exact histogram of encoded lengths."""
    found = arrow_map(docs.select("text"), partial(_lengths, path=path or _tokens.default_path()), "n_tokens long, documents long")
    return found.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def length_table(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram as a context limit: ``documents`` and ``tokens``
    of just L, ``documents_over``/``tokens_over`` beyond L, ``total_tokens``,
    ``truncated_tokens`` if every document is cut to L, ``quantile``: the share of
    documents of at most L.  Between two lengths, totals are linear in the limit."""
    h = stored(histogram, "lengths").withColumn("tokens", F.col("n_tokens") * F.col("documents")).withColumn("b", F.floor(F.col("n_tokens") / BLOCK))
    far = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("b").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("d").over(far), F.lit(0)).alias("d_far"),
        F.coalesce(F.sum("t").over(far), F.lit(0)).alias("t_far"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    inside = Window.partitionBy("b").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.join(blocks, "b").withColumn("documents_over", F.coalesce(F.sum("documents").over(inside), F.lit(0)) + F.col("d_far"))
    rows = rows.withColumn("tokens_over", F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_far"))
    return rows.select(
        "n_tokens",
        "documents",
        "tokens",
        "documents_over",
        "tokens_over",
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("documents_over")).alias("truncated_tokens"),
        (1 - F.col("documents_over") / F.col("d_all")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to ``limit``, from :func:`length_table`."""
    top = table.where(F.col("n_tokens") <= limit).orderBy(F.col("n_tokens").desc()).limit(1).first()
    if top is None:  # all are longer
        return limit * (table.agg(F.sum("documents")).first()[0] or 0)
    return top["total_tokens"] - top["tokens_over"] + limit * top["documents_over"]


def length_quantile(table: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents do not exceed."""
    return table.where(F.col("quantile") >= share - 1e-12).agg(F.min("n_tokens")).first()[0]
