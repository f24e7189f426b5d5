"""A training-data pipeline over ``documents``, stage by stage.

Every stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and read
again as the next stage's documents.  The order: reject toxic documents, keep one
document of each near-duplicate class, redact secrets, mix the sources to target
weights, pack into token sequences.

Defined cases, for every stage: null and empty texts are documents without words, which
stay in the first three stages (as one class of copies in the second); very long texts are
read whole; rows that tie in doc_id, or have none, are documents of their own; rows
repeated in full pass the first and third stage each, leave one in the second and count as
copies in the mix; null sources are one source; an empty table passes all stages; extra
columns pass all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, secret_scan, toxicity
from tessera.llm._tables import dropped, scratch, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Model fits, exact set similarity and byte-pair ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES[:-1]:
        last = docs
        with scratch() as keep:  # what the stage stored for itself goes with it
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
