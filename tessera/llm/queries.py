"""The ten operators and the pipeline as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, html_extract, license_scan, mixing, ngram_join, packing, quality_rules, secret_scan, token_counts, toxicity
from tessera.llm._tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spread(table(spark, sf_dir, "pages"), "page_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "class_size")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.length_histogram(documents(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality(documents(spark, sf_dir), labels)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(documents(spark, sf_dir)).drop("spans")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.neighbours(documents(spark, sf_dir))
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fp", "next_fp", fingerprints.fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("fp")).alias("fingerprint"), fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"), fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.taken_rows(mixing.mixture(documents(spark, sf_dir)))
    return found.select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_token_counts, op4_toxicity, op5_quality_rules, op6_license_scans, op7_document_fingerprints, op8_secret_scans, op9_best_fit_packing, op10_source_mixing)}

#: SQL where it can give the whole result; the others are tested against brute force.
ORACLES: dict[str, str] = {}
