"""Operator 5 [native]: base quality rules and a hashed n-gram log-likelihood ratio.

Word one- and two-grams are hashed to ``buckets``.  Two multinomials over the buckets,
one of the trusted documents and one of the whole raw corpus, give every bucket a log
ratio; a document's score is the mean log ratio of its n-grams (length-normalised),
and it is kept when the score reaches ``threshold``.  Counts are exact over all rows.

Only DataFrame functions are used.  The n-gram counts are pre-aggregated map-side to
at most ``buckets`` rows a task; the table of log ratios has ``buckets`` doubles, a bound
that does not grow with the data, and is a literal of the plan.

Defined cases: null text has no words, all counts 0 and fails the base rules; texts
under five words have no repeated windows; very long texts are read whole; repeated rows
count as often as they stand, and rows that tie in doc_id are each rated by their own text;
labels that name a document twice count it once; without trusted documents the ratio
is 0 for all; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import let, stored, word_array

BUCKETS, THRESHOLD, SMOOTHING, WINDOW = 16384, -0.15, 1.0, 5
MIN_WORDS, REPEAT_SHARE = 10, 20
BROADCAST_LABELS = 4_000_000
_BLANK = " \t\x0b\x0c\r"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _range(first: Column, last: Column) -> Column:
    """``first..last``, empty if it has no member."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of ``window`` words found twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def places(pairs: Column) -> Column:
        twice = F.filter(F.transform(pairs, lambda x, k: F.when(F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull())
        return let(F.sort_array(twice), covered)

    def grams(h: Column) -> Column:
        at = _range(F.lit(0), F.size(h) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def count(g: Column) -> Column:
        some = let(F.sort_array(g), lambda s: F.exists(_range(F.lit(1), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k - 1)))
        full = let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
        return F.when(some, full).otherwise(F.lit(0).cast("long"))

    return let(hashes, lambda h: let(grams(h), count))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def gram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the one- and two-grams of word hashes."""
    one = lambda h: F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = lambda h: F.transform(_range(F.lit(1), F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(buckets)).cast("int"))
    return let(hashes, lambda h: F.concat(one(h), two(h)))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``ratios``: by bucket, the log of target over raw probability, from exact
    counts over all rows of ``docs``; all 0 without trusted documents."""
    good = trusted.select(F.col("doc_id").alias("__good")).where("__good is not null").distinct().withColumn("__salt", F.lit(0).cast("long"))
    if trusted.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    # Rows without an id match nothing; by their texts they spread over all tasks.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    flagged = docs.select("doc_id", "text", salt.alias("__of")).join(good, (F.col("doc_id") == F.col("__good")) & (F.col("__of") == F.col("__salt")), "left")
    grams = flagged.select(F.col("__good").isNotNull().cast("long").alias("t"), F.explode(gram_buckets(_hashes(word_array(F.col("text"))), buckets)).alias("b"))
    counts = stored(grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")), "gram_counts")  # at most `buckets` rows
    raw, target = counts.agg(F.sum("n"), F.sum("t")).first()
    smooth, raw, target = float(smoothing), raw or 0, target or 0
    share = F.log((F.coalesce("t", F.lit(0)) + smooth) / (F.coalesce("n", F.lit(0)) + smooth)) + F.log(F.lit((raw + smooth * buckets) / (target + smooth * buckets)))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left")
    value = share if target else F.lit(0.0)
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", value.alias("v")))), lambda x: x["v"]).alias("ratios"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratios of :func:`ratio_table`."""
    return list(ratio_table(docs, trusted, buckets, smoothing).first()["ratios"])


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """Counts, base verdict, score and final verdict of every row of ``docs``."""
    ratios = ",".join(map(repr, log_ratios(docs, trusted, buckets, smoothing)))
    table = F.split(F.lit(ratios), ",").cast("array<double>")  # folded to one literal
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select("doc_id", "text", word_array(F.col("text")).alias("words"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, w: x + F.length(w).cast("long"))
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.nullif(F.size(g), F.lit(0))
    rows = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        total(F.col("words")).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        _hashes(F.col("words")).alias("h"),
    )
    rows = rows.select("*", repeated_words(F.col("h")).alias("n_repeat_words"), let(gram_buckets(F.col("h"), buckets), mean).alias("score")).drop("h")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("score", F.lit(0.0)) >= threshold))
