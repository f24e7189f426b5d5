"""Operator 7 [native]: one-permutation MinHash fingerprints.

The hashes of a text's five-word shingles are binned once by their top bits; a bin
keeps its smallest hash.  An empty bin borrows from a full one by optimal
densification: every bin has its own fixed random order of all bins and takes the
first full one, however late, so two texts that share a bin borrow alike.  Of each bin ``BITS`` low
bits are stored, packed in 64-bit words; the likeness of two fingerprints is the share
of equal bins, corrected for chance agreement: ``(same - c) / (1 - c)``, ``c = 2^-BITS``.

Only DataFrame functions are used.  Fingerprints are made row by row; only the query
that pairs neighbours in the order of doc_id moves texts, once, dealt by ranges of
doc_id so that a window never spans more than one range.

Defined cases: null text is the empty text, whose fingerprint is the empty string
(likeness 1 to another empty one, else 0); texts of one to four words are one shingle;
equal texts have equal fingerprints; very long texts are read whole; of equal doc_ids the
smaller text comes first and a null doc_id comes last (rows that tie in doc_id are ordered
by one task); a table of one row is its own next document; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import let, word_array
from tessera.llm.quality_rules import _range

WIDTH, BINS, BITS, PROBES = 5, 256, 4, 12
_SHIFT = 63 - BINS.bit_length() + 1
_LOW = (1 << _SHIFT) - 1
_PER_LONG = 64 // BITS


def _orders() -> tuple[list[int], list[int]]:
    """Of every bin the odd step and the start of its order of all bins (fixed hashes):
    attempt t looks at bin ``start + t * step``, so ``BINS`` attempts see each bin once."""

    def mixed(x: int) -> int:
        x &= (1 << 64) - 1
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        return (x ^ (x >> 29)) >> 40

    steps = [mixed(b * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F) % BINS | 1 for b in range(BINS)]
    starts = [mixed(b * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) % BINS for b in range(BINS)]
    return steps, starts


def _literal(values: list[int], kind: str) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """63-bit hashes of the word shingles; one of all words if there are fewer."""
    mask = F.lit((1 << 63) - 1)

    def grams(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]).bitwiseAND(mask))
        short = F.array(F.xxhash64(h).bitwiseAND(mask))
        return F.when(F.size(h) >= width, full).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), grams)


def bin_minima(hashes: Column) -> Column:
    """Smallest hash of every bin as ``BINS`` longs, null where a bin is empty."""
    ends = _literal([(b << _SHIFT) | _LOW for b in range(BINS)], "bigint")

    def first(a: Column) -> Column:
        mine = F.filter(a, lambda x, k: (k == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(a, k - 1), _SHIFT)))
        return F.transform(mine, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW), x.bitwiseAND(F.lit(_LOW))))

    return let(F.sort_array(F.concat(hashes, ends)), first)


def densified(minima: Column) -> Column:
    """Fill empty bins: the first full bin in the bin's own order of all bins.  The first
    ``PROBES`` attempts look bins up; for the few bins that found none, the attempt that
    would reach each full bin is worked out and the earliest taken, which is the same rule."""
    steps, starts = _orders()
    tables = [_literal([(s + t * a) % BINS for a, s in zip(steps, starts, strict=True)], "int") for t in range(PROBES)]
    back, first = _literal([pow(a, -1, BINS) for a in steps], "int"), _literal(starts, "int")

    def fill(v: Column) -> Column:
        def late(b: Column) -> Column:
            attempt = lambda k: F.pmod(F.get(back, b) * (k - F.get(first, b)), F.lit(BINS))
            full = F.transform(v, lambda x, k: F.when(x.isNotNull(), F.struct(attempt(k).alias("o"), x.alias("x"))))
            return F.array_min(F.filter(full, lambda s: s.isNotNull()))["x"]

        return F.transform(v, lambda x, b: F.coalesce(x, *[F.get(v, F.get(t, b)) for t in tables], late(b)))

    return let(minima, fill)


def packed(values: Column) -> Column:
    """``BITS`` low bits of every bin, ``64 / BITS`` bins to a long."""
    part = lambda v, i: F.aggregate(F.slice(v, i * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    # The bin is hashed in, so that bins that borrow one value agree by chance independently.
    bits = F.transform(values, lambda x, b: F.xxhash64(x, b))
    return let(bits, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), lambda i: part(v, i)))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """Packed fingerprint as an array of longs; empty for a text without words."""
    return let(shingle_hashes(text, width), lambda h: F.when(F.size(h) > 0, packed(densified(bin_minima(h)))).otherwise(F.array().cast("array<bigint>")))


def as_text(fp: Column) -> Column:
    """Lower-case hex of a packed fingerprint."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _spread(d: Column, by: int) -> Column:
    return let(d, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, by)))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins, from 0 to 1."""
    low = F.lit(sum(1 << (BITS * k) for k in range(_PER_LONG)))

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for k in range(BITS.bit_length() - 1):
            d = _spread(d, 1 << k)
        return F.bit_count(d.bitwiseAND(low))

    same = 1 - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    both, one = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both, 1.0).when(one, 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (hex); no shuffle."""
    return docs.withColumn("fingerprint", as_text(fingerprint(F.col("text"))))


def _ranges(docs: DataFrame, ranges: int) -> Column:
    """Number of the range that a row's doc_id falls in, descending; null last."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / ranges for k in range(1, ranges)], 100 * ranges).alias("c")).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # Two levels, so that a row compares with about 2 sqrt(ranges) cuts.
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    coarse = _literal([g[-1] for g in groups], "bigint") if cuts else F.array().cast("array<bigint>")
    fine = F.expr(f"from_json('{groups}', 'array<array<bigint>>')")
    over = lambda a, i: F.size(F.filter(a, lambda c: i <= c))
    top = over(coarse, F.col("doc_id").cast("long"))
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(let(top, lambda t: t * step + F.coalesce(over(F.get(fine, t), F.col("doc_id").cast("long")), F.lit(0)))).cast("int")


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each row with its fingerprint and the text and fingerprint of the next row in
    descending doc_id (after the last: the first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    number = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("r", _ranges(rows, number))
    # The first rows of every range stand once more, as ghosts, after the end of the range before.
    heads = rows.groupBy("r").agg(F.max("doc_id").alias("h"))
    order = Window.orderBy("r")  # a row per range
    heads = heads.withColumn("to", F.coalesce(F.lag("r").over(order), F.max("r").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.select(F.col("r").alias("hr"), "h", "to")
    # Of rows that tie in doc_id at a head, the one with the smallest text is first.
    ghosts = rows.join(F.broadcast(heads), (rows["r"] == heads["hr"]) & rows["doc_id"].eqNullSafe(heads["h"])).groupBy(F.col("h").alias("doc_id"), F.col("to").alias("r")).agg(F.min("text").alias("text"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    both = both.withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("r").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("ghost = 0").drop("ghost", "r")
