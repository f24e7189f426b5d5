"""Operator 10 [native]: mix sources to target weights by pivotal dependent rounding.

Every source gets a target of words; a document is taken ``floor(r)`` times plus a
random remainder with probability ``r - floor(r)``, where r is target over source
size.  The remainders are rounded together: two partners at a time exchange
probability so that their expected words stay the same, until one of them is integral
(taken or not); the other goes on with what is left and meets the next.  Groups of about
``group`` documents fold this way in parallel and pass one residual each to the next
level of a reduction tree; the last residual of a source is rounded by its own
probability.  Partners meet longest first, so that long documents settle among themselves;
one that meets only far shorter ones exchanges words with all of them together (see
``_fold``).  A source misses its target by less than one document, as a rule a short one.

Rows repeated in full are one unit of n documents: of their n equal remainders, pairwise
rounding leaves ``floor(n p)`` taken and one fraction, which is the unit's remainder.

All randomness is a hash of the seed and ids, so reruns agree.  Only DataFrame
functions are used.  A hot source is dealt to as many groups as it needs; a group
collects at most a few hundred small structs.  Sources are ranked inside ranges of their
names, and the targets' common level is found by sums, so no task needs all sources.

Defined cases: null text has size 0 and very long texts count all their words; documents
of size 0 round like those of one word, and take 0 words; documents that tie in doc_id, or have none,
but differ in text, source or any other column are units of their own; rows repeated in
full are taken equally often, but some once more; null source is a source of its own, last
in order; sources of size 0 get target 0; an empty table gives an empty result; extra
columns are kept by ``mixed`` and otherwise only tell rows apart, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.llm._tables import scratch, stored, word_count

SEED, GROUP, CAP, WEIGHTS, GAP = 17, 512, 3, (1, 2, 3), 4
#: Sources up to this number are broadcast with their targets; beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 500_000, 32
#: Keys (16 bytes) of rows repeated in full up to this number are broadcast.
BROADCAST_KEYS = 1_000_000
#: Ranges that source names are ranked in, and the names that their cuts are chosen from.
RANGES, CUT_SAMPLE = 64, 4096


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``: number of the source from 0 in code-point order, null last."""
    # Cuts of a bounded sample of names; ranks are exact whatever the cuts.
    some = sorted(r[0] for r in sizes.where("source is not null").orderBy(F.xxhash64("source"), "source").limit(CUT_SAMPLE).select("source").collect())
    cuts = some[:: len(some) // RANGES][1:] if len(some) >= RANGES else []
    if not cuts:
        return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)  # fewer rows than ranges
    part = F.when(F.col("source").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("source"))) if cuts else F.lit(0))
    rows = sizes.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("low") + inside - 1).drop("part", "low")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: shares of the total by repeating weight
    in code-point order (null last), never above ``cap`` times the source's size, what is
    over being shared again by weight.

    At a common level t a source gets ``min(weight * t, cap * size)``.  The level starts at
    total over weights and rises while sources fill up: each step spreads what the full
    ones leave over the weights of the others, from three sums over the sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(_numbered(sizes).withColumn("w", w).withColumn("full", cap * F.col("source_size") / F.col("w")), "places")
    total, weight = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level, total = (total or 0) / (weight or 1), total or 0
    while True:
        over = F.col("full") <= level
        used, left = rows.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("w")))).first()
        if not left:
            level = float("inf")
            break
        new = (total - cap * (used or 0)) / left
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("w") * F.lit(level), cap * F.col("source_size")).cast("double").alias("target"))


_KEYS = ["doc_id", "size", "k1", "k2", "n"]
_ITEM = "struct<rank:double,key:bigint,doc_id:bigint,size:bigint,k1:bigint,k2:bigint,n:bigint,weight:double,sure:bigint,p:double>"
_FIELDS = ["rank", "key", *_KEYS, "weight", "sure"]
_DONE = "struct<doc_id:bigint,size:bigint,k1:bigint,k2:bigint,n:bigint,total:bigint>"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` where ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _done(x: str, p: str) -> str:
    keys = ", ".join(f"'{c}', {x}.{c}" for c in _KEYS)
    return f"named_struct({keys}, 'total', {x}.sure + if({p} > 0.5D, 1L, 0L))"


def _with_p(x: str, p: str) -> str:
    fields = ", ".join(f"'{f}', {x}.{f}" for f in _FIELDS)
    return f"named_struct({fields}, 'p', greatest(0D, least(1D, {p})))"


def _state(left: str, done: str, p: str, words: str) -> str:
    return f"named_struct('left', {left}, 'done', {done}, 'p', {p}, 'words', {words})"


def _exchange(p: str, words: str) -> str:
    """Two partners ``a`` and ``y``: words move from one to the other, so that the expected
    words of each stay, until one of them is integral and done; the other is left."""
    # "up" lifts a until a is taken or y is empty, "down" the other way.
    amounts = "named_struct('up', least((1 - a.p) * a.weight, y.p * y.weight), 'down', least(a.p * a.weight, (1 - y.p) * y.weight))"
    moved = """named_struct(
        'pa', if(lift, a.p + m.up / a.weight, a.p - m.down / a.weight),
        'py', if(lift, y.p - m.up / y.weight, y.p + m.down / y.weight),
        'a_done', if(lift, (1 - a.p) * a.weight <= y.p * y.weight, a.p * a.weight <= (1 - y.p) * y.weight))"""
    one = _state(_with_p("y", "r.py"), _done("a", "r.pa"), p, words)
    two = _state(_with_p("a", "r.pa"), _done("y", "r.py"), p, words)
    return _let("m", amounts, _let("lift", "coin * (m.up + m.down) < m.down", _let("r", moved, f"if(r.a_done, {one}, {two})")))


def _fold(items: str, seed: int, level: int) -> Column:
    """Fold fractions pairwise, longest first, to one; whoever becomes integral is done.

    In the first level all unmet documents have one probability, ``acc.p``.  Where the next
    one is shorter than a ``GAP``-th of the document that is left, hundreds of pairs might not
    settle the long one; its partner is then all the unmet ones together, if their words
    suffice to settle it either way: their common probability gives or takes them, and only
    the long document becomes integral."""
    mine = "x.n = 1" if level == 0 else "false"
    fewer = f"if({mine}, acc.words - x.weight, acc.words)"
    first = _state("y", f"CAST(NULL AS {_DONE})", "acc.p", fewer)
    settles = f"{mine} AND x.weight * {GAP} < a.weight AND (1 - a.p) * a.weight <= acc.p * acc.words AND a.p * a.weight <= (1 - acc.p) * acc.words"
    shifted = "greatest(0D, least(1D, if(coin < a.p, acc.p - (1 - a.p) * a.weight / acc.words, acc.p + a.p * a.weight / acc.words)))"
    pool = _let("q", shifted, _state(_with_p("x", "q"), _done("a", "if(coin < a.p, 1D, 0D)"), "q", fewer))
    coin = f"shiftrightunsigned(xxhash64({seed}, {level}, a.key, x.key), 11) / {float(1 << 53)!r}D"
    met = _let("coin", coin, f"if({settles}, {pool}, {_exchange('acc.p', fewer)})")
    step = _let("y", _with_p("x", f"if({mine}, acc.p, x.p)"), _let("a", "acc.left", f"if(a IS NULL, {first}, {met})"))
    alone = f"filter({items}, x -> x.n = 1)"
    step = step.replace("acc.", "acc.now.")
    start = _state(f"CAST(NULL AS {_ITEM})", f"CAST(NULL AS {_DONE})", f"coalesce(get({alone}, 0).p, 0D)", f"aggregate({alone}, 0D, (t, x) -> t + x.weight)")
    # What was done in the last step joins the list here, outside of every _let: those copy.
    out = "if(acc.now.done IS NULL, acc.out, concat(acc.out, array(acc.now.done)))"
    return F.expr(
        f"aggregate({items}, named_struct('out', CAST(array() AS array<{_DONE}>), 'now', {start}),"
        f" (acc, x) -> named_struct('out', {out}, 'now', {step}), acc -> named_struct('left', acc.now.left, 'out', {out}))"
    )


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell apart rows of equal doc_id, size and source."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if isinstance(f.dataType, (MapType, ArrayType, StructType)) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    names = F.lit("row")
    return F.xxhash64(names, *columns), F.xxhash64(F.lit("twin"), *reversed(columns))


def _identified(docs: DataFrame) -> DataFrame:
    one, two = _row_keys(docs)
    return docs.withColumns({"__tessera_doc": F.col("doc_id").cast("long"), "__tessera_source": F.col("source").cast("string"), "__tessera_size": word_count(F.col("text")), "__tessera_k1": one, "__tessera_k2": two})


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``doc_id, source, size, k1, k2, n, source_size, target, total``: one row for each
    distinct row of ``docs`` (``k1, k2`` hash it) with the number n of such rows and how
    often they are taken in all: each ``total div n`` times, ``total mod n`` of them once more."""
    with scratch() as keep:
        marked = _identified(docs)
        names = {"doc": "doc_id", "source": "source", "size": "size", "k1": "k1", "k2": "k2"}
        units = stored(marked.select(*[F.col(f"__tessera_{k}").alias(v) for k, v in names.items()]).groupBy(*names.values()).agg(F.count("*").alias("n")), "units")
        sizes = stored(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count("*").alias("members")), "sources")
        number, most = sizes.agg(F.count("*"), F.max("members")).first()
        per_source = stored(_joined(source_targets(sizes.select("source", "source_size"), weights, cap), sizes.select("source", "members"), number), "targets")
        ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
        rows = _joined(units, per_source.select("source", "members", ratio.alias("r")), number)
        want = F.col("n") * (F.col("r") - F.floor("r"))
        weight = F.greatest(F.col("size"), F.lit(1)).cast("double")
        rows = rows.select(
            "source",
            F.pmod(F.xxhash64(F.lit(seed + 1), "k1", "k2"), F.ceil(F.col("members") / group)).alias("g"),
            F.struct(
                F.when(F.col("n") > 1, -1e18).otherwise(-weight).alias("rank"), F.xxhash64(F.lit(seed), "k1", "k2").alias("key"), *_KEYS, weight.alias("weight"),
                (F.col("n") * F.floor("r") + F.floor(want)).cast("long").alias("sure"), (want - F.floor(want)).alias("p"),
            ).cast(_ITEM).alias("item"),
        )
        most, outs, level = most or 0, [], 0
        while True:
            folded = rows.groupBy("source", "g").agg(F.sort_array(F.collect_list("item")).alias("items")).select("source", "g", _fold("items", seed, level).alias("f"))
            folded = stored(folded.select("source", "g", "f.left", "f.out"), f"level{level}")
            outs.append(folded.select("source", F.explode("out").alias("d")).select("source", "d.*"))
            most = -(-most // group)
            if most <= 1:
                left = folded.select("source", "left.*")
                outs.append(left.select("source", *_KEYS, (F.col("sure") + (_uniform(F.lit(seed), F.lit("last"), F.col("key")) < F.col("p")).cast("long")).alias("total")))
                break
            level += 1
            rows = folded.select("source", F.floor(F.col("g") / group).cast("long").alias("g"), F.col("left").alias("item"))
        out = outs[0]
        for more in outs[1:]:
            out = out.unionByName(more)
        found = _joined(out, per_source.select("source", "source_size", "target"), number)
        return keep(found.select("doc_id", "source", "size", "k1", "k2", "n", "source_size", "target", "total"), "mixture")


def _joined(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """``rows`` with the columns of their source; a hot source is spread over salts."""
    right = sources.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if number <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), same).drop("__source")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = [c for c in rows.columns if c != "source"]
    left = rows.withColumn("__of", F.pmod(F.hash(*others), F.lit(SALTS)))
    return left.join(right, same & (F.col("__of") == F.col("__salt"))).drop("__source", "__salt", "__of")


def taken_rows(found: DataFrame) -> DataFrame:
    """The rows of :func:`mixture`, one for each row of the documents, with ``copies``."""
    each = found.withColumn("__place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.withColumn("copies", F.floor(F.col("total") / F.col("n")) + (F.col("__place") <= F.col("total") % F.col("n")).cast("long")).drop("__place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: left out, once, or repeated."""
    names = docs.columns
    plan = mixture(docs, **options).where("total > 0 or n > 1").select(F.col("k1").alias("__tessera_p1"), F.col("k2").alias("__tessera_p2"), F.col("n").alias("__tessera_n"), F.col("total").alias("__tessera_total"))
    one, two = _row_keys(docs)
    rows = docs.withColumns({"__tessera_k1": one, "__tessera_k2": two})
    same = (F.col("__tessera_k1") == F.col("__tessera_p1")) & (F.col("__tessera_k2") == F.col("__tessera_p2"))
    times = lambda df: df.withColumn("__tessera_copy", F.explode(F.expr("if(__tessera_total > 0, sequence(1L, __tessera_total), array())")))
    again = plan.where("__tessera_n > 1")
    number = again.count()
    if not number:
        return times(rows.join(plan, same)).select(*[f"`{c}`" for c in names])
    # Rows repeated in full collapse before they are moved, so that none of them is hot.
    keys = F.broadcast(again.select("__tessera_p1", "__tessera_p2")) if number <= BROADCAST_KEYS else again.select("__tessera_p1", "__tessera_p2")
    single = times(rows.join(keys, same, "left_anti").join(plan.where("__tessera_n = 1"), same)).select(*[f"`{c}`" for c in names])
    twice = rows.join(keys, same, "left_semi") if number <= BROADCAST_KEYS else rows
    twice = twice.groupBy("__tessera_k1", "__tessera_k2").agg(F.first(F.struct(*[f"`{c}`" for c in names])).alias("__tessera_row"))
    return single.unionByName(times(twice.join(again, same)).select("__tessera_row.*"))
