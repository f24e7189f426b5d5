"""Bag-of-token features: counts, tf-idf, SVD, topics and word vectors."""

from __future__ import annotations

from itertools import permutations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import text_or
from tessera.functions.vectors import group_statistics


def tokens_of(columns: list[str], missing_text: str = "none") -> Column:
    """Tokens ``{column}_{value}`` of categorical columns."""
    return F.array(*[F.concat(F.lit(f"{c}_"), text_or(F.col(c), missing_text)) for c in columns])


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)


def bags(df: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """``key, tokens``: all tokens of an entity, in an explicit order if one is given."""
    if order:
        rows = F.sort_array(F.collect_list(F.struct(*order, tokens_of(columns).alias("t"))))
        return df.groupBy(key).agg(F.flatten(F.transform(rows, lambda r: r["t"])).alias("tokens"))
    return df.groupBy(key).agg(F.flatten(F.collect_list(tokens_of(columns))).alias("tokens"))


def count_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, token, n``: token counts of an entity, combined map-side."""
    return df.select(key, F.explode(tokens_of(columns)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def tfidf_table(counts: DataFrame, key: str) -> DataFrame:
    """Adds ``tfidf = n * ln((docs + 1) / (df + 1))`` to a count table."""
    docs = counts.select(key).distinct().agg(F.count(F.lit(1)).alias("__m"))
    df = counts.groupBy(F.col("token").alias("__t")).agg(F.count(F.lit(1)).alias("__df"))
    both = counts.join(df, counts["token"] == df["__t"]).crossJoin(F.broadcast(docs))  # one row
    return both.select(key, "token", "n", (F.col("n") * F.log((F.col("__m") + 1) / (F.col("__df") + 1))).alias("tfidf"))


def vectorise(df: DataFrame, tokens: str, kind: str = "count", vocabulary: int = (1 << 31) - 1, least: int = 1) -> DataFrame:
    """``features``: count or tf-idf vector of an array of tokens, all of them by default."""
    counted = CountVectorizer(inputCol=tokens, outputCol="__tf", vocabSize=vocabulary, minDF=float(least)).fit(df).transform(df)
    if kind == "count":
        return counted.withColumnRenamed("__tf", "features")
    return IDF(inputCol="__tf", outputCol="features").fit(counted).transform(counted).drop("__tf")


def svd_features(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """``key, {name}_000..``: uncentred truncated SVD (U times S) of vectors, sign fixed so
    that each right vector's largest entry is positive."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = df.select(vector)
    width = rows.first()[0].size
    k = min(size, width)
    matrix = RowMatrix(rows.rdd.map(lambda r: Vectors.fromML(r[0])))
    svd = matrix.computeSVD(k)
    v = svd.V.toArray()
    v = v * [1 if v[abs(v[:, j]).argmax(), j] >= 0 else -1 for j in range(v.shape[1])]
    k = v.shape[1]
    broadcast = df.sparkSession.sparkContext.broadcast(v.copy())  # vocabulary times size; the SVD holds it on the driver

    def mapped(x):
        t = broadcast.value
        return (x.values @ t[x.indices] if hasattr(x, "indices") else x.toArray() @ t).tolist()  # sparse rows stay sparse

    y = df.select(key, F.udf(mapped, "array<double>")(vector).alias("__y"))
    return y.select(key, *[F.get("__y", F.lit(j)).alias(f"{name}_{j:03}") for j in range(k)])


def topic_features(df: DataFrame, key: str, vector: str, size: int, name: str, seed: int = 0, rounds: int = 20) -> DataFrame:
    """``key, {name}_000..``: topic shares of each row (LDA)."""
    found = LDA(k=max(2, size), maxIter=rounds, seed=seed, featuresCol=vector).fit(df).transform(df)
    a = vector_to_array("topicDistribution")
    return found.select(key, *[a.getItem(j).alias(f"{name}_{j:03}") for j in range(max(2, size))])


def text_vectors(df: DataFrame, key: str, column: str, kind: str = "tfidf", size: int = 64, least: int = 1) -> DataFrame:
    """Count or tf-idf vectors of a text, reduced by SVD."""
    rows = df.select(key, word_tokens(F.col(column)).alias("tokens"))
    return svd_features(vectorise(rows, "tokens", kind, least=least), key, "features", size, f"{column}_{kind}{size}")


def entity_vectors(df: DataFrame, key: str, columns: list[str], kind: str = "count", size: int = 5, reduce_by: str = "svd", name: str = "") -> DataFrame:
    """Vectors of an entity's categories."""
    v = vectorise(bags(df, key, columns), "tokens", kind)
    name = name or f"{kind}_{reduce_by}{size}_category"
    return svd_features(v, key, "features", size, name) if reduce_by == "svd" else topic_features(v, key, "features", size, name)


def category_pair_topics(df: DataFrame, columns: list[str], size: int = 5) -> dict[tuple[str, str], DataFrame]:
    """For each ordered pair of columns, a topic vector of each value of the first from the
    values of the second it stands with."""
    out = {}
    for a, b in permutations(columns, 2):
        v = vectorise(bags(df.where(F.col(a).isNotNull()), a, [b]), "tokens")
        out[a, b] = topic_features(v, a, "features", size, f"{a}_{b}_lda")
    return out


def each_category_vectors(df: DataFrame, key: str, columns: list[str], most: int = 5) -> DataFrame:
    """Count and tf-idf SVD features of each column alone, ``min(most, values - 1)`` wide,
    joined to the distinct entities."""
    out = df.select(key).distinct()
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for c in columns:
        n = min(most, sizes[c] - 1)
        if n < 1:
            continue
        for kind in ("count", "tfidf"):
            out = out.join(entity_vectors(df, key, [c], kind, n, name=f"{c}_{kind}_svd"), key, "left")
    return out


def word_vectors(df: DataFrame, tokens: str, size: int, window: int = 3, least: int = 1, rounds: int = 10, seed: int = 0):
    """A skip-gram model of arrays of tokens."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=tokens, outputCol="__w2v").fit(df)


def entity_word_statistics(df: DataFrame, key: str, columns: list[str], order: list[str], size: int = 5, seed: int = 0) -> DataFrame:
    """``key, dim`` and six statistics over the word vectors of an entity's tokens."""
    rows = bags(df, key, columns, order)
    vectors = word_vectors(rows, "tokens", size, seed=seed).getVectors().select(F.col("word").alias("__w"), vector_to_array("vector").alias("v"))
    words = rows.select(key, F.explode("tokens").alias("__t"))
    return group_statistics(words.join(vectors, F.col("__t") == F.col("__w"), "left"), [key], "v")


def array_word_statistics(df: DataFrame, key: str, tokens: str, size: int | None = None, seed: int = 0, rounds: int = 100, svd: int = -1) -> DataFrame:
    """``key, {tokens}_w2v_{statistic}_{i}``: mean, median, sum, min, max and population std of
    each dimension over the word vectors of an array's tokens; the size is a quarter of the
    distinct tokens if none is given.  With ``svd`` of 2 or more ``{statistic}_svd_000..`` of that
    size stand in their place.  Keys are distinct; one without tokens has nulls (with svd as zeros)."""
    if size is None:
        size = max(2, df.select(F.explode(tokens).alias("t")).agg(F.count_distinct("t")).first()[0] // 4)
    model = word_vectors(df, tokens, size, window=1, rounds=rounds, seed=seed)
    vectors = model.getVectors().select(F.col("word").alias("__w"), vector_to_array("vector").alias("__v"))
    words = df.select(key, F.explode(tokens).alias("__t")).join(vectors, F.col("__t") == F.col("__w"))
    names = ("mean", "median", "sum", "min", "max", "std")
    long = group_statistics(words, [key], "__v", F.stddev_pop)
    wide = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("__s"))  # `size` structs a key
    wide = df.select(key).join(wide, key, "left")
    if svd < 2:
        return wide.select(key, *[F.get("__s", F.lit(i))[n].alias(f"{tokens}_w2v_{n}_{i}") for n in names for i in range(size)])
    out = df.select(key)
    for n in names:
        x = F.coalesce(F.transform(F.col("__s")[n], lambda e: F.coalesce(F.nanvl(e, F.lit(0.0)), F.lit(0.0))), F.array_repeat(F.lit(0.0), size))
        out = out.join(svd_features(wide.select(key, array_to_vector(x).alias("__x")), key, "__x", svd, f"{tokens}_w2v_{n}_svd"), key, "left")
    return out


def pretrained_mean(df: DataFrame, key: str, text: str, vectors: DataFrame, size: int) -> DataFrame:
    """``key, vector``: mean of given word vectors ``(word, vector)``; a word is looked up as
    written, lower-case, upper-case and capitalised, in that order.  No hit: zeros."""
    words = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\s+")).alias("i", "w"))
    tries = [F.col("w"), F.lower("w"), F.upper("w"), F.initcap("w")]
    long = words.select(key, "i", F.posexplode(F.array(*tries)).alias("p", "word")).join(vectors, "word")
    best = long.groupBy(key, "i").agg(F.min_by("vector", "p").alias("vector"))
    means = best.select(key, F.posexplode("vector").alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    rows = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s"))  # `size` structs a key
    found = rows.select(key, F.transform("s", lambda e: e["x"]).alias("vector"))
    return df.select(key).distinct().join(found, key, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))


def encoded(df: DataFrame, key: str, text: str, encoder, size: int, pool: str = "mean") -> DataFrame:
    """``key, vector`` from an injected ``encoder(list of texts) -> list of token vectors``;
    token vectors pool by mean, max or the first.  Sentence models are not part of this
    library; the caller brings one."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for m in encoder(pdf["__t"].tolist()):
                m = np.asarray(m, dtype=float).reshape(-1, size)
                out.append((np.zeros(size) if not len(m) else m[0] if pool == "first" else m.max(axis=0) if pool == "max" else m.mean(axis=0)).tolist())
            yield pd.DataFrame({key: pdf[key], "vector": out})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.coalesce(text, F.lit("")).alias("__t")).mapInPandas(run, f"{key} {kind}, vector array<double>")


def translated(df: DataFrame, key: str, text: str, translate) -> DataFrame:
    """``key, text`` through an injected ``translate(list of texts) -> list of texts``."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": translate(pdf["__t"].tolist())})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.coalesce(text, F.lit("")).alias("__t")).mapInPandas(run, f"{key} {kind}, text string")
