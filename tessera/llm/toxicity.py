"""Operator 4: toxicity severity by cumulative-link ordinal regression.

Features of a text are sparse: 64-bit hashes of its lower-case words and of their stems
(first 4 to 8 bytes), since inflected languages mark the stem.  From a bounded sample of
labelled rows all features that mark toxic texts (``LEAST`` texts or more, log odds above
``MARK``) are taken, and one weight vector with ordered thresholds is fitted:
``P(grade > k) = sigmoid(w.x - theta_k)``, x being which of them occur, how many, and
the share of the text's words they mark.  The weights are shared by all thresholds.
The expected severity is the sum of these probabilities.

The labels say toxic or not; grades 1 to 3 split the toxic sample into thirds by the
share of marked words (few, some, many).  ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` bound
the sample; it is the rows with the smallest hash of doc_id, without near copies of
one another.  Feature counts of the sample are summed by Spark; only the chosen features
and their places reach the driver.  Scoring covers every word of every text and moves no text.

Defined cases: texts without a word, null ones too, have severity 0 and stay; very long
texts are read whole; repeated rows, and rows that tie in doc_id, score by their own text;
of texts that tie in a labelled doc_id the first in order is the sample's; without toxic or
without clean labelled texts no model can be fitted and all severities are 0; labels that
name a document twice use the larger; an empty table gives an empty result; extra columns
are ignored, whatever their names, and pass ``without_toxic`` unchanged.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words
from tessera.llm._tables import arrow_map, scratch, stored

SAMPLE_TOXIC, SAMPLE_CLEAN, SEED = 1500, 3000, 5
PREFIXES, GRADES, REJECT, LEAST, MARK = (4, 5, 6, 8), 3, 0.2, 4, 3.0


def _features(column):
    """Per chunk: owner of every feature and the feature; words per text."""
    for i, j, data, offs in _words.chunks(column):
        _, _, hashes, bounds, more = _words.scan(data, offs, _words.table_alnum(), _words.lower_table(), PREFIXES)
        yield i, j, hashes, bounds, more


def _owner(bounds, index):
    return np.searchsorted(bounds, index, side="right") - 1


def _sampled(batches, of):
    """Of each sampled text: its words and a few min-hashes, or its features with their counts."""
    import pyarrow as pa

    for batch in batches:
        keys = batch.column(0).to_pylist()
        if of == "sketch":
            words, sketches = [], []
        for i, j, hashes, bounds, more in _features(batch.column(1)):
            if of == "sketch":
                pairs, pb = _words.shingles(hashes, bounds, 3)
                words += np.diff(bounds).tolist()
                sketches += [np.unique(pairs[pb[k] : pb[k + 1]])[:6].view(np.int64).tolist() for k in range(j - i)]
                continue
            owners = [_owner(bounds, ix) for ix, _ in more]
            for k in range(j - i):
                own = [hashes[bounds[k] : bounds[k + 1]]]
                for o, (_, h) in zip(owners, more, strict=True):
                    a, b = np.searchsorted(o, (k, k + 1))
                    own.append(h[a:b])
                f, c = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), keys[i + k])), pa.array(f.view(np.int64)), pa.array(c.astype(np.int64))], names=["row", "feature", "times"])
        if of == "sketch":
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["row", "words", "sketch"])


class Sparse:
    """A 0/1 matrix from the places of its ones, with dense columns at its right."""

    def __init__(self, rows, cols, shape, dense):
        self.rows, self.cols, self.sparse, self.dense = rows, cols, shape, dense
        self.shape = (shape[0], shape[1] + dense.shape[1])

    def __matmul__(self, w):
        m = self.sparse[1]
        return np.bincount(self.rows, w[:m][self.cols], self.sparse[0]) + self.dense @ w[m:]

    @property
    def T(self):  # noqa: N802
        return _Turned(self)


class _Turned:
    def __init__(self, x):
        self.x = x

    def __matmul__(self, v):
        return np.concatenate([np.bincount(self.x.cols, v[self.x.rows], self.x.sparse[1]), self.x.dense.T @ v])


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 400, ridge: float = 0.02, rate: float = 0.1):
    """Weights and ordered thresholds of ``P(y > k) = sigmoid(x.w - theta_k)``, by Adam on
    the cumulative-link likelihood."""
    n, m = x.shape
    weight = np.full(n, 1 / n)
    # theta_0, and the logs of the steps to the following ones, keep the order.
    p = np.zeros(m + grades)
    p[m] = 1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[:m], np.exp(p[m + 1 :])
        theta = p[m] + np.concatenate([[0], np.cumsum(gaps)])
        z = x @ w
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None], -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        prob = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        low, high = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        d = weight / prob
        gz = -(low - high) * d
        gt = np.array([(low * d)[y == k + 1].sum() - (high * d)[y == k].sum() for k in range(grades)])
        grad = np.concatenate([x.T @ gz + ridge * w / m, [gt.sum()], [gt[k:].sum() * gaps[k - 1] for k in range(1, grades)]])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    theta = p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])
    return p[:m].copy(), theta


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, seed: int = SEED, least: int = LEAST) -> dict | None:
    """Model from at most ``toxic_rows + clean_rows`` labelled texts; None if a class is missing."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("o", F.xxhash64("doc_id", F.lit(seed)))
    some = known.where("toxic > 0").orderBy("o", "doc_id").limit(toxic_rows).union(known.where("toxic = 0").orderBy("o", "doc_id").limit(clean_rows))
    chosen = F.broadcast(some.select(F.col("doc_id").alias("row"), "toxic"))  # bounded by the sample
    with scratch():
        sample = docs.select(F.col("doc_id").cast("long").alias("row"), "text").join(chosen, "row").groupBy("row", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        sample = stored(sample, "toxic_sample")
        texts = sample.select("row", "text")
        of = {r["row"]: r["toxic"] > 0 for r in sample.select("row", "toxic").collect()}  # bounded by the sample, as are the sketches
        sketches = arrow_map(texts, partial(_sampled, of="sketch"), "row long, words long, sketch array<long>").collect()
        rows, words, seen = [], [], set()
        for r in sorted(sketches, key=lambda r: r["row"]):  # drop near copies: their words would pass for marks
            if r["sketch"] and sum(v in seen for v in r["sketch"]) * 2 >= len(r["sketch"]):
                continue
            seen.update(r["sketch"])
            rows.append(r["row"])
            words.append(max(1, r["words"]))
        toxic = np.array([of[r] for r in rows], dtype=bool)
        if not toxic.any() or toxic.all():
            return None
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        kept = docs.sparkSession.createDataFrame(list(zip(rows, range(len(rows)), toxic.astype(int).tolist(), strict=True)), "row long, at int, toxic int")
        places = stored(arrow_map(texts, partial(_sampled, of="features"), "row long, feature long, times long").join(F.broadcast(kept), "row"), "toxic_features")
        counts = places.groupBy("feature").agg(F.sum("toxic").alias("d1"), F.count("*").alias("d"))
        odds = F.log(F.col("d1") / n1 + 1e-9) - F.log((F.col("d") - F.col("d1") + 1) / n0)
        marks = counts.where((F.col("d1") >= least) & (odds > MARK)).select("feature")
        found = places.join(marks, "feature").select("feature", "at", "times").toArrow()
    return _fit(found["feature"].to_numpy().view(np.uint64), found["at"].to_numpy(), found["times"].to_numpy(), toxic, np.array(words))


def _fit(features, at, times, toxic, words) -> dict | None:
    """Model from the chosen features' places in the sample."""
    if not len(features):
        return None
    ids, place = np.unique(features, return_inverse=True)
    n = len(toxic)
    share = np.bincount(at, times, n) / words
    order = np.lexsort((place, at))
    dense = np.stack([np.log1p(np.bincount(at, minlength=n)), np.log1p(100 * share)], axis=1)
    x = Sparse(at[order], place[order], (n, len(ids)), dense)
    y = np.zeros(n, dtype=np.int64)
    y[toxic] = 1 + np.searchsorted(np.quantile(share[toxic], [1 / 3, 2 / 3]), share[toxic], side="right")
    w, theta = fit_ordinal(x, y, GRADES)
    return {"ids": ids, "weights": w, "theta": theta, "sample": (int(toxic.sum()), int((~toxic).sum()))}


def _score(batches, model):
    import pyarrow as pa

    if model is not None:
        ids, w, theta = model["ids"], model["weights"], model["theta"]
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(ids >> np.uint64(44)).astype(np.int64)] = True
    for batch in batches:
        n = batch.num_rows
        z, marked, distinct, words, empty = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n, dtype=bool)
        if model is not None:
            for i, j, hashes, bounds, more in _features(batch.column(1)):
                empty[i:j] = np.diff(bounds) == 0
                words[i:j] = np.maximum(1, np.diff(bounds))
                rows, cols = [], []
                for index, h in [(None, hashes), *more]:
                    near = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
                    at = np.searchsorted(ids, h[near])
                    ok = at < len(ids)
                    ok[ok] = ids[at[ok]] == h[near][ok]
                    rows.append(_owner(bounds, near[ok] if index is None else index[near[ok]]))
                    cols.append(at[ok])
                rows, cols = np.concatenate(rows), np.concatenate(cols)
                marked[i:j] = np.bincount(rows, minlength=j - i)
                pair = np.unique(rows * len(ids) + cols)
                distinct[i:j] = np.bincount(pair // len(ids), minlength=j - i)
                z[i:j] = np.bincount(pair // len(ids), weights=w[pair % len(ids)], minlength=j - i)
            z += w[-2] * np.log1p(distinct) + w[-1] * np.log1p(100 * marked / words)
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None], -40, 40)))
            above[empty] = 0
        else:
            above = np.zeros((n, GRADES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= REJECT)],
            names=["doc_id", "severity", "grade", "p_toxic", "rejected"],
        )


def severity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, severity`` (expected grade, 0 to 3), ``grade, p_toxic, rejected``."""
    model = train(docs, labels, **options)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partial(_score, model=model), "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def _keep(batches, model, at):
    import pyarrow as pa

    for batch in batches:
        two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
        (scored,) = _score([two], model)
        yield batch.filter(pa.compute.invert(scored.column(4)))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns."""
    model = train(docs, labels, **options)
    return arrow_map(docs, partial(_keep, model=model, at=docs.columns.index("text")), docs.schema)
