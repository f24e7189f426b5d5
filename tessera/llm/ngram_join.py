"""Operator 2: n-gram Jaccard self-join with a MinHash LSH forest.

Documents are sets of five-word shingles.  Texts with equal sets collapse to one
*node*.  Every node has a MinHash label in each of ``trees`` prefix tries.  The matched
prefix starts at ``MAX_DEPTH`` values and is shortened until a pair at the threshold meets
in some trie with the target probability (``1 - (1 - t^d)^trees >= recall``); the nodes
below one trie node at that depth are a bucket.  The threshold is one for all pairs, so
this depth is the same for every node and known before any row is read: only that many
values are made, and buckets are formed by a hash of the prefix instead of a sorted trie.
With the default target this is banding of 20 labels of 5 values.  Inside buckets, sketches
discard unlike pairs (a pair at the threshold is lost with probability below 1e-5 a bucket)
and leave a spanning forest of candidates, whose components meet once more for exact
verification on whole shingle sets.

Hot groups: a bucket or component of more than ``block`` nodes is dealt as pairs of
blocks to several tasks, each counting links and keeping a spanning forest, so no
task and no output grows with the square of a group.  Nothing is capped.

Defined cases: null text is the empty text; texts of one to four words are one
shingle of all their words; texts without words equal each other (similarity 1) and
nothing else; very long texts are read whole; repeated rows are copies; rows that tie in
doc_id are told apart by their texts; a null ``doc_id`` is kept and never chosen as class
id unless the class has no other; an empty table gives an empty result; extra columns are
ignored, whatever their names, and pass ``one_of_each_class`` unchanged.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _words
from tessera.llm._components import components
from tessera.llm._tables import arrow_map, scratch, stored

WIDTH, THRESHOLD, TREES, MAX_DEPTH, RECALL = 5, 0.8, 20, 8, 0.999
#: Nodes of a block in candidate search and in verification; pairs below the cut are no candidates.
SKETCH_BLOCK, SET_BLOCK, SET_SHINGLES = 512, 256, 1 << 20
#: Largest number of 8-byte keys that is broadcast.
BROADCAST_KEYS = 2_000_000


def prefix_depth(threshold: float, trees: int = TREES, longest: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """Shorten the matched prefix until a pair at the threshold meets with the target recall;
    an error if no prefix reaches it."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach a recall of {recall} at a similarity of {threshold}: give more trees.")


def sketch_cut(threshold: float, values: int) -> float:
    """Sketch agreement that a pair at the threshold misses with probability below 1e-5."""
    return threshold - 4.5 * (threshold * (1 - threshold) / values) ** 0.5


def _shingle_sets(text, width):
    for i, j, data, offs in _words.chunks(text):
        _, _, hashes, bounds, _ = _words.scan(data, offs, _words.table_space())
        values, vb = _words.shingles(hashes, bounds, width)
        for k in range(j - i):
            yield i + k, np.unique(values[vb[k] : vb[k + 1]])


def _node(s) -> str:
    a = int(_words.mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64)) if len(s) else 0
    b = int(np.bitwise_xor.reduce(_words.mix(s * np.uint64(0xD6E8FEB86659FD93)))) if len(s) else 0
    return f"{a:016x}{b:016x}"


def _sign(batches, width, trees, depth):
    import pyarrow as pa

    rng = np.random.Generator(np.random.PCG64(20240817))
    odd = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spread = rng.integers(0, 1 << 63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    tag = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = max(64, (1 << 17) // (trees * depth))
    room = np.empty((trees * depth, step), dtype=np.uint64)
    for batch in batches:
        nodes, sizes, buckets, sketches = [], [], [], []
        for _, s in _shingle_sets(batch.column(2), width):
            nodes.append(_node(s))
            sizes.append(len(s))
            low = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(s), step):
                part = s[at : at + step]
                out = room[:, : len(part)]
                np.multiply(odd[:, None], part[None, :], out=out)
                np.minimum(low, out.min(axis=1), out=low)
            low = _words.mix(low)
            key = (low.reshape(trees, depth) * spread).sum(axis=1, dtype=np.uint64) + tag
            buckets.append(_words.mix(key).astype(np.int64) if len(s) else np.zeros(0, np.int64))
            sketches.append(low.astype(np.uint8).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_key", "node", "n_shingles", "buckets", "sketch"],
        )


def _groups(batches, keys):
    """Whole groups of rows that are sorted by ``keys``, as Arrow tables."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        cols = [rest.column(k).to_numpy() if not pa.types.is_string(rest.column(k).type) else np.array(rest.column(k).to_pylist(), dtype=object) for k in keys]
        change = np.zeros(rest.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            bounds = np.concatenate([[0], cuts])
            yield rest.slice(0, int(cuts[-1])).combine_chunks(), bounds
            rest = rest.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        cols = [rest.column(k).to_numpy() if not pa.types.is_string(rest.column(k).type) else np.array(rest.column(k).to_pylist(), dtype=object) for k in keys]
        change = np.zeros(rest.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        yield rest.combine_chunks(), np.concatenate([[0], np.flatnonzero(change), [rest.num_rows]])


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest index of every row's component in a symmetric boolean matrix."""
    m = len(near)
    root = np.full(m, -1, dtype=np.int64)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        todo = [i]
        while todo:
            fresh = np.flatnonzero(near[todo.pop()] & (root < 0))
            root[fresh] = i
            todo.extend(fresh.tolist())
    return root


def _candidates(batches, cut):
    """Spanning forests of like pairs inside (blocks of) buckets."""
    import pyarrow as pa

    for table, bounds in _groups(batches, ["bucket", "bi", "bj"]):
        blob = table.column("sketch").chunk(0)
        width = len(blob[0].as_py())
        offs = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
        values = np.frombuffer(blob.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]].reshape(-1, width)
        names = np.array(table.column("node").to_pylist(), dtype=object)
        mine = table.column("blk").to_numpy()
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        size = np.diff(bounds)
        left, right = [], []
        two = bounds[:-1][(size == 2)]
        if len(two):
            like = (values[two] == values[two + 1]).mean(axis=1) >= cut
            left.extend(names[two[like]])
            right.extend(names[two[like] + 1])
        for a, m in zip(bounds[:-1][size > 2], size[size > 2], strict=True):
            v, names_here, blk = values[a : a + m], names[a : a + m], mine[a : a + m]
            near = np.zeros((m, m), dtype=bool)
            step = max(1, (1 << 24) // (m * width))
            for k in range(0, m, step):
                near[k : k + step] = (v[k : k + step, None, :] == v[None]).mean(axis=2) >= cut
            if bi[a] != bj[a]:
                near &= blk[:, None] != blk[None]
            root = _roots(near)
            other = np.flatnonzero(root != np.arange(m))
            left.extend(names_here[other])
            right.extend(names_here[root[other]])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["u", "v"])


def _sets(batches, width):
    import pyarrow as pa

    for batch in batches:
        nodes, sets, held = [], [], 0
        for _, s in _shingle_sets(batch.column(0), width):
            nodes.append(_node(s))
            sets.append(s.view(np.int64))
            held += len(s)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
                nodes, sets, held = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _common(values, offs):
    """Matrix of the sizes of all intersections of sorted sets ``values[offs[i]:offs[i+1]]``."""
    m = len(offs) - 1
    if m <= 6:
        out = np.zeros((m, m), dtype=np.int64)
        sets = [values[offs[i] : offs[i + 1]] for i in range(m)]
        for i in range(m):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), np.diff(offs))
    seen = times[place] > 1
    rank = np.cumsum(times > 1) - 1
    column, owner = rank[place[seen]], owner[seen]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    span, total = 4096, int(rank[-1]) + 1 if len(rank) else 0
    for at in range(0, total, span):
        a, b = np.searchsorted(column, (at, at + span))
        block = np.zeros((m, min(span, total - at)), dtype=np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block @ block.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, np.diff(offs))
    return out


def _verify(batches, threshold):
    """Exact links of (blocks of) candidate components: per node the weight of its
    partners, and a spanning forest."""
    import pyarrow as pa

    for table, bounds in _groups(batches, ["comp", "bi", "bj"]):
        lists = table.column("shingles").chunk(0)
        offs = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        names = np.array(table.column("node").to_pylist(), dtype=object)
        weight, mine = table.column("copies").to_numpy(), table.column("blk").to_numpy()
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        out_node, out_links, out_root = [], [], []
        for a, m in zip(bounds[:-1], np.diff(bounds), strict=True):
            o = offs[a : a + m + 1]
            both = _common(values[o[0] : o[-1]], o - o[0])
            size = np.diff(o)
            near = both >= threshold * (size[:, None] + size[None] - both) - 1e-9
            np.fill_diagonal(near, False)
            if bi[a] != bj[a]:
                blk = mine[a : a + m]
                near &= blk[:, None] != blk[None]
            root = _roots(near)
            out_links.extend((near * weight[a : a + m][None]).sum(axis=1).tolist())
            out_node.extend(names[a : a + m])
            out_root.extend(names[a : a + m][root])
        yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.string()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.string())], names=["node", "links", "root"])


def _block_pairs(df: DataFrame, key: str) -> DataFrame:
    """Deal rows with ``key, nb, blk`` to pairs of blocks, sorted by pair."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    pairs = df.select("*", other).withColumns({"bi": F.least("blk", "o"), "bj": F.greatest("blk", "o")}).drop("o", "nb")
    # A one-block group has the pair (0, 0); of several blocks, the pair (i, i) has block i alone.
    return pairs.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", "node")


def _dealt(node: str, nb):
    return F.pmod(F.xxhash64(node), nb).cast("int")


def jaccard_classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, *, block: int = SKETCH_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: one row per document.

    Returns ``doc_id, text_key`` (hash of the text, to tell rows of equal id apart),
    ``class_id`` (smallest doc_id of the class), ``n_links`` (documents at similarity
    ``threshold`` or more, copies counted), ``class_size``, ``class_key`` (unique per class).
    """
    depth = prefix_depth(threshold, trees, recall=recall)
    cut = sketch_cut(threshold, trees * depth)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch() as keep:
        signed = stored(
            arrow_map(base, partial(_sign, width=width, trees=trees, depth=depth), "doc_id long, text_key long, node string, n_shingles long, buckets array<long>, sketch binary"),
            "signatures",
        )
        nodes = stored(
            signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), F.min("text_key").alias("a_text"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")),
            "nodes",
        )
        placed = nodes.select("node", F.explode("buckets").alias("bucket"))
        shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        met = placed.join(shared, "bucket").withColumn("nb", F.ceil(F.col("members") / block).cast("int")).withColumn("blk", _dealt("node", F.col("nb"))).drop("members")
        found = arrow_map(_block_pairs(met.join(nodes.select("node", "sketch"), "node").select("bucket", "nb", "blk", "node", "sketch"), "bucket"), partial(_candidates, cut=cut), "u string, v string")
        likely = components(found, "candidates")
        member = likely.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(likely.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        member = member.join(nodes.select("node", "copies", "n_shingles", "a_text"), "node")
        sized = member.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / set_block), F.ceil(F.sum("n_shingles") / SET_SHINGLES)).cast("int").alias("nb"))
        member = stored(member.join(sized, "comp").withColumn("blk", _dealt("node", F.col("nb"))), "members")
        keys = member.select(F.col("a_text").alias("text_key")).distinct()
        if member.count() <= BROADCAST_KEYS:  # 8 bytes each; beyond that, a shuffled join
            keys = F.broadcast(keys)
        wanted = base.select("text_key", "text").join(keys, "text_key", "left_semi").withColumn("twin", F.xxhash64(F.lit("twin"), "text")).dropDuplicates(["text_key", "twin"])
        sets = arrow_map(wanted.select("text"), partial(_sets, width=width), "node string, shingles array<long>")
        checked = stored(
            arrow_map(_block_pairs(member.select("comp", "nb", "blk", "node", "copies").join(sets, "node").select("comp", "nb", "blk", "node", "copies", "shingles"), "comp"), partial(_verify, threshold=threshold), "node string, links long, root string"),
            "links",
        )
        links = checked.groupBy("node").agg(F.sum("links").alias("links"))
        joined = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes").select(F.col("u").alias("node"), F.col("v").alias("top"))
        known = nodes.select("node", "copies", "low_id").join(joined, "node", "left").join(links, "node", "left").withColumn("top", F.coalesce("top", "node"))
        classes = known.groupBy("top").agg(F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size"))
        info = known.join(classes, "top").select("node", F.col("top").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size")
        return keep(signed.select("doc_id", "text_key", "node").join(info, "node").select("doc_id", "text_key", "class_id", "n_links", "class_size", "class_key"), "near_classes")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one of each near-duplicate class: that with the smallest
    ``doc_id``, then the smallest text hash.  All columns are kept."""
    names = docs.columns
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "__tessera_text")
    best = F.min_by(F.struct("doc_id", F.col("text_key").alias("__tessera_text")), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    keep = jaccard_classes(docs, **options).groupBy("class_key").agg(best.alias("k")).select("k.*").select(key.alias("__tessera_key"))
    rows = docs.withColumn("__tessera_text", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__tessera_key", key)
    kept = rows.join(keep.hint("merge"), "__tessera_key", "left_semi")
    # Rows repeated in full pass the join together; one stays.  The join has dealt them by this key.
    first = F.row_number().over(Window.partitionBy("__tessera_key").orderBy("__tessera_key"))
    return kept.withColumn("__tessera_first", first).where("__tessera_first = 1").select(*names)
