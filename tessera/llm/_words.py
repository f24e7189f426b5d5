"""Vectorised word scanning and hashing over Arrow string buffers.

Words are runs of bytes that a 256-entry table marks as word bytes.  Each word
gets a 64-bit hash: a polynomial hash from running sums over the buffer, passed
through a finaliser.  All work is numpy over whole batches, with memory bounded
by ``SEGMENT`` bytes at a time however long a text is (a longer single word is
taken whole).
"""

from __future__ import annotations

import numpy as np

from tessera.llm._tables import worker_cache

SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def table_space() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def table_alnum() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, SEGMENT * 2)
        mask = (1 << 64) - 1
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            a = np.full(size, base & mask, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        cache["powers"] = tuple(out)
    return cache["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column, limit: int = SEGMENT):
    """Yield ``(first, last, data, offsets)`` of whole texts of an Arrow string array.

    A chunk has at most ``limit`` bytes, or is one longer text.  Null reads as empty.
    """
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _scan(data, breaks, table, fold, prefixes):
    """Words of one segment: starts, ends, hashes, and hashes of byte prefixes."""
    n = len(data)
    w = table[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    if breaks is not None and len(breaks):
        b = breaks[(breaks > 0) & (breaks < n)]
        first[b] = w[b]
        last[b - 1] = w[b - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    codes = (fold[data] if fold is not None else data).astype(np.uint64) + np.uint64(1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * power[:n], out=run[1:])
    inv = inverse[starts]
    size = ends - starts
    hashes = mix((run[ends] - run[starts]) * inv + size.astype(np.uint64))
    more = []
    for p in prefixes:
        ok = np.flatnonzero(size > p)
        s = starts[ok]
        more.append((ok, mix((run[s + p] - run[s]) * inv[ok] ^ np.uint64(p * 0x51ED27))))
    return starts, ends, hashes, more


def scan(data, offsets, table, fold=None, prefixes=()):
    """Words of a chunk from :func:`chunks`.

    Returns ``starts, ends, hashes, bounds, more``; the words of text k are
    ``bounds[k]:bounds[k + 1]``; ``more`` holds per prefix length ``(word index, hash)``.
    """
    n = len(data)
    if n <= SEGMENT or len(offsets) > 2:
        starts, ends, hashes, more = _scan(data, offsets, table, fold, prefixes) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), [(np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in prefixes])
    else:
        parts, at, count = [], 0, 0
        while at < n:
            end = min(n, at + SEGMENT)
            while end < n and table[data[end]] and table[data[end - 1]]:
                step = data[end : end + 4096]
                stop = np.flatnonzero(~table[step])
                end += int(stop[0]) if len(stop) else len(step)
            s, e, h, m = _scan(data[at:end], None, table, fold, prefixes)
            parts.append((s + at, e + at, h, [(i + count, x) for i, x in m]))
            count += len(s)
            at = end
        starts, ends, hashes = (np.concatenate([p[k] for p in parts]) for k in range(3))
        more = [tuple(np.concatenate([p[3][k][j] for p in parts]) for j in range(2)) for k in range(len(prefixes))]
    return starts, ends, hashes, np.searchsorted(starts, offsets), more


def shingles(hashes, bounds, width: int):
    """Hashes of ``width`` consecutive words, text by text: ``values, bounds``.

    A text with fewer words, but at least one, has one shingle: all of them.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    odd = [np.uint64(((0xA0761D6478BD642F * (2 * k + 1)) | 1) & ((1 << 64) - 1)) for k in range(width)]
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        if len(rolled):
            rolled += hashes[k : n - width + 1 + k] * odd[k]
    rolled = mix(rolled)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(per, out=out_bounds[1:])
    owner = np.repeat(np.arange(len(counts)), per)
    at = bounds[owner] + (np.arange(out_bounds[-1]) - out_bounds[owner])
    full = counts[owner] >= width
    out = np.zeros(out_bounds[-1], dtype=np.uint64)
    out[full] = rolled[at[full]]
    for k in np.flatnonzero((counts > 0) & (counts < width)):
        words = hashes[bounds[k] : bounds[k + 1]]
        x = (words * np.array(odd[: len(words)])).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(0x5851F42D4C957F2D * len(words) & ((1 << 64) - 1))
        out[out_bounds[k]] = mix(x)[0]
    return out, out_bounds
