"""Operator 6: licence scan with a generalised suffix automaton.

Licence templates are word sequences.  One suffix automaton holds all their substrings;
a file's words stream through it and give matching statistics: at each word, the
longest phrase ending there that stands in some template, and, over its suffix links,
the longest one that stands in a given template.  Where that stops growing, a phrase of
``MIN_MATCH`` words or more (or a whole shorter template) is a match, at every place where
the template holds it.  Matches are chained, in file order and template order, into spans
per template; a template is reported when its chain covers ``MIN_COVER`` of it.  Matches
with more than ``MAX_GAP`` other file words between them are not chained: a licence that is
broken by a longer insertion shows as its better part.

Only words that occur in a template or phrase can move the automaton from its start, so
runs of such words are found with vectorised hashing and only they are streamed.

Defined cases: null text is empty: no words, empty labels, score 0; very long texts are
read whole; repeated rows, and rows that tie in doc_id, each get their row; templates
repeated in a text raise the count of places, labels stay distinct; of spans that cover
equally much, the first in the file counts; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words
from tessera.llm._tables import arrow_map

MIN_MATCH, MIN_COVER, MAX_GAP = 3, 0.6, 12

#: Phrases whose places are counted, and their labels.
PHRASES = {
    ("cc", "by"): "cc-by",
    ("general", "public", "license"): "gpl",
    ("all", "rights", "reserved"): "reserved",
}

#: Licence notices (words after lower-casing; punctuation separates).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
]


def build_automaton(sequences: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int], list[dict[int, list[int]]]]:
    """Generalised suffix automaton: transitions, suffix links, longest lengths, and per
    state all end positions in each sequence that holds its phrases."""
    go, link, longest, ends = [{}], [-1], [0], [{}]

    def extend(last: int, c: int) -> int:
        if c in go[last]:
            q = go[last][c]
            if longest[q] == longest[last] + 1:
                return q
            copy = len(go)
            go.append(dict(go[q]))
            link.append(link[q])
            longest.append(longest[last] + 1)
            ends.append({})
            link[q] = copy
            while last != -1 and go[last].get(c) == q:
                go[last][c] = copy
                last = link[last]
            return copy
        new = len(go)
        go.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        ends.append({})
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                ends.append({})
                link[q] = link[new] = copy
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        return new

    for words in sequences:
        last = 0
        for c in words:
            last = extend(last, c)
    for t, words in enumerate(sequences):
        state = 0
        for i, c in enumerate(words):
            state = go[state][c]
            s = state
            while s > 0:
                ends[s].setdefault(t, []).append(i + 1)
                s = link[s]
    return go, link, longest, ends


def statistics(ids, go, link, longest) -> list[tuple[int, int]]:
    """Per word the state and the length of the longest phrase ending there."""
    out, state, size = [], 0, 0
    for c in ids:
        while state and c not in go[state]:
            state = link[state]
            size = longest[state]
        if c in go[state]:
            state, size = go[state][c], size + 1
        else:
            state = size = 0
        out.append((state, size))
    return out


def matches(stats, template: int, link, longest, ends, least: int, offset: int = 0) -> list[tuple[int, int, list[int]]]:
    """Phrases ``(end, length, places)`` of a template, of at least ``least`` words, where
    the longest phrase of the template does not grow at the next word."""
    out, was = [], (0, 0)
    for i, (state, size) in enumerate([*stats, (0, 0)]):
        while state and template not in ends[state]:
            state = link[state]
            size = longest[state]
        if was[1] >= least and size <= was[1]:
            out.append((offset + i, was[1], ends[was[0]][template]))
        was = (state, size)
    return out


def chain(found, gap: int):
    """Best chain of matches ``(end, length, places)`` of one template in rising file and
    template order: words of the template that it covers, first and last file word."""
    items = [(end, size, at) for end, size, places in sorted(found, key=lambda f: f[0]) for at in places]
    best, back = [], []
    for k, (end, size, at) in enumerate(items):
        score, first = size, end - size
        for j in range(k - 1, -1, -1):
            e, _, a = items[j]
            if end - size - e > gap:
                break
            if a < at and e < end:
                gain = min(size, at - a, end - e)
                if best[j] + gain > score:
                    score, first = best[j] + gain, back[j]
        best.append(score)
        back.append(first)
    if not best:
        return 0, 0, 0
    k = max(range(len(best)), key=lambda x: (best[x], -x))
    return best[k], back[k], items[k][0]


def template_words(text: str) -> str:
    """A licence text as templates hold it: its words, lower-cased, one blank between."""
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def template_folder(spark, path: str) -> list[tuple[str, str]]:
    """Templates from a folder of licence texts, one file each; its name is the label."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value").collect()  # a file a licence
    return sorted((re.sub(r"\.\w+$", "", r["name"].rsplit("/", 1)[-1]), template_words(r["value"])) for r in rows)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return _words.scan(data, np.array([0, len(data)]), _words.table_alnum(), _words.lower_table())[2]


def _hit(stats, link, longest, ends, fewest, shortest) -> set[int]:
    """Templates that a run of words may match."""
    hit: set[int] = set()
    seen: set[int] = set()
    for state, size in stats:
        while state and size >= shortest and state not in seen:
            if size == longest[state]:  # all its shorter phrases are visited with it
                seen.add(state)
            hit.update(t for t in ends[state] if size >= fewest[t])
            state = link[state]
            size = longest[state]
    return hit


def _scanned(batches, templates, phrases, least, cover, gap):
    import pyarrow as pa

    texts = [t.split() for _, t in templates]
    vocabulary = sorted({w for t in texts for w in t} | {w for p in phrases for w in p})
    hashes = _hash_words(vocabulary)
    number = {w: k for k, w in enumerate(vocabulary)}
    order = np.argsort(hashes)
    known, name = hashes[order], order
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(known >> np.uint64(48)).astype(np.int64)] = True
    sequences = [[number[w] for w in t] for t in texts]
    go, link, longest, ends = build_automaton(sequences)
    wanted = [([number[w] for w in p], label) for p, label in phrases.items()]
    shortest = min([len(p) for p, _ in wanted] + [min(least, len(t)) for t in sequences if t], default=1)
    fewest = [min(least, len(t)) for t in sequences]
    for batch in batches:
        rows = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for i, j, data, offs in _words.chunks(batch.column(1)):
            _, _, h, bounds, _ = _words.scan(data, offs, _words.table_alnum(), _words.lower_table())
            near = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
            ok = known[at] == h[near]
            place, ids = near[ok], name[at[ok]]
            owner = np.searchsorted(bounds, place, side="right") - 1
            # Runs of known words that follow one another in one text.
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(owner) != 0)) + 1
            starts, stops = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(place)]]).astype(np.int64)
            by_text: dict[int, list[tuple[int, int]]] = {}
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if b - a >= shortest:
                    by_text.setdefault(int(owner[a]), []).append((a, b))
            counts = np.diff(bounds)
            for k in range(j - i):
                base, base_labels, found = [], set(), {}
                for a, b in by_text.get(k, ()):
                    seq, offset = ids[a:b].tolist(), int(place[a] - bounds[k])
                    for phrase, label in wanted:
                        m = len(phrase)
                        for x in range(len(seq) - m + 1):
                            if seq[x : x + m] == phrase:
                                base.append(offset + x)
                                base_labels.add(label)
                    stats = statistics(seq, go, link, longest)
                    for t in _hit(stats, link, longest, ends, fewest, shortest):
                        found.setdefault(t, []).extend(matches(stats, t, link, longest, ends, fewest[t], offset))
                spans, score = [], 0.0
                for t in sorted(found):
                    got, first, last = chain(found[t], gap)
                    share = min(1.0, got / len(sequences[t]))
                    score = max(score, share)
                    if share >= cover:
                        spans.append({"label": templates[t][0], "first_word": first, "last_word": last - 1, "coverage": share})
                rows["n_words"].append(int(counts[k]))
                rows["n_base"].append(len(base))
                rows["first_word"].append(min(base) if base else None)
                rows["last_word"].append(max(base) if base else None)
                rows["base_labels"].append(",".join(sorted(base_labels)))
                rows["labels"].append(",".join(sorted(base_labels | {s["label"] for s in spans})))
                rows["score"].append(score)
                rows["spans"].append(spans)
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[k], t) for k, t in zip(rows, kinds, strict=True))], names=["doc_id", *rows])


def licences(docs: DataFrame, templates=None, phrases=None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``."""
    todo = partial(_scanned, templates=templates or TEMPLATES, phrases=phrases or PHRASES, least=min_match, cover=min_cover, gap=max_gap)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), todo, schema)
