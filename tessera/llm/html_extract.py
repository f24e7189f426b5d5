"""Operator 1: main text of web pages by a tree-structured graphical model.

A page's block elements form a tree.  Each node is content (it holds main text) or
boilerplate; a unary potential looks at its tag, class and id words, text, links and
surroundings (density, siblings, neighbouring blocks, the sectioning elements above),
and a parent-child potential couples it with its parent.  Sum-product messages go
upward and downward once, which gives exact marginals; text blocks whose node has a
content marginal of at least ``THRESHOLD`` are the main text.  The weights maximise
the exact likelihood of labelled pages: by default ``labelled_pages`` makes a fixed set
of ``PAGES`` layouts with known content, most of them without telling class names; a
caller may give others.  Author and date lines count as the article's header.

Pages are read row by row; the messages of a batch run together, depth by depth.  The
time is linear in a page's length, however badly it is nested.

Defined cases: null html is empty; a page without any text, and a page all of whose
blocks are boilerplate, has empty text; cut pages are read as far as they go; a cut tag
at the end is markup; very long pages are read whole; pages that tie in page_id, and
rows repeated in full, each get their row; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from functools import cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _dom
from tessera.llm._tables import arrow_map

PAGES, THRESHOLD, SEED, STEPS = 500, 0.5, 3, 220
_TAGS = ["#page", "#text", *sorted(_dom.BLOCK | _dom.EMBEDDED)]
_TAG_AT = {t: k for k, t in enumerate(_TAGS)}

#: Words that speak of a page's furniture, by kind.
SPEECH = {
    "notice": "cookie cookies consent privacy gdpr accept datenschutz einwilligung confidentialité privacidad",
    "advert": "advertisement advertise advertising sponsored advert ad ads promoted anzeige werbung publicité publicidad discount",
    "sign": "subscribe newsletter signup login register inbox unsubscribe abonnieren anmelden abonnez suscríbete email",
    "more": "related popular trending recommended latest previous older newer weitere ähnliche connexes relacionados",
    "share": "share tweet facebook twitter instagram pinterest whatsapp linkedin follow teilen partager compartir",
    "reply": "comment comments reply replies responses discussion says kommentare antworten commentaires comentarios",
    "legal": "copyright © rights reserved terms imprint impressum legal mentions sitemap contact powered",
    "author": "published updated posted written author editor reporter staff correspondent min veröffentlicht publié publicado",
}
_SPEAKS = [frozenset(v.split()) for v in SPEECH.values()]
_SPOKEN = {w: k for k, words in enumerate(_SPEAKS) for w in words}
_DATE = r"(?:(?:\w+,?\s+){0,2}\w+\.?\s+\d{1,2},?\s+(?:19|20)\d\d|\d{1,4}[./-]\d{1,2}[./-]\d{2,4})"
_BYLINE = re.compile(rf"(?:(?:[Bb][Yy]|Von|von|Par|par|Por|por)(?:\s+[^\W\d_a-z]\S*){{2,4}}(?:\s*[,|]\s*\S.{{0,50}})?|(?:\w+:?\s+){{0,2}}{_DATE}(?:\s*[,|]\s*\S.{{0,30}})?|\d+\s+min(?:ute)?s?\s+read)")
_LETTERS = re.compile(r"[^\W\d_]+|©")
_WITHIN = ("article", "main")
_ASIDE = ("nav", "aside", "footer", "header", "form", "dialog", "menu")
_SHORT = 400
_NUMERIC = 39 + 2 * len(_SPEAKS)


def _speech(text: str) -> list[float]:
    """Share of a short block's words that speak of each kind of furniture."""
    out = [0.0] * len(_SPEAKS)
    if len(text) <= _SHORT:
        words = _LETTERS.findall(text.lower())
        for w in words:
            if w in _SPOKEN:
                out[_SPOKEN[w]] += 1
        out = [min(1.0, 4 * v / max(3, len(words))) for v in out]
    return out


def split_texts(page: _dom.Page) -> _dom.Page:
    """The page with a ``#text`` node for each block of an element that holds more."""
    out = _dom.Page()
    out.tags, out.parents, out.tokens, out.hidden = list(page.tags), list(page.parents), list(page.tokens), list(page.hidden)
    parts = [0] * len(page.tags)
    for p in page.parents[1:]:
        parts[p] += 1
    for node, _, _ in page.blocks:
        parts[node] += 1
    for node, text, linked in page.blocks:
        if parts[node] > 1:
            out.tags.append("#text")
            out.parents.append(node)
            out.tokens.append(())
            out.hidden.append(False)
            node = len(out.tags) - 1
        out.blocks.append((node, text, linked))
    return out


def _numbers(page: _dom.Page) -> np.ndarray:
    """Per node: shape of its own text, its subtree's text, its place and surroundings."""
    n, total = len(page.tags), len(page.blocks)
    parents = page.parents
    own, link, words, stops, first, before, after, before_link, after_link, date = (np.zeros(n) for _ in range(10))
    says, lead = np.zeros((n, len(_SPEAKS))), np.zeros((n, len(_SPEAKS)))
    led = [False] * n
    sizes = [len(t) for _, t, _ in page.blocks]
    shares = [k / max(1, len(t)) for _, t, k in page.blocks]
    head = next((k for k, (node, _, _) in enumerate(page.blocks) if page.tags[node] == "h1" or page.tags[parents[node]] == "h1"), total)
    for k, (node, text, linked) in enumerate(page.blocks):
        if not own[node]:
            first[node] = k / total
            before[node], before_link[node] = (sizes[k - 1], shares[k - 1]) if k else (0, 0)
        after[node], after_link[node] = (sizes[k + 1], shares[k + 1]) if k + 1 < total else (0, 0)
        own[node] += len(text)
        link[node] += linked
        words[node] += text.count(" ") + 1
        stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        said = _speech(text)
        says[node] = np.maximum(says[node], said)
        date[node] = max(date[node], 0 < k - head <= 3 and len(text) < 90 and _BYLINE.fullmatch(text) is not None)
        p = node
        while p >= 0 and not led[p]:
            led[p], lead[p] = True, said
            p = parents[p]
    all_text, all_link, kids, under, long_kids = own.copy(), link.copy(), np.zeros(n), np.ones(n), np.zeros(n)
    sentence = (own > 80) & (link < own / 2)
    longest = float(own.max()) if n else 0.0
    for k in range(n - 1, 0, -1):
        p = parents[k]
        all_text[p] += all_text[k]
        all_link[p] += all_link[k]
        under[p] += under[k]
        kids[p] += 1
        long_kids[p] += sentence[k]
    # The chief article: of the elements that may hold it, the one with the most text.
    chief = max((k for k in range(n) if page.tags[k] in _WITHIN), key=lambda k: (all_text[k], k), default=-1)
    holds, p = np.zeros(n, dtype=bool), chief
    while p >= 0:
        holds[p], p = True, parents[p]
    inside, beside, short_kids = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        p = parents[k]
        short_kids[max(0, p)] += 0 < own[k] <= 80 and not link[k]
        inside[k] = k == chief or (k > 0 and inside[p])
        beside[k] = page.tags[k] in _ASIDE or (k > 0 and beside[p])
    seen = head < total
    titled = (own > 0) * (first > head / max(1, total)) if seen else np.zeros(n)
    up = np.array([max(0, p) for p in parents])
    around = long_kids[up] - sentence
    body = max(1.0, float(all_text[0]))
    has = own > 0
    log = lambda v: np.minimum(np.log1p(v) / 6, 1.5)
    density = np.where(all_text > 0, all_link / np.maximum(all_text, 1), 0)
    x = np.zeros((n, _NUMERIC), dtype=np.float32)
    columns = [
        np.ones(n), log(own), has, own > 80, np.where(has, link / np.maximum(own, 1), 0), density,
        np.where(words > 0, np.minimum(stops / np.maximum(words, 1) * 5, 1), 0), all_text / body, all_text == 0, np.minimum(kids, 20) / 20,
        page.hidden, density > 0.5, (all_text > 0) & (all_text < 60), first,
        log(all_text / under), log(all_text[up] / under[up]), density[up], np.minimum(long_kids, 8) / 8, np.minimum(around, 8) / 8, around > 0,
        np.where(has, own / max(1.0, longest), 0), has * log(before), has * log(after), has * before_link, has * after_link,
        inside, beside, (chief >= 0) & ~holds & (inside == 0), titled, seen * (own > 0) * (titled == 0), date, date * (around > 0),
        has & (own < 40) & (stops == 0), np.where(words > 0, own / np.maximum(words, 1) > 14, False), all_text[up] / body, long_kids[up] > 2, beside * (inside == 0), np.minimum(short_kids[up], 30) / 30, holds & (inside == 0),
    ]
    for k, c in enumerate(columns):
        x[:, k] = c
    x[:, len(columns) : len(columns) + len(_SPEAKS)] = says
    x[:, len(columns) + len(_SPEAKS) :] = lead
    return x


def _batch(pages: list[_dom.Page], vocabulary: dict[str, int]):
    """Nodes of many pages as arrays: numbers, tag, tokens (pairs), parent, depth."""
    numbers, tags, parents, rows, cols, depth, at = [], [], [], [], [], [], 0
    for page in pages:
        numbers.append(_numbers(page))
        d = [0] * len(page.tags)
        for k, p in enumerate(page.parents):
            if k:
                d[k] = d[p] + 1
            tags.append(_TAG_AT[page.tags[k]])
            parents.append(p + at if k else -1)
            for w in page.tokens[k]:
                if w in vocabulary:
                    rows.append(at + k)
                    cols.append(vocabulary[w])
        depth += d
        at += len(page.tags)
    return np.concatenate(numbers), np.array(tags), np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(parents), np.array(depth)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``log(e^a + e^b)``."""
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def sum_product(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]):
    """Exact marginals of a forest of binary nodes: of nodes ``(n, 2)`` and of edges
    ``(n, 2, 2)`` indexed by parent and child label (the edge of a child), and the log
    partition sum.  ``unary`` and ``pair`` are log potentials."""
    n = len(unary)
    # Columns by label: b0, b1 below a node, u0, u1 sent up by it, d0, d1 sent down to it.
    b0, b1 = unary[:, 0].copy(), unary[:, 1].copy()
    (p00, p01), (p10, p11) = pair.transpose(1, 2, 0)
    u0, u1, d0, d1 = (np.zeros(n) for _ in range(4))
    for nodes in levels[:0:-1]:
        up = parent[nodes]
        x, y = b0[nodes], b1[nodes]
        u0[nodes], u1[nodes] = v0, v1 = _either(p00[nodes] + x, p01[nodes] + y), _either(p10[nodes] + x, p11[nodes] + y)
        np.add.at(b0, up, v0)
        np.add.at(b1, up, v1)
    edge = np.zeros((n, 2, 2))
    for nodes in levels[1:]:
        up = parent[nodes]
        r0, r1 = b0[up] + d0[up] - u0[nodes], b1[up] + d1[up] - u1[nodes]
        s00, s01, s10, s11 = p00[nodes] + r0, p01[nodes] + r0, p10[nodes] + r1, p11[nodes] + r1
        d0[nodes], d1[nodes] = _either(s00, s10), _either(s01, s11)
        joint = np.stack([s00 + b0[nodes], s01 + b1[nodes], s10 + b0[nodes], s11 + b1[nodes]])
        joint -= joint.max(axis=0)
        np.exp(joint, out=joint)
        edge[nodes] = (joint / joint.sum(axis=0)).T.reshape(-1, 2, 2)
    t0, t1 = b0 + d0, b1 + d1
    z = _either(t0, t1)
    return np.exp(np.stack([t0 - z, t1 - z], axis=1)), edge, z[levels[0]].sum()


def _potentials(model, data):
    x, tags, rows, cols, parent, _ = data
    score = x @ model["numeric"] + model["tag"][tags]
    np.add.at(score, rows, model["token"][cols])
    unary = np.zeros((len(x), 2))
    unary[:, 1] = score
    return unary, model["pair"] + model["pair_tag"][tags]


def train(pages=None, steps: int = STEPS, rate: float = 0.12, ridge: float = 0.02) -> dict:
    """Weights from labelled pages ``(html, set of content texts)`` by exact gradients."""
    rows = pages if pages is not None else labelled_pages()
    read = [split_texts(_dom.read(h)) for h, _ in rows]
    count: dict[str, int] = {}
    for page in read:
        for w in {w for t in page.tokens for w in t}:
            count[w] = count.get(w, 0) + 1
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, c in count.items() if c >= 2))}
    data = _batch(read, vocabulary)
    label, at = np.zeros(len(data[1]), dtype=np.int64), 0
    for page, (_, content) in zip(read, rows, strict=True):
        mine = np.zeros(len(page.tags), dtype=np.int64)
        for node, text, _ in page.blocks:
            if text in content:
                mine[node] = 1
        for k in range(len(mine) - 1, 0, -1):
            mine[page.parents[k]] |= mine[k]
        label[at : at + len(mine)] = mine
        at += len(mine)
    x, tags, trow, tcol, parent, depth = data
    levels = _levels(depth)
    model = {"numeric": np.zeros(_NUMERIC), "tag": np.zeros(len(_TAGS)), "token": np.zeros(len(vocabulary)), "pair": np.zeros((2, 2)), "pair_tag": np.zeros((len(_TAGS), 2, 2))}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((len(label), 2, 2))
    seen[child, label[parent[child]], label[child]] = 1
    for t in range(1, steps + 1):
        unary, pair = _potentials(model, data)
        node, edge, _ = sum_product(unary, pair, parent, levels)
        gap = label - node[:, 1]
        egap = seen - edge
        egap[parent < 0] = 0
        grad = {"numeric": x.T @ gap, "tag": np.bincount(tags, gap, len(_TAGS)), "token": np.bincount(tcol, gap[trow], len(vocabulary)), "pair": egap.sum(axis=0), "pair_tag": np.zeros_like(model["pair_tag"])}
        for i in (0, 1):
            for j in (0, 1):
                grad["pair_tag"][:, i, j] = np.bincount(tags, egap[:, i, j], len(_TAGS))
        for k, v in model.items():
            g = grad[k] / len(rows) - ridge * v / 10
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            model[k] = v + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
    return model | {"vocabulary": vocabulary}


def marginals(pages: list[_dom.Page], model) -> list[np.ndarray]:
    """Content marginal of every node of every page of :func:`split_texts`."""
    data = _batch(pages, model["vocabulary"])
    unary, pair = _potentials(model, data)
    node, _, _ = sum_product(unary, pair, data[4], _levels(data[5]))
    cuts = np.cumsum([len(p.tags) for p in pages])[:-1]
    return np.split(node[:, 1], cuts)


def texts(htmls, model, threshold: float = THRESHOLD) -> list[str]:
    """Main text of each page."""
    pages = [split_texts(_dom.read(h or "")) for h in htmls]
    if not pages:
        return []
    out = []
    for page, p in zip(pages, marginals(pages, model), strict=True):
        out.append(" ".join(text for node, text, _ in page.blocks if p[node] >= threshold))
    return out


def _extract(batches, model, threshold, group=256):
    import pyarrow as pa

    for batch in batches:
        found = []
        for k in range(0, batch.num_rows, group):
            found += texts((h.as_py() for h in batch.column(2).slice(k, group)), model, threshold)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


@cache
def _default_model() -> dict:
    return train()


def main_text(pages: DataFrame, labelled=None, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    todo = partial(_extract, model=_default_model() if labelled is None else train(labelled), threshold=threshold)
    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), todo, "page_id long, url string, text string, n_chars long")


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """The default training set: layouts made by rule, with the texts that are content.

    A page names its parts by telling classes (a third of the pages), by generated ones
    or not at all; articles stand in their own element or loose among other blocks."""
    rng = random.Random(seed)
    pick = rng.choice
    chance = lambda p: rng.random() < p
    sounds = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ti", "to", "it", "st", "le", "is", "ou", "ar", "de", "ç", "é", "ü", "ñ"]
    used: set[str] = set()
    speech = {k: [w for w in v.split()] for k, v in SPEECH.items()}
    style = "named"

    def words(low, high, end=0.8, kind=None, share=0.35):
        n = rng.randrange(low, high + 1)
        stray = pick([0.0, 0.0, 0.03, 0.1])
        while True:
            out = []
            for _ in range(n):
                if kind and chance(share):
                    out.append(pick(speech[kind]))
                    continue
                # Main text uses these words too, now and then.
                out.append(pick(speech[pick(list(speech))]) if chance(stray) else "".join(pick(sounds) for _ in range(rng.randrange(1, 4))))
                if chance(0.12):
                    out[-1] += pick([",", ".", ",", "###", "!!", ";"])
            if kind and not set(out) & set(speech[kind]):
                out[rng.randrange(n)] = pick(speech[kind])
            s = " ".join(out)
            s = (s[0].upper() + s[1:] if chance(0.5) else s) + ("." if n > 4 and chance(end) else "")
            if s not in used:
                used.add(s)
                return s
            n += 1

    def code():
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"
        return pick(["css-", "sc-", "_", "jsx-", ""]) + pick("abcdefghij") + "".join(pick(letters) for _ in range(6))

    def tag(name, inner, cls=None, key="class"):
        """``cls`` may tell what the part is; only named pages say so."""
        if style == "named":
            mark = cls
        elif style == "coded":
            mark, key = (code() + (" " + code() if chance(0.3) else "") if chance(0.7) else None), "class"
        else:
            mark = None
        return f"<{name}" + (f' {key}="{mark}"' if mark else "") + f">{inner}</{name}>"

    def menu(cls=None, name="nav"):
        links = "".join(tag("li", f'<a href="/{k}">{words(1, 2)}</a>') for k in range(rng.randrange(3, 9)))
        return tag(name, tag("ul", links), cls) if chance(0.7) else tag(name, pick([" | ", " ", " &middot; "]).join(f'<a href="/{k}">{words(1, 3)}</a>' for k in range(5)), cls)

    def teasers():
        """Linked headings, some with a line of text."""
        one = lambda: tag(pick(["h3", "h4", "p", "div"]), f'<a href="/{rng.randrange(999)}">{words(3, 12)}</a>') + (tag("p", words(5, 25)) if chance(0.3) else "")
        return "".join(tag(pick(["li", "div", "article"]), one()) for _ in range(rng.randrange(2, 6)))

    def comments():
        one = lambda: tag(pick(["b", "span", "div", "p"]), words(1, 2, 0) + (pick([" says:", " said", " wrote:", ""]))) + tag("p", words(4, 60)) + (f'<a href="#">{pick(["Reply", "Antworten", "Répondre", "Like"])}</a>' if chance(0.8) else "")
        head = tag(pick(["h2", "h3", "h4", "p"]), pick([f"{rng.randrange(1, 40)} Comments", "Comments", "Leave a reply", "Discussion", "Kommentare", "Responses", words(1, 3, 0, "reply")]))
        body = "".join(tag(pick(["li", "div", "article"]), one(), pick(["comment", "comment-body", "reply", None])) for _ in range(rng.randrange(1, 6)))
        return tag(pick(["section", "div"]), head + tag(pick(["ol", "ul", "div"]), body, pick(["comment-list", None])), pick(["comments", "discussion", "responses", "disqus"]), pick(["class", "id"]))

    def junk():
        # Without telling names, only parts that their tags, links or words give away.
        named = [
            lambda: tag("div", words(3, 40), pick(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot", "adsbox"])),
            lambda: tag("div", tag("h3", words(1, 4)) + "".join(tag("p", words(5, 40)) for _ in range(2)), pick(["sidebar", "side", "widget", "right-sidebar", "related", "related-posts", "recommended", "popular"])),
            lambda: tag("div", tag("p", words(6, 40)) + tag("button", words(1, 2)), pick(["cookie", "cookie-notice", "cookies banner", "consent", "notice", "gdpr", "alert", "popup", "modal"])),
            lambda: tag(pick(["section", "div", "ol", "ul"]), "".join(tag(pick(["div", "li", "article"]), tag("p", words(4, 60)), pick(["comment", "comment-body", "reply", None])) for _ in range(rng.randrange(1, 5))), pick(["comments", "comment-list", "discussion", "responses", "disqus"]), pick(["class", "id"])),
            lambda: tag("div", words(3, 25), pick(["footer", "copyright", "legal", "site-footer", "disclaimer"]), pick(["class", "id"])),
            lambda: tag("div", tag("p", words(2, 10)) + (menu(None, "div") if chance(0.4) else ""), pick(["header", "masthead", "topbar", "site-header"]), pick(["class", "id"])),
            lambda: tag("div", tag("p", words(4, 30)), pick(["newsletter", "subscribe", "signup", "promo", "author-bio", "byline-box"])),
            lambda: tag("div", words(5, 30), pick(["navigation", "contentinfo", "complementary", "banner", "alert", "dialog", "search"]), "role"),
            lambda: tag("div", tag("p", words(5, 30)), "overlay"),
        ]
        plain = [
            lambda: menu(),
            lambda: menu(pick(["menu", "navbar", "nav main-nav", "breadcrumb", "topmenu", "pagination", "toc"]), pick(["div", "nav", "ul", "section"])),
            lambda: tag("aside", "".join(tag("p", words(5, 60)) for _ in range(rng.randrange(1, 4))), pick([None, "sidebar", "widget", "related"])),
            lambda: tag("form", tag("label", words(1, 3)) + '<input type="text">' + tag("button", words(1, 2)) + (tag("p", words(5, 20)) if chance(0.4) else ""), pick([None, "search", "newsletter", "signup", "login", "subscribe"])),
            comments,
            lambda: tag("footer", tag("p", "&copy; " + words(3, 20)) if chance(0.5) else "&copy; " + words(2, 5) + " &middot; " + words(3, 15)),
            lambda: tag("header", tag("div", words(1, 4), pick(["logo", "brand", "site-title", None])) + (menu() if chance(0.6) else "") + (tag("p", words(2, 8)) if chance(0.3) else "")),
            lambda: tag("div", "".join(f'<a href="#">{words(1, 1, 0, pick([None, "share"]))}</a> ' for _ in range(4)), pick(["share", "social", "share-buttons", "tags", "social-links"])),
            lambda: tag("dialog", tag("p", words(5, 30))),
            lambda: tag("div", tag("p", words(6, 40)).replace("<p", '<p style="display:none"')),
            lambda: tag("div", pick([words(4, 30, 0.8, "notice", 0.25), tag("p", words(6, 40, 0.8, "notice", 0.2))]) + tag("button", pick(["Accept", "OK", words(1, 2)])), pick(["cookie", "consent", None])),
            lambda: tag(pick(["div", "section"]), tag(pick(["p", "span", "div"]), words(1, 3, 0, "advert", 0.7)) + (tag("p", f'<a href="/go">{words(3, 20)}</a>') if chance(0.7) else ""), pick(["ad", "sponsor", None])),
            lambda: tag(pick(["div", "section"]), tag(pick(["h3", "p", "h4"]), words(2, 6, 0, "sign")) + tag("p", words(4, 18, 0.8, "sign", 0.2)) + ('<input type="email">' + tag("button", words(1, 2, 0, "sign")) if chance(0.6) else ""), pick(["newsletter", None])),
            lambda: tag(pick(["div", "section", "aside"]), tag(pick(["h2", "h3", "h4"]), words(1, 3, 0, "more", 0.6)) + teasers(), pick(["related", "more", None])),
            lambda: tag("div", tag("p", pick(["&copy; ", "Copyright ", "© 2024 "]) + words(2, 12, 0.5, "legal", 0.3)) if chance(0.6) else words(2, 12, 0.3, "legal", 0.4), pick(["footer", "legal"])),
            lambda: tag(pick(["p", "div", "span"]), words(2, 8, 0, pick(["share", "reply", "more", "sign"]), 0.5), None),
        ]
        return pick(named + plain)() if style == "named" else pick(plain)()

    def byline():
        who = words(2, 3, 0).title()
        date = pick([f"{pick(['March', 'May', 'June', 'Mai', 'juin', 'Oct.'])} {rng.randrange(1, 29)}, 20{rng.randrange(10, 25)}", f"20{rng.randrange(10, 25)}-0{rng.randrange(1, 9)}-1{rng.randrange(0, 9)}"])
        line = pick([f"{pick(['By', 'By', 'Von', 'Par', 'Por'])} {who}", f"By {who}, {words(1, 2, 0, 'author', 0.9)}", date, f"Published {date}", f"{rng.randrange(2, 15)} min read", f"By {who} | {date}"])
        return tag(pick(["p", "div", "span", "address"]), line, pick(["byline", "author", "meta", "date", None]))

    def body(content, wide):
        def keep(low, high, end=0.8, cap=False):
            while (s := words(low, high, end)) and _BYLINE.fullmatch(s):
                pass
            content.add(s)
            return s

        def box(inner):
            return tag(pick(["div", "section"]), inner, pick([None, "section", "text", "paragraph"])) if wide and chance(0.2) else inner

        size = pick([(1, 80), (20, 90), (25, 120), (8, 40)])

        def drone():
            """A long text of few words, without a full stop."""
            s = " ".join(" ".join([words(1, 1, 0)] * rng.randint(5, 60)) for _ in range(rng.randint(1, 25)))
            content.add(s)
            return s

        def paragraph():
            if chance(0.03):
                return tag("p", drone())
            return tag("p", keep(*size)) if chance(0.85) else "<p><b>" + (keep(1, 12) if chance(0.9) else drone()) + "<br>"

        out = []
        if chance(0.85):
            out.append(tag("h1", keep(2, 12, 0.3)))
            if chance(0.3):
                out.append(byline())
        if chance(0.12):  # many short lines, some of them repeated
            line = keep(1, 9, 0.5)
            out += [tag("p", line if chance(0.5) else keep(1, 12, 0.5)) for _ in range(rng.randint(6, 50))]
            if chance(0.5):
                return "".join(out)
        elif style != "named" or chance(0.5):
            out.append(paragraph())
        for _ in range(rng.randrange(1, 12)):
            kind = rng.choice([*range(15), 8, 9, 9])
            if kind < 8:
                link = f' <a href="/x">{words(1, 3, 0)}</a>' if chance(0.15) else ""
                s = paragraph()
                if link and s.endswith("</p>"):
                    was = re.sub("<[^>]*>", "", s)
                    now = was + " " + re.sub("<[^>]*>", "", link).strip()
                    content.add(now)
                    s = s[:-4] + link + "</p>"
                out.append(s)
            elif kind == 8:
                out.append(tag(pick(["h2", "h3", "h4"]), keep(1, 8, 0.1)))
                out.append(paragraph())
            elif kind == 9:
                out.append(tag(pick(["ul", "ol"]), "".join(tag("li", keep(2, 20)) for _ in range(rng.randrange(2, 6)))))
            elif kind == 10:
                out.append(tag("blockquote", tag("p", keep(6, 40)) if chance(0.6) else keep(6, 40)))
            elif kind == 11:
                out.append(tag("table", "".join(tag("tr", "".join(tag("td", keep(1, 5)) for _ in range(3))) for _ in range(3))))
            elif kind == 12:
                out.append(tag("pre", keep(3, 20)) if chance(0.5) else tag("figure", tag("figcaption", keep(3, 15))))
            elif kind == 13:
                out.append(keep(15, 60) + ("<br><br>" if chance(0.5) else "<br>") + keep(15, 60) if wide and chance(0.5) else tag("dl", tag("dt", keep(1, 4)) + tag("dd", keep(3, 20))))
            else:
                out.append(tag(pick(["div", "section"]), tag("p", keep(5, 60)), pick([None, "section", "text", "paragraph"])))
            if chance(0.08):
                out.append(junk())
        return "".join(box(x) if x.startswith("<p>") else x for x in out)

    rows = []
    for _ in range(pages):
        style = pick(["named", "named", "coded", "bare", "bare"])
        content: set[str] = set()
        shell = rng.randrange(11)
        text = body(content, shell > 5)
        if shell < 3:
            text = tag("article", text, pick([None, None, "post", "entry"]))
        elif shell == 3:
            text = tag("main", text, pick([None, "content"]))
        elif shell == 4:
            text = tag("main", tag("article", text))
        elif shell == 5:
            text = tag("div", text, pick(["content", "article", "post", "entry-content", "main", "main-content", "article-body", "story", "text"]), pick(["class", "id"]))
        elif shell == 6:
            text = tag("div", tag("div", text, pick(["content", "post-body", "entry", "story"])), pick(["container", "wrapper", "page", "row"]))
        elif shell == 7:
            text = tag("section", text, pick(["content", "article", None]))
        elif shell == 8:
            text = tag("table", tag("tr", (tag("td", menu(None, "div")) if chance(0.5) else "") + tag("td", text)))
        elif shell == 9:
            for _ in range(rng.randrange(1, 4)):
                text = tag("div", text, pick([None, "content", "row", "col"]))
        before = "".join(junk() for _ in range(rng.randrange(0, 4)))
        after = "".join(junk() for _ in range(rng.randrange(0, 5)))
        inner = before + text + after
        if chance(0.3):
            inner = tag("div", inner, pick(["container", "wrapper", "page", "site", None]))
        rows.append((f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t = 1;</script></head><body>{inner}</body></html>", content))
    # Embedded elements go in last, so that the layouts stay as drawn.
    for k, (html, content) in enumerate(rows):
        for place in sorted(f"<p>{c}</p>" for c in content if f"<p>{c}</p>" in html):
            if chance(0.12):
                s = words(2, 12)
                kind = rng.randrange(4)
                if kind == 0:
                    name = pick(["object", "map"])
                    extra = f"<{name}>" + (f"<p>{s}</p>" if chance(0.5) else s) + f"</{name}>"
                    content.add(s)
                elif kind == 1:
                    extra = "<noscript>" + (f"<p>{s}</p>" if chance(0.5) else s) + "</noscript>"
                elif kind == 2:
                    extra = f"<svg><text>{s}</text></svg>"
                else:
                    name = pick(["video", "audio", "canvas", "template", "datalist"])
                    extra = f"<{name}>{s}</{name}>"
                html = html.replace(place, place + extra, 1) if chance(0.6) else html.replace(place, place[:-4] + " " + extra + "</p>", 1)
        rows[k] = html, content
    return rows
