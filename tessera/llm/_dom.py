"""A forgiving HTML reader: block elements as a tree, text as blocks in page order.

Only what the HTML standard reads raw (``RAW``) is no text, and without a closing tag to the
end of the page.  ``EMBEDDED`` elements are nodes whose text forms blocks of its own; one
without a closing tag is ignored and its text is its parent's.  Formulas are inline text.
Only foreign elements (``svg``, ``math`` and what they hold) close themselves by a slash.

The time is linear in the page, whatever its nesting: the open elements of every name are
known by place, so an end tag without a partner costs nothing.  Elements nested deeper than
``DEEPEST`` hang on their ancestor of that depth, as in browsers; their text stays.
"""

from __future__ import annotations

import re
from html import unescape

DEEPEST = 512

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-label|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
EMBEDDED = frozenset("template noscript svg object canvas audio video map datalist".split())
#: Of these, what is never shown.
_UNSEEN = frozenset("template datalist".split())
_FOREIGN = frozenset("svg math".split())
_EMBEDDED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(EMBEDDED))})(?=[\s/>])", re.I)
BLOCK = frozenset(
    "html head body title nav header footer main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog menu hr center option select textarea button label hgroup search".split()
)
#: Elements that an opening tag closes first, and those that stop the search.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
_ENDS_P = BLOCK - {"html", "head", "body", "title", "option", "select", "textarea", "button", "label", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend"}
_FENCE = frozenset("td th table article section main aside nav header footer div body".split())
_FENCED = frozenset("p li a b i span em strong".split())
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
#: A script's comment that was cut by a closing tag inside it.
_CUT_COMMENT = re.compile(r"[^<]*?--!?>\s*</script(?=[\s/>])[^>]*>", re.I)


class Page:
    """Nodes in page order (``tag, parent, tokens, hidden``) and blocks ``(node, text, linked)``."""

    __slots__ = ("tags", "parents", "tokens", "hidden", "blocks")

    def __init__(self) -> None:
        self.tags, self.parents, self.tokens, self.hidden = ["#page"], [-1], [()], [False]
        self.blocks: list[tuple[int, str, int]] = []


def _closed(html: str) -> set[int]:
    """Places of the opening tags of embedded elements that have a closing tag."""
    opened: dict[str, list[int]] = {}
    found = set()
    for m in _EMBEDDED_TAG.finditer(html):
        mine = opened.setdefault(m[2].lower(), [])
        if not m[1]:
            mine.append(m.start())
        elif mine:
            found.add(mine.pop())
    return found


def _after_raw(html: str, name: str, at: int) -> int:
    """Place after a raw element whose content begins at ``at``."""
    close = _CLOSING[name].search(html, at)
    if close is None:
        return len(html)
    if name == "script":
        opened = html.rfind("<!--", at, close.start())
        if opened >= 0 and html.find("-->", opened, close.start()) < 0 and (more := _CUT_COMMENT.match(html, close.end())):
            return more.end()
    return close.end()


def read(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with their block node
    places: dict[str, list[int]] = {}  # of every open name, its places in the stack
    fences: list[int] = []  # places of open fences
    deep: list[int] = [0]  # depth of every node
    parts: list[str] = []
    linked = links = foreign = owner = 0  # owner: the node of the parts
    at, size = 0, len(html)
    closed: set[int] | None = None

    def text(s: str, plain: bool = False) -> None:
        nonlocal linked, owner
        if s:
            s = unescape(s) if "&" in s and not plain else s
            if not s.isspace():
                if owner != stack[-1][1]:
                    flush()
                owner = stack[-1][1]
            parts.append(s)
            if links:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                page.blocks.append((owner, whole, min(linked, len(whole))))
            parts.clear()
        linked = 0

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in _FENCE:
            fences.append(len(stack))
        stack.append((name, node))

    def last(names) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def pop_to(k: int) -> None:
        """Close open elements down to index k (that one too)."""
        nonlocal links, foreign
        block = False
        while len(stack) > k:
            name, _ = stack.pop()
            places[name].pop()
            if name in _FENCE:
                fences.pop()
            block |= name in BLOCK
            links -= name == "a"
            foreign -= name in _FOREIGN
        if block:
            flush()

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["cdata"]:
                text(m["cdata"], plain=True)
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            k = last((name,))
            if k and not (name in _FENCED and fences and fences[-1] > k):
                pop_to(k)
            continue
        if name == "br" or name == "hr":
            flush()
            continue
        if name in VOID:
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if attrs and attrs.endswith("/") and (foreign or name in _FOREIGN):
            continue
        if name in EMBEDDED:
            closed = _closed(html) if closed is None else closed
            if m.start() not in closed:
                continue
        if name in RAW:
            at = _after_raw(html, name, at)
            continue
        if name in _CLOSES:
            shut, fence = _CLOSES[name]
            stop = last(fence)
            while (k := last(shut)) > stop:
                pop_to(k)
                if name not in ("tr", "tbody", "tfoot"):
                    break
        if name in BLOCK or name in EMBEDDED:
            if name in BLOCK:
                flush()
            if name in _ENDS_P:
                k = last(("p",))
                if k and not (fences and fences[-1] > k):
                    pop_to(k)
            words, hidden = [], name in _UNSEEN
            if attrs and len(attrs) > 1:
                for a in _ATTR.finditer(attrs):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                        hidden = True
                    elif key in ("class", "id", "role", "aria-label"):
                        words += _NAME.findall(value)
            parent = stack[-1][1]
            if deep[parent] >= DEEPEST:
                parent = page.parents[parent]
            deep.append(deep[parent] + 1)
            page.tags.append(name)
            page.parents.append(parent)
            page.tokens.append(tuple(words))
            page.hidden.append(hidden)
            push(name, len(page.tags) - 1)
        else:
            if name == "a":
                links += 1
            push(name, stack[-1][1])
        foreign += name in _FOREIGN
    flush()
    return page
