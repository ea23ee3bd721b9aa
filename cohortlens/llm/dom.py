"""A small reader of HTML: block elements as a tree, with the text runs between their borders.

It keeps what main-text extraction needs and no more: inline elements only tell link text from
other text, and unclosed or misplaced tags end as browsers would end them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names by how they are read.
BLOCKS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript object ol p pre section select summary svg table tbody td template tfoot "
    "th thead tr ul").split())
BREAKS = frozenset("hr html head frameset frame option".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose text never is part of a page's text.
DROPPED = frozenset("button noscript object select svg template".split())
#: A start tag that ends open elements: which, and what shields them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Elements that a paragraph may not contain, and so end it.
_HOLDS_P = frozenset("button object template td th caption li dd body".split())

# A value is quoted only where a quote follows its "="; a quote that never ends is part of an unquoted value.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*+"
_MARKUP = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE}))?+)*+)>", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attrs: str
    dropped: bool
    chars: int = 0  # of its own text
    link_chars: int = 0
    stops: int = 0  # ends of sentences in its own text


@dataclass(slots=True)
class Page:
    """``nodes`` in document order (parents first, 0 is the body); ``runs`` are ``(node, text)``."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def parse(html: str) -> Page:
    page = Page([Node("body", -1, "", False)])
    nodes, open_, text = page.nodes, [0], []
    in_head = in_link = False
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                node = nodes[open_[-1]]
                node.chars += len(words)
                node.link_chars += min(linked, len(words))
                node.stops += words.count(". ") + words.count("! ") + words.count("? ") + (words[-1] in ".!?")
                page.runs.append((open_[-1], words))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not in_head:
            text.append(piece)
            if in_link:
                linked += len(piece)

    def close(names: tuple[str, ...] | frozenset[str], shields: tuple[str, ...] | frozenset[str]) -> None:
        """End the innermost open element of these names, unless a shield lies above it."""
        for i in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[i]].tag
            if tag in names:
                del open_[i:]
                return
            if tag in shields:
                return

    at = 0
    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at, name = m.end(), m["name"]
        if name is None:
            continue
        name, end = name.lower(), bool(m["end"])
        if name in RAW and not end:
            done = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
            at = done.end() if done else len(html)
        elif name == "head":
            in_head = not end
        elif name == "body" and not end:
            flush()
            in_head, nodes[0].attrs = False, m["attrs"]
        elif name in BLOCKS and name != "body":
            flush()
            if end:
                close((name,), ("td", "th", "table") if name in ("p", "li", "div", "span") else ())
            else:
                in_head = False
                if name in ENDS:
                    if name != "li" or nodes[open_[-1]].tag == "p":
                        close(("p",), _HOLDS_P)
                    close(*ENDS[name])
                else:
                    close(("p",), _HOLDS_P)
                if name[0] == "h" and name[1:].isdigit() and nodes[open_[-1]].tag[0] == "h" and nodes[open_[-1]].tag[1:].isdigit():
                    open_.pop()
                top = open_[-1]
                nodes.append(Node(name, top, m["attrs"], nodes[top].dropped or name in DROPPED))
                if not m["attrs"].rstrip().endswith("/") or name != "svg":
                    open_.append(len(nodes) - 1)
            in_link = False
        elif name in BREAKS:
            flush()
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = not end
    flush()
    return page
