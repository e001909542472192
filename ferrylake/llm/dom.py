"""A small forgiving HTML reader: block elements as a tree, text in page order.

Inline elements are part of the block around them. Time is linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import xxhash

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?"
                         r"(?:;|$)", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark output q rp rt ruby s samp small span strike strong sub sup time tt u "
                   "var".split())
# An opening tag of the first set closes an open element of the second, within the third.
_LIST, _TABLE, _ROW = {"ul", "ol", "menu"}, {"table"}, {"table", "tr"}
_CLOSES = {"li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, _TABLE), "td": ({"td", "th"}, _ROW),
           "th": ({"td", "th"}, _ROW), "option": ({"option"}, {"select"}),
           "tbody": ({"thead", "tbody", "tr", "td", "th"}, _TABLE),
           "tfoot": ({"tbody", "tr", "td", "th"}, _TABLE)}
MAX_DEPTH = 64          # a site's statistics go down to this depth, a page's tree further


@dataclass
class Node:
    tag: str
    tokens: frozenset[str]
    parent: int
    depth: int
    path: int
    hidden: bool = False
    names: tuple[str, ...] = ()                            # in class and role
    ident: str = ""
    children: list[str] = field(default_factory=list)     # labels, runs collapsed


@dataclass
class Page:
    nodes: list[Node]
    segments: list[tuple[int, str]]       # (node, text) in page order
    linked: dict[int, int] = field(default_factory=dict)  # node -> characters inside <a>


def _attributes(attrs: str) -> tuple[frozenset[str], bool, tuple[str, ...], str]:
    """(words of class, id, role and itemprop; hidden; names in class and role; id)
    of a tag's attributes. Values of other attributes say nothing."""
    found: set[str] = set()
    names: list[str] = []
    hidden, ident = False, ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden |= value.lower() != "until-found"
        elif name == "style":
            hidden |= _NO_DISPLAY.search(value) is not None
        elif name in ("class", "id", "role", "itemprop"):
            found.update(words_of(value))
            if name in ("class", "role"):
                names += value.split()
            elif name == "id":
                ident = value
    return frozenset(found), hidden, tuple(names), ident


def words_of(name: str) -> list[str]:
    return _TOKEN.findall(_CAMEL.sub(" ", name).lower())


def _label(tag: str, tokens: frozenset[str]) -> str:
    return tag + "." + ".".join(sorted(tokens)) if tokens else tag


def parse(text: str) -> Page:
    nodes = [Node("html", frozenset(), -1, 0, xxhash.xxh64_intdigest("html") >> 1)]
    segments: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]          # open elements and their block
    buffer: list[str] = []
    lowered: list[str] = []
    linked: dict[int, int] = {}

    def flush() -> None:
        if buffer:
            words = _html.unescape("".join(buffer)).split()
            buffer.clear()
            if words:
                segments.append((stack[-1][1], " ".join(words)))

    def close_to(k: int) -> None:
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        del stack[k:]

    n, i = len(text), 0
    last_gt, last_q = text.rfind(">"), {'"': text.rfind('"'), "'": text.rfind("'")}
    while i < n:
        lt = text.find("<", i)
        if lt < 0:
            buffer.append(text[i:])
            break
        if lt > i:
            buffer.append(text[i:lt])
            if stack[-1][0] in INLINE and _in_link(stack):
                linked[stack[-1][1]] = linked.get(stack[-1][1], 0) + lt - i
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            i = n if end < 0 else end + 3
            continue
        m = _NAME.match(text, lt + 1)
        if not m:
            if text[lt + 1:lt + 2] in ("!", "?", "/") and lt < last_gt:
                i = text.find(">", lt) + 1
            else:
                buffer.append("<")
                i = lt + 1
            continue
        j = m.end()
        while True:                                       # the end of the tag
            if j > last_gt:
                j = n
                break
            s = _STOP.search(text, j)
            if s[0] == ">":
                j = s.end()
                break
            j = s.end()
            if j <= last_q[s[0]]:
                j = text.find(s[0], j) + 1
        name, attrs = m[0].lower(), text[m.end():j]
        i = j
        if name[0] == "/":
            name = name[1:]
            if name in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close_to(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name in ("html", "body") and (name == "html" or any(t == "body" for t, _ in stack)):
            continue
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                buffer.append(" " if name == "br" else "")
            continue
        if name in _CLOSES:
            closes, within = _CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in closes:
                    close_to(k)
                    break
        elif name not in RAW:
            for k in range(len(stack) - 1, 0, -1):        # a block ends an open paragraph
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name == "body":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "head":
                    close_to(k)
                    break
        if name in RAW:
            if not lowered:
                lowered.append(text.lower() if len(text.lower()) == n else text)
            end = lowered[0].find("</" + name, i)
            i = n if end < 0 else end
            if name == "textarea" or name == "title":
                flush()
            continue
        flush()
        parent = stack[-1][1]
        tokens, hidden, names, ident = _attributes(attrs) if attrs.strip("/> ") else (
            frozenset(), False, (), "")
        label = _label(name, tokens)
        kids = nodes[parent].children
        if not kids or kids[-1] != label:
            kids.append(label)
        path = xxhash.xxh64_intdigest(label, nodes[parent].path) >> 1
        nodes.append(Node(name, tokens, parent, nodes[parent].depth + 1, path, hidden,
                          names, ident))
        stack.append((name, len(nodes) - 1))
    flush()
    return Page(nodes, segments, linked)


def _in_link(stack: list[tuple[str, int]]) -> bool:
    for tag, _ in reversed(stack[-8:]):
        if tag == "a":
            return True
        if tag not in INLINE:
            return False
    return False
