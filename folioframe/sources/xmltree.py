"""A lenient tree over markup text: prefixes need no declaration, stray closing tags are ignored, nodes know their places."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: One token: comment, CDATA, declaration, or a tag with its attributes.
TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<data>.*?)\]\]>|<[?!][^>]*>|<(?P<close>/)?(?P<name>[A-Za-z_][\w:.-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ENTITY = re.compile(r"&(#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z]+);")
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decode(text: str, any_case: bool = False) -> str:
    """Entities decoded in one pass from left to right; unknown ones and NUL stay as they are."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "#":
            n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
            return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]
        return NAMED.get(e.lower() if any_case else e, m[0])

    return ENTITY.sub(one, text) if "&" in text else text


def encode(text: str, quotes: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quotes else text


class Node:
    """An element: name, attributes, children (nodes and decoded texts), and its place [start, end) in the source."""

    __slots__ = ("name", "attrs", "children", "start", "end", "source")

    def __init__(self, name: str, attrs: dict[str, str], start: int, source: str):
        self.name, self.attrs, self.children, self.start, self.end, self.source = name, attrs, [], start, start, source

    @property
    def xml(self) -> str:
        return self.source[self.start : self.end]

    def get(self, attribute: str) -> str | None:
        """An attribute's value, with or without its prefix; None where missing or empty."""
        v = self.attrs.get(attribute)
        if v is None and ":" not in attribute:
            v = next((x for k, x in self.attrs.items() if k.rpartition(":")[2] == attribute), None)
        return v or None

    def nodes(self, *names: str) -> list[Node]:
        """Child elements, of these names if any are given."""
        return [c for c in self.children if isinstance(c, Node) and (not names or c.name in names)]

    def child(self, *path: str) -> Node | None:
        at: Node | None = self
        for name in path:
            at = next(iter(at.nodes(name)), None) if at is not None else None
        return at

    def walk(self, *names: str) -> Iterator[Node]:
        """All descendants in document order."""
        stack = list(reversed(self.nodes()))
        while stack:
            n = stack.pop()
            if not names or n.name in names:
                yield n
            stack.extend(reversed(n.nodes()))

    def first(self, *names: str) -> Node | None:
        return next(self.walk(*names), None)

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(parts)


def parse(source: str) -> Node:
    """The root holds everything at the top level; elements left open end with the text."""
    root = Node("", {}, 0, source)
    open_, at = [root], 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            open_[-1].children.append(decode(source[at : m.start()]))
        at = m.end()
        if m["data"] is not None:
            open_[-1].children.append(m["data"])
        elif m["name"] is None:
            continue
        elif m["close"]:
            if any(n.name == m["name"] for n in open_[1:]):
                while open_[-1].name != m["name"]:
                    open_.pop().end = m.start()
                open_.pop().end = m.end()
        else:
            node = Node(m["name"], {k: decode(a or b) for k, a, b in ATTRIBUTE.findall(m["attrs"])}, m.start(), source)
            node.end = m.end()
            open_[-1].children.append(node)
            if not m["empty"]:
                open_.append(node)
    if at < len(source):
        open_[-1].children.append(decode(source[at:]))
    for n in open_:
        n.end = len(source)
    return root


def balanced(source: str, *names: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the outermost elements with one of the names, in order; names compare without case."""
    wanted, out, stack = {n.lower() for n in names}, [], []
    for m in TOKEN.finditer(source):
        name = (m["name"] or "").lower()
        if name not in wanted:
            continue
        if m["close"]:
            if name in [n for n, _ in stack]:
                while stack[-1][0] != name:
                    stack.pop()
                _, start = stack.pop()
                if not stack:
                    out.append((start, m.end(), name))
        elif m["empty"]:
            if not stack:
                out.append((m.start(), m.end(), name))
        else:
            stack.append((name, m.start()))
    return out
