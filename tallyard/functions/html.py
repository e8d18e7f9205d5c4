"""A light HTML tree on the standard parser, with the selectors that page reading needs.

Void elements and implied end tags are handled, so markup that is no well-formed XML reads as a browser would read it.
Scripts never run. Nothing here depends on Spark; the Arrow functions that use it are in :mod:`tallyard.operators.pages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of the listed elements begins.
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article header footer nav form blockquote pre address main aside".split()),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": set(), "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, scripts: bool = False) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif scripts or x.tag not in ("script", "style", "noscript", "template"):
                stack += reversed(x.children)
        return "".join(out)

    def line(self) -> str:
        return re.sub(r"\s+", " ", self.text()).strip()

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self, selector: str) -> list[Node]:
        chains = [_chain(s) for s in selector.split(",")]
        return [n for n in self.walk() if any(_matches(n, c, self) for c in chains)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.all(selector)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at
        while node is not self.root:
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent
                node = self.at
                continue
            if node.tag in SCOPES and tag in CLOSED_BY.get(node.tag, ()):
                break
            if not any(tag in CLOSED_BY.get(t, ()) and node.tag not in SCOPES[t] for t in SCOPES):
                break
            node = node.parent
        made = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_STEP = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")
_CHAINS: dict[str, list] = {}


def _chain(selector: str) -> list:
    """Steps of a selector: tag, id, classes and attribute tests, outermost first."""
    key = selector.strip()
    if key not in _CHAINS:
        steps = []
        for part in re.findall(r"(?:[^\s\[]+(?:\[[^\]]*\])*|\[[^\]]*\])+", key):
            m = _STEP.match(part)
            if not m:
                raise ValueError(f"selector {selector!r}")
            tests = re.findall(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^*]?=)\"?([^\"\]]*)\"?)?\]", m[2] or "")
            steps.append((m[1] if m[1] != "*" else None, tests))
        _CHAINS[key] = steps
    return _CHAINS[key]


def _fits(node: Node, step: tuple) -> bool:
    tag, tests = step
    if tag and node.tag != tag.lower():
        return False
    for cls, ident, attr, op, value in tests:
        if cls and cls not in node.classes:
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr:
            held = node.attrs.get(attr)
            if held is None or (op == "=" and held != value) or (op == "^=" and not held.startswith(value)) or (op == "*=" and value not in held):
                return False
    return True


def _matches(node: Node, chain: list, top: Node) -> bool:
    if not _fits(node, chain[-1]):
        return False
    rest, up = list(chain[:-1]), node.parent
    while rest and up is not None and up is not top.parent:
        if _fits(up, rest[-1]):
            rest.pop()
        up = up.parent
    return not rest
