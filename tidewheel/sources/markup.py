"""Links of pages, by a tokenizer over the markup.

Comments, scripts and quoted attributes are no markup, elements nest, and all character references are decoded once: unknown ones
stay, numbers without a sign give U+FFFD.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: Elements whose text is not shown.
UNSEEN = ("script", "style", "template")
LINK = pa.struct([("title", pa.string()), ("href", pa.string())])


class _Enough(Exception):
    pass


class Links(HTMLParser):
    """Title and target of the first ``cap`` anchors within the given elements (or directly in one), in the order in which they open.

    A title is the anchor's text nodes, each trimmed, one after the other.
    """

    def __init__(self, within: Sequence[str], direct: bool, cap: int) -> None:
        super().__init__(convert_charrefs=True)
        self.within, self.direct, self.cap = frozenset(within), direct, cap
        self.stack: list[tuple[str, int]] = []  # open elements, and for an anchor that counts its place
        self.names: Counter[str] = Counter()
        self.inside = 0
        self.found: list[tuple[list[str], str]] = []
        self.open: list[int] = []
        self.text: list[str] = []

    def _end_of_text(self) -> None:
        node = "".join(self.text).strip()
        self.text.clear()
        if node and self.open and not any(name in UNSEEN for name, _ in self.stack[-1:]):
            for place in self.open:
                self.found[place][0].append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_of_text()
        place = -1
        here = bool(self.stack) and self.stack[-1][0] in self.within if self.direct else self.inside > 0
        if tag == "a" and here and len(self.found) < self.cap:
            place = len(self.found)
            self.found.append(([], dict(reversed(attrs)).get("href") or ""))
            self.open.append(place)
        if tag in VOID:
            return
        self.stack.append((tag, place))
        self.names[tag] += 1
        self.inside += tag in self.within

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end_of_text()
        if not self.names[tag]:
            return
        name = None
        while name != tag:
            name, place = self.stack.pop()
            self.names[name] -= 1
            self.inside -= name in self.within
            if place >= 0:
                self.open.remove(place)
        if len(self.found) == self.cap and not self.open:
            raise _Enough

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_of_text()

    def links(self, page: str) -> list[dict[str, str]]:
        try:
            self.feed(page)
            self.close()
            self._end_of_text()
        except _Enough:
            pass
        return [{"title": "".join(parts), "href": href} for parts, href in self.found]


def anchors(html: Column, within: Sequence[str], direct: bool, cap: int) -> Column:
    """(title, href) of a page's links; null for a null page."""
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else Links(within, direct, cap).links(p) for p in pages.to_pylist()], pa.list_(LINK))

    return F.arrow_udf(run, "array<struct<title: string, href: string>>")(html)
