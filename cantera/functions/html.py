"""Elements of HTML by a tokenizer with a stack of open elements.

Patterns over markup go wrong where an attribute holds a ">" or where nesting matters. Here
a page is read once, as a stream of tags and text; the stack of open elements is all that is
kept, with the text of those that were asked for. End tags that HTML lets authors leave out
are put in for list items, table rows and cells, options, definitions and paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag; what a start tag closes, and where that search ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
FENCES = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADING = re.compile(r"h[1-6]")
HIDDEN = frozenset(("script", "style", "noscript", "template"))


@dataclass
class Element:
    """An element: its attributes, its parents, and, once it is closed, its text."""

    tag: str
    attributes: dict[str, str]
    parent: Element | None
    heading: str = ""  # the last heading among the children so far
    before: str = ""  # the heading before the element among its siblings
    text: list[str] | None = None
    links: list[str] = field(default_factory=list)
    named: dict[str, list[str]] = field(default_factory=dict)  # texts of the first descendant of each tag asked for

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def up(self) -> Iterator[Element]:
        """The element and its parents; the last one is the page."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


class Reader(HTMLParser):
    """Calls ``closed`` with every element that ``wanted`` accepts, when it ends; document order is kept by ``started``."""

    def __init__(self, wanted: Callable[[Element], bool], closed: Callable[[int, Element], None], named: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self.wanted, self.closed, self.named = wanted, closed, frozenset(named)
        self.stack = [Element("", {}, None)]  # the page itself
        self.collecting: list[tuple[int, Element]] = []
        self.reading: list[tuple[Element, list[str]]] = []  # open headings and named descendants, with their text
        self.started = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for closing in CLOSES.get(tag, ()):
            self._close(closing, FENCES[tag])
        if tag in ENDS_PARAGRAPH:
            self._close("p", ("div", "li", "td", "article", "section", "body"))
        parent = self.stack[-1]
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, parent, before=parent.heading)
        for _, c in self.collecting:
            if tag == "a":
                c.links.append(e.get("href"))
        self.started += 1
        if tag in VOID:
            if self.wanted(e):
                e.text = []
                self.closed(self.started, e)
            return
        self.stack.append(e)
        if tag in self.named and any(tag not in c.named for _, c in self.collecting) or HEADING.fullmatch(tag):
            parts: list[str] = []
            self.reading.append((e, parts))
            for _, c in self.collecting:
                c.named.setdefault(tag, parts)
        if self.wanted(e):
            e.text = []
            self.collecting.append((self.started, e))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag in HIDDEN:
            return
        for _, c in self.collecting:
            c.text.append(data)
        for _, parts in self.reading:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.stack):
            self._close(tag, ())

    def _close(self, tag: str, fences: tuple[str, ...]) -> None:
        """Close the innermost open element of a tag and all in it, unless a fence stands before it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._end(self.stack.pop())
                return
            if self.stack[k].tag in fences:
                return

    def _end(self, e: Element) -> None:
        if self.reading and self.reading[-1][0] is e:
            _, parts = self.reading.pop()
            if HEADING.fullmatch(e.tag):
                e.parent.heading = " ".join(parts)
        if self.collecting and self.collecting[-1][1] is e:
            self.closed(*self.collecting.pop())

    def read(self, html: str) -> None:
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._end(self.stack.pop())


def elements(html: str, wanted: Callable[[Element], bool], named: tuple[str, ...] = ()) -> list[Element]:
    """The elements that ``wanted`` accepts at their start, in document order, with their texts."""
    found: list[tuple[int, Element]] = []
    Reader(wanted, lambda k, e: found.append((k, e)), named).read(html)
    return [e for _, e in sorted(found, key=lambda x: x[0])]


def spelled(html: str) -> str:
    """A page whose text reads ``_`` for each whole named reference (``&amp;``) and any other ampersand as it stands.

    A browser also decodes references that lack their semicolon (``&amp``, ``&copy``); this is for counts that mustn't.
    """
    return re.sub(r"&(?:([a-z]+);)?", lambda m: "_" if m[1] else "&amp;", html)
