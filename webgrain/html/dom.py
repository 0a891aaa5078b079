"""A small DOM over the standard library's tokeniser.

It repairs what real pages get wrong: paragraphs and list items without end tags,
end tags without a start, void elements, and unknown nesting.  Nodes are either
strings (text) or Elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.entities import html5
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
}
RAW = frozenset(("script", "style"))
BLOCK = ENDS_PARAGRAPH | frozenset("body html li dd dt tr td th tbody thead tfoot caption hgroup legend option title".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag != "!--":
                stack.extend(reversed(e.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace_with_children(self) -> None:
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        for c in self.children:
            if isinstance(c, Element):
                c.parent = self.parent
        self.parent.children[at : at + 1] = self.children
        self.parent = None

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inner_html(self) -> str:
        return "".join(_html(c, self.tag) for c in self.children)

    def outer_html(self) -> str:
        return _html(self, None)

    def copy(self) -> Element:
        """A tree of its own; without recursion, so deep pages are no trouble."""
        top = Element(self.tag, dict(self.attrs))
        todo = [(self, top)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                if isinstance(c, Element):
                    fresh = Element(c.tag, dict(c.attrs), new)
                    new.children.append(fresh)
                    todo.append((c, fresh))
                else:
                    new.children.append(c)
        return top


def _html(node: Element | str, within: str | None) -> str:
    out: list[str] = []
    stack: list = [(node, within)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):  # an end tag
            out.append(item)
            continue
        e, parent = item
        if isinstance(e, str):
            out.append(e if parent in RAW else escape(e, quote=False))
        elif e.tag == "!--":
            out.append(f"<!--{e.attrs.get('data', '')}-->")
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in e.attrs.items())
            out.append(f"<{e.tag}{attrs}>")
            if e.tag not in VOID:
                stack.append(f"</{e.tag}>")
                stack.extend((c, e.tag) for c in reversed(e.children))
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def _close_to(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_to({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "table", "button"})
        if tag in CLOSES:
            tags, stop = CLOSES[tag]
            for _ in range(3):
                self._close_to(tags, stop)
        parent = self.open[-1]
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        e = Element(tag, seen, parent)
        parent.children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "td", "th", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Element("!--", {"data": data}, self.open[-1]))


_UNREAD = re.compile(r"(<!--.*?-->|<(script|style)\b.*?</\2)|&(?:(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)?", re.DOTALL | re.IGNORECASE)


def _bare_kept(m: re.Match) -> str:
    """What was found, an ampersand that opens no reference with a semicolon being escaped."""
    whole = m[1] or (m[3] and (m[3].startswith("#") or f"{m[3]};" in html5))
    return m[0] if whole else "&amp;" + m[0][1:]


def parse(html: str, *, bare_references: bool = True) -> Element:
    """The document of a page; any text gives one.

    HTML reads some references without their semicolon too (``&amp`` at the end of a
    text that was cut off); without bare_references they stay as they are.
    """
    builder = _Builder()
    builder.feed(html if bare_references else _UNREAD.sub(_bare_kept, html))
    builder.close()
    return builder.root


_BLANK = re.compile(r"\s+")


def collapse(text: str) -> str:
    return _BLANK.sub(" ", text).strip()


# -- selectors -----------------------------------------------------------------

_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$~]?=)\"?([^\"\]]*?)\"?( i)?)?\]")


class Simple:
    """One compound selector: tag, id, classes and attributes."""

    def __init__(self, text: str):
        self.tests = []
        at = 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"bad selector {text!r}")
            tag, ident, cls, attr, op, value, fold = m.groups()
            if tag and tag != "*":
                self.tests.append(lambda e, t=tag.lower(): e.tag == t)
            elif ident:
                self.tests.append(lambda e, i=ident: e.attrs.get("id") == i)
            elif cls:
                self.tests.append(lambda e, c=cls: c in e.classes)
            elif attr:
                self.tests.append(self._attribute(attr.lower(), op, value, fold))
            at = m.end()

    @staticmethod
    def _attribute(name: str, op: str | None, value: str | None, fold: str | None):
        if op is None:
            return lambda e: name in e.attrs
        want = value.lower() if fold else value
        how = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda s, v: v in s.split()}[op]
        return lambda e: name in e.attrs and bool(how(e.attrs[name].lower() if fold else e.attrs[name], want))

    def __call__(self, e: Element) -> bool:
        return e.tag != "!--" and all(t(e) for t in self.tests)


class Selector:
    """A list of selectors with descendant and child combinators."""

    def __init__(self, text: str):
        self.chains = []
        for one in text.split(","):
            parts = re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", one.strip())
            chain: list[tuple[str, Simple]] = []
            how = " "
            for p in parts:
                if p == ">":
                    how = ">"
                else:
                    chain.append((how, Simple(p)))
                    how = " "
            if not chain:
                raise ValueError(f"bad selector {text!r}")
            self.chains.append(chain)

    def matches(self, e: Element) -> bool:
        return any(self._fits(e, c, len(c) - 1) for c in self.chains)

    def _fits(self, e: Element, chain: list, k: int) -> bool:
        how, simple = chain[k]
        if not simple(e):
            return False
        if k == 0:
            return True
        up = e.parent
        if how == ">":
            return up is not None and self._fits(up, chain, k - 1)
        while up is not None:
            if self._fits(up, chain, k - 1):
                return True
            up = up.parent
        return False

    def all(self, root: Element) -> list[Element]:
        return [e for e in root.elements() if self.matches(e)]

    def first(self, root: Element) -> Element | None:
        return next((e for e in root.elements() if self.matches(e)), None)
