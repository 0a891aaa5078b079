"""Pages cut down for language models, and records by declared selectors."""

from __future__ import annotations

import re

from .dom import Element, Selector, collapse, parse

# What a model doesn't need to see.
DROPPED = Selector(
    "script, style, noscript, iframe, svg, link, meta, head, nav, footer, header, aside, form, input, button, select, textarea, .ad, .ads, .advertisement, .sidebar, .menu, .nav, "
    "[class*=cookie], [class*=banner], [class*=popup], [class*=modal], [id*=cookie], [id*=banner], [id*=popup], [id*=modal], "
    "[role=navigation], [role=banner], [role=complementary], [aria-hidden=true], [hidden]"
)
# Prefixes of classes that only style.
UTILITY = (
    "p", "m", "px", "py", "mx", "my", "pt", "pb", "pl", "pr", "mt", "mb", "ml", "mr", "w", "h", "min-w", "max-w", "min-h", "max-h", "text",
    "bg", "border", "rounded", "flex", "grid", "gap", "space", "items", "justify", "self", "content", "order", "col", "row", "inline", "block",
    "hidden", "visible", "opacity", "shadow", "ring", "outline", "cursor", "pointer", "select", "overflow", "whitespace", "truncate", "font",
    "leading", "tracking", "align", "float", "clear", "sticky", "fixed", "absolute", "relative", "static", "top", "bottom", "left", "right",
    "z", "transform", "translate", "rotate", "scale", "transition", "duration", "ease", "delay", "animate", "hover", "focus", "active",
    "disabled", "group", "peer", "dark", "sm", "md", "lg", "xl", "2xl",
)
_UTILITY = re.compile(rf"(?:[a-z]+:)?(?:{'|'.join(UTILITY)})[-:].+")
KEPT_ATTRIBUTES = {"": {"class", "aria-label", "title", "itemtype", "itemprop"}, "a": {"href"}, "img": {"src", "alt"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}
STRUCTURAL = frozenset(("table", "tr", "ul", "ol", "dl", "tbody", "thead"))
RATINGS = {w: n for n, w in enumerate(("one", "two", "three", "four", "five"), 1)}
MAX_CHARS = 60_000


def semantic_classes(value: str, most: int = 6) -> str:
    """The classes that mean something, the first six."""
    return " ".join([c for c in value.split() if not _UTILITY.fullmatch(c)][:most])


class _Kept:
    """What is left of an element once all below it has been seen."""

    __slots__ = ("source", "todo", "nodes", "says", "shows")

    def __init__(self, source: Element):
        self.source, self.todo = source, iter(source.children)
        self.nodes: list[Element | str] = []
        self.says = self.shows = False  # holds text, an image

    def take(self, nodes: list[Element | str], says: bool, shows: bool) -> None:
        self.nodes += nodes
        self.says |= says
        self.shows |= shows

    def attributes(self) -> dict[str, str]:
        allowed = KEPT_ATTRIBUTES[""] | KEPT_ATTRIBUTES.get(self.source.tag, set())
        found = {k: semantic_classes(v) if k == "class" else v for k, v in self.source.attrs.items() if k in allowed or k.startswith("data-")}
        return {k: v for k, v in found.items() if k != "class" or v}

    def close(self) -> None:
        """Hands what the element comes to to ``nodes``: itself, its children, or nothing."""
        tag, attrs = self.source.tag, self.attributes()
        names = self.source.attrs.get("class", "").lower()
        stars = next((RATINGS[w] for w in names.split() if w in RATINGS), None) if "rating" in names or "stars" in names else None
        if stars:
            attrs.setdefault("data-rating-decoded", str(stars))
            if not self.says:
                self.nodes, self.says = [f"Rating: {stars}/5"], True
        self.shows |= tag == "img"
        means = any(v for k, v in attrs.items() if k in KEPT_ATTRIBUTES[""]) or any(k.startswith("data-") for k in attrs)
        if not (self.says or self.shows or means or tag in STRUCTURAL):
            self.nodes = []
        elif attrs or tag not in ("div", "span"):
            kept = Element(tag, attrs)
            kept.children = self.nodes
            self.nodes = [kept]


def kept_nodes(doc: Element) -> list[Element | str]:
    """The nodes that a model may need, in one walk that ends with each element's last child.

    Ratings that are written as a class become an attribute and, in elements without
    text, text; only listed attributes stay; elements that say, show and mean nothing
    go, and bare containers give way to what they hold.
    """
    open_ones = [_Kept(doc)]
    while True:
        top = open_ones[-1]
        child = next(top.todo, None)
        if child is None:
            if len(open_ones) == 1:
                return top.nodes
            open_ones.pop().close()
            open_ones[-1].take(top.nodes, top.says, top.shows)
        elif isinstance(child, str):
            top.take([child], bool(child.strip()), False)
        elif child.tag == "!--":
            top.take([child], False, False)
        elif not DROPPED.matches(child):
            open_ones.append(_Kept(child))


def prune(html: str, max_chars: int = MAX_CHARS) -> str:
    """The page without what a model doesn't need, cut off at a length."""
    page = Element("#document")
    page.children = kept_nodes(parse(html))
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r">\s+<", "><", re.sub(r"\s{2,}", " ", page.inner_html()))).strip()
    return out if len(out) <= max_chars else out[:max_chars] + "\n<!-- truncated -->"


def _value(e: Element, spec: dict) -> str | float | None:
    raw = e.attrs.get(spec["attr"]) if spec.get("attr") else collapse(e.text())
    if raw is None:
        return None
    if spec.get("regex"):
        m = re.search(spec["regex"], raw)
        if not m:
            return None
        raw = m[1] if m.groups() else m[0]
    if spec.get("type") == "number":
        try:
            return float(re.sub(r"[^0-9.\-]", "", raw))
        except ValueError:
            return None
    return raw or None


def records(html: str, spec: dict) -> list[dict]:
    """Records by a declared spec: {"item": selector or absent, "fields": {name: {"selector",
    "attr", "regex", "type"}}}.  With an item selector each hit is a record, without one
    the page is; a field is the first hit's value, null without one.  No code is run.
    With "bare_references": false, references count only with their semicolon."""
    doc = parse(html, bare_references=spec.get("bare_references", True))
    roots = Selector(spec["item"]).all(doc) if spec.get("item") else [doc]
    fields = {name: (Selector(f["selector"]), f) for name, f in spec["fields"].items()}
    out = []
    for root in roots:
        row = {}
        for name, (selector, f) in fields.items():
            hit = selector.first(root)
            row[name] = _value(hit, f) if hit is not None else None
        out.append(row)
    return out


def spec_from_example(html: str, example: dict) -> dict:
    """A spec that finds an example's texts: each field's selector is that of the
    innermost first element that holds the text's first sixty characters."""
    doc = parse(html)
    fields = {}
    for name, value in example.items():
        if not isinstance(value, str) or not value:
            continue
        hits = [e for e in doc.elements() if value[:60] in e.text()]
        if hits:
            e = hits[0]
            while (inner := next((c for c in e.children if isinstance(c, Element) and value[:60] in c.text()), None)) is not None:
                e = inner
            fields[name] = {"selector": e.tag + "".join(f".{c}" for c in e.classes if re.fullmatch(r"[\w-]+", c))}
    return {"fields": fields}
