"""HTML to Markdown: ATX headings, fenced code, ``*`` bullets and inline links."""

from __future__ import annotations

import re

from .dom import BLOCK, Element, collapse, parse

_CLEAN = (
    (re.compile(r"!\[\]\(data:image[^)]{0,200}\)"), ""), (re.compile(r"\[([^\]]*)\]\(javascript:[^)]*\)"), r"\1"),
    (re.compile(r"^[\s;]+$", re.M), ""), (re.compile(r"\n{3,}"), "\n\n"),
)
_SPECIAL = re.compile(r"([\\`*_\[\]])")


def clean_markdown(text: str) -> str:
    for pattern, to in _CLEAN:
        text = pattern.sub(to, text)
    return text.strip()


def to_markdown(html: str) -> str:
    out = _blocks(parse(html), 0)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _inline(node: Element | str) -> str:
    if isinstance(node, str):
        return _SPECIAL.sub(r"\\\1", re.sub(r"\s+", " ", node))
    tag, a = node.tag, node.attrs
    if tag in ("script", "style", "!--", "head", "title", "noscript", "template"):
        return ""
    if tag == "br":
        return "  \n"
    if tag == "img":
        src, alt = a.get("src", ""), a.get("alt", "")
        return "" if not src or (src.startswith("data:image") and len(src) < 200) else f"![{alt}]({src})"
    if tag == "code":
        return f"`{node.text()}`" if node.text() else ""
    inner = "".join(map(_inline, node.children))
    bare = inner.strip()
    if not bare:
        return inner[:1] if inner[:1].isspace() else ""
    before, after = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if tag in ("em", "i"):
        return f"{before}_{bare}_{after}"
    if tag in ("strong", "b"):
        return f"{before}**{bare}**{after}"
    if tag == "a" and a.get("href"):
        return f"{before}[{bare}]({a['href']}{' ' + chr(34) + a['title'] + chr(34) if a.get('title') else ''}){after}"
    return inner


def _is_block(node: Element | str) -> bool:
    return isinstance(node, Element) and (node.tag in BLOCK or node.tag == "#document")


def _has_block(e: Element, depth: int = 0) -> bool:
    return any(_is_block(x) for x in e.elements())


def _blocks(e: Element, depth: int) -> str:
    """Block children parted by blank lines; runs of inline ones are paragraphs."""
    if depth > 200:  # deeper pages are broken ones: their text is enough
        return collapse(e.text())
    parts: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(run)).replace("  \n", "\n")).strip()
        if text:
            parts.append(text)
        run.clear()

    for c in e.children:
        if _is_block(c):
            close()
            block = _block(c, depth + 1)
            if block.strip():
                parts.append(block.strip("\n"))
        elif isinstance(c, Element) and c.tag not in ("!--", "a", "code") and _has_block(c):
            close()
            parts.append(_blocks(c, depth + 1))
        else:
            run.append(_inline(c))
    close()
    return "\n\n".join(p for p in parts if p)


def _block(e: Element, depth: int) -> str:
    tag = e.tag
    if tag in ("title",):
        return ""
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        text = collapse("".join(map(_inline, e.children)))
        return f"{'#' * int(tag[1])} {text}" if text else ""
    if tag == "hr":
        return "* * *"
    if tag == "pre":
        code = next((c for c in e.children if isinstance(c, Element) and c.tag == "code"), None)
        lang = re.search(r"language-(\S+)", code.attrs.get("class", "")) if code is not None else None
        text = e.text().strip("\n")
        return f"```{lang[1] if lang else ''}\n{text}\n```"
    if tag == "blockquote":
        return "\n".join(f"> {line}".rstrip() for line in _blocks(e, depth).split("\n"))
    if tag in ("ul", "ol", "menu"):
        rows = []
        number = int(e.attrs["start"]) if e.attrs.get("start", "").isdigit() else 1
        for c in e.children:
            if isinstance(c, Element) and c.tag == "li":
                mark = f"{number}.  " if tag == "ol" else "*   "
                rows.append(mark + _blocks(c, depth).replace("\n\n", "\n").replace("\n", "\n    "))
                number += 1
        return "\n".join(rows)
    if tag == "table":
        rows = [[collapse("".join(map(_inline, c.children))) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.elements() if r.tag == "tr"]
        return "\n\n".join(" ".join(x for x in r if x) for r in rows if any(r))
    return _blocks(e, depth)
