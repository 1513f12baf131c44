"""HTML pages to blocks: the one parser that needs Python.  A block is (kind, text, level, page)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from . import fixed

_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_WHOLE = {"ul", "ol", "pre", "table", "blockquote", "dl"}


class _Element:
    __slots__ = ("tag", "children")

    def __init__(self, tag: str):
        self.tag = tag
        self.children: list = []

    def nodes(self):
        """Everything below this element in document order, without recursion."""
        waiting = self.children[::-1]
        while waiting:
            node = waiting.pop()
            yield node
            if isinstance(node, _Element):
                waiting += node.children[::-1]

    def strings(self):
        return (n for n in self.nodes() if not isinstance(n, _Element))

    def line(self) -> str:
        return " ".join(" ".join(self.strings()).split())

    def all(self, *tags: str) -> list[_Element]:
        return [e for e in self.nodes() if isinstance(e, _Element) and e.tag in tags]


class _TreeBuilder(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("")
        self.open = [self.root]
        self.pending: list[str] = []

    def _flush(self):
        if self.pending:
            self.open[-1].children.append("".join(self.pending))
            self.pending = []

    def handle_data(self, data):
        self.pending.append(data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        element = _Element(tag)
        self.open[-1].children.append(element)
        if tag not in fixed.HTML_VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _without_chrome(root: _Element) -> None:
    for e in (root, *[n for n in root.nodes() if isinstance(n, _Element)]):
        e.children = [c for c in e.children if not (isinstance(c, _Element) and c.tag in fixed.HTML_CHROME)]


def _element_block(e: _Element) -> tuple[str, str, int] | None:
    if e.tag in _HEADINGS:
        return "heading", e.line(), _HEADINGS[e.tag]
    if e.tag in ("p", "blockquote"):
        return "para", e.line(), 0
    if e.tag in ("ul", "ol"):
        items = [item for item in (li.line() for li in e.all("li")) if item]
        return "list", "\n".join("- " + item for item in items), 0
    if e.tag == "pre":
        return "code", "".join(e.strings()), 0
    if e.tag == "table":
        rows = [[cell.line() for cell in tr.all("td", "th")] for tr in e.all("tr")]
        return "table", "\n".join("| " + " | ".join(r) + " |" for r in rows if any(r)), 0
    if e.tag == "dl":
        return "list", "\n".join(x.line() for x in e.all("dt", "dd")), 0
    return None


def _content_blocks(root: _Element):
    """Blocks below ``root``; containers that are one block are not searched again."""
    waiting = root.children[::-1]
    while waiting:
        node = waiting.pop()
        if not isinstance(node, _Element):
            continue
        block = _element_block(node)
        if block is not None and block[1]:
            yield block
        if node.tag not in _WHOLE:
            waiting += node.children[::-1]


def html_blocks(html: str) -> tuple[str, list[tuple]]:
    """(title, blocks) of a page without its navigation and other chrome."""
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    builder._flush()
    root = builder.root
    _without_chrome(root)
    titles = root.all("title")
    title = ""
    if titles and len(titles[0].children) == 1 and isinstance(titles[0].children[0], str):
        title = titles[0].children[0].strip()
    body = next((found[0] for found in (root.all(t) for t in ("main", "article", "body")) if found), root)
    blocks = [(*b, None) for b in _content_blocks(body)]
    if not blocks:
        blocks = plain_blocks("\n".join(body.strings()))
    return title, [b for b in blocks if b[1].strip()]


def plain_blocks(s: str) -> list[tuple]:
    """Paragraphs and lists of unstructured text, without heading detection."""
    out = []
    for para in re.split(r"\n\s*\n", s):
        lines = [ln.strip() for ln in para.splitlines() if ln.strip()]
        if lines and all(re.match(fixed.LIST_LINE, ln) for ln in lines):
            out.append(("list", "\n".join(lines), 0, None))
        elif lines:
            out.append(("para", re.sub(r"(\w)- (\w)", r"\1\2", " ".join(lines)), 0, None))
    return out
