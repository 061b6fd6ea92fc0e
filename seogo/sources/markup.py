"""HTML to blocks, on the event parser of the standard library.

One pass keeps a small tree of the elements that matter (tables, list items, headings, code); everything
else is transparent. Unclosed paragraphs and items end where browsers end them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .model import Block, Part, clean, decode, markdown

# Elements without text of their own, page furniture, and elements that end a paragraph.
DROPPED = frozenset("script style noscript iframe svg canvas template head button select option ac:parameter ri:attachment ac:placeholder".split())
FURNITURE = frozenset("nav header footer aside".split())
BREAKING = frozenset("p div section article main header footer aside nav ul ol dl dt dd blockquote figure figcaption form fieldset address hr tbody thead center ac:rich-text-body ac:layout ac:layout-section ac:layout-cell ac:structured-macro".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.items = tag, attrs, []

    def text(self, between: str = "") -> str:
        return between.join(i if isinstance(i, str) else i.text(between) for i in self.items)

    def find(self, tag: str):  # noqa: ANN201
        for i in self.items:
            if isinstance(i, Node):
                if i.tag == tag:
                    yield i
                yield from i.find(tag)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            at = self.open[k].tag
            if at in _CLOSES.get(tag, ()) or (at == "p" and tag in BREAKING | {"table", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}):
                del self.open[k:]
                if tag != "tr":
                    break
            elif at in _SCOPE.get(tag, ()) or at in ("table", "td", "th", "li", "div", "body"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].items.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].items.append(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.open[-1].items.append(data[6:])


def _tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


class _Blocks:
    def __init__(self, dropped: frozenset[str]) -> None:
        self.dropped, self.out, self.held = dropped, [], []

    def close(self) -> None:
        if text := clean("".join(self.held)):
            self.out.append(Block(text))
        self.held = []

    def add(self, text: str, kind: str, level: int = 0) -> None:
        self.close()
        if text:
            self.out.append(Block(text, kind, level))

    def visit(self, node: Node, depth: int = 0) -> None:
        for item in node.items:
            if isinstance(item, str):
                self.held.append(item)
                continue
            tag = item.tag
            if tag in self.dropped:
                continue
            if re.fullmatch("h[1-6]", tag):
                self.add(clean(self.inline(item)), "heading", int(tag[1]))
            elif tag == "table":
                self.add(self.table(item), "table")
            elif tag in ("pre", "ac:plain-text-body"):
                code = self.inline(item, "")
                self.add(code.strip("\n") if code.strip() else "", "code")
            elif tag == "li":
                lists = [i for i in item.items if isinstance(i, Node) and i.tag in ("ul", "ol")]
                own = " ".join(i if isinstance(i, str) else self.inline(i) for i in item.items if i not in lists and not (isinstance(i, Node) and i.tag in self.dropped))
                text = clean(own)
                self.add(f"{'  ' * depth}- {text}" if text else "", "list")
                for inner in lists:
                    self.visit(inner, depth + 1)
            elif tag == "br":
                self.held.append("\n")
            elif tag == "img":
                if alt := clean(item.attrs.get("alt")):
                    self.held.append(f"[이미지: {alt}]")
            elif tag in BREAKING:
                self.close()
                self.visit(item, depth)
                self.close()
            else:
                self.visit(item, depth)

    def inline(self, node: Node, between: str = " ") -> str:
        parts = (i if isinstance(i, str) else self.inline(i, between) for i in node.items if isinstance(i, str) or i.tag not in self.dropped)
        return between.join(parts)

    def rows(self, node: Node):  # noqa: ANN201
        for i in node.items:
            if isinstance(i, Node) and i.tag != "table":
                if i.tag == "tr":
                    yield i
                else:
                    yield from self.rows(i)

    def table(self, node: Node) -> str:
        grid = []
        for row in self.rows(node):
            cells: list[str] = []
            for c in row.items:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    span = c.attrs.get("colspan", "1").strip()
                    cells += [self.inline(c)] + [""] * (max(int(span), 1) - 1 if span.isdigit() else 0)
            grid.append(cells)
        return markdown(grid)


def html_blocks(html: str, drop_furniture: bool = False) -> list[Block]:
    """Headings, paragraphs, list items, tables and code of a page, in order."""
    root = _tree(html)
    walker = _Blocks(DROPPED | FURNITURE if drop_furniture else DROPPED)
    walker.visit(next(root.find("body"), root))
    walker.close()
    return walker.out


def title_of(html: str) -> str:
    """og:title, else title, else the first h1."""
    root = _tree(html)
    for meta in root.find("meta"):
        if meta.attrs.get("property") == "og:title" and meta.attrs.get("content"):
            return clean(meta.attrs["content"])
    for tag in ("title", "h1"):
        for node in root.find(tag):
            if text := clean(node.text(" ")):
                return text
            break
    return ""


def parse_html(name: str, data: bytes) -> Part:
    html = decode(data)
    return Part(name, "html", html_blocks(html), {"title": title_of(html)})
