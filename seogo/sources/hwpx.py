"""HWPX: a zip of OWPML sections."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .model import Block, Part, ParseError, clean, decode, markdown, style_level
from .office import Package, child, local

MOST_XML, MOST_PREVIEW, LONGEST_HEADING = 64 * 1024 * 1024, 4 * 1024 * 1024, 120
# Elements without body text.
SKIPPED = frozenset("secPr colPr header footer pageNum pageHiding linesegarray parameters".split())
_INLINE = {"tab": "\t", "lineBreak": "\n", "fwSpace": " ", "nbSpace": " ", "hyphen": "-"}
_META = {"creator": "author", "lastsaveby": "last_modified_by", "CreatedDate": "created_at", "ModifiedDate": "modified_at"}


class _Book:
    def __init__(self, data: bytes) -> None:
        self.package = Package(data, "HWPX")
        if not any(n.startswith("Contents/") for n in self.package.names):
            raise ParseError("HWPX: no Contents folder")
        self.metadata: dict[str, str] = {}

    def xml(self, name: str) -> ET.Element | None:
        """A part; null if it is missing or malformed (the preview then stands in)."""
        if name in self.package.names and self.package.zip.getinfo(name).file_size > MOST_XML:
            raise ParseError(f"HWPX: {name} is too large")
        try:
            return self.package.xml(name)
        except ParseError:
            return None

    def levels(self) -> dict[str, int]:
        root = self.xml("Contents/header.xml")
        named = ((s.get("id", ""), style_level(s.get("name")) or style_level(s.get("engName"))) for s in (root.iter() if root is not None else ()) if local(s.tag) == "style")
        return {k: v for k, v in named if v}

    def sections(self) -> list[str]:
        """Paths in reading order: by the spine, else by number."""
        root = self.xml("Contents/content.hpf")
        hrefs, spine = {}, []
        for n in root.iter() if root is not None else ():
            tag, text = local(n.tag), (n.text or "").strip()
            if tag == "item":
                hrefs[n.get("id")] = n.get("href", "")
            elif tag == "itemref":
                spine.append(n.get("idref"))
            elif tag == "title" and text:
                self.metadata.setdefault("title", clean(text))
            elif tag == "meta" and text and (key := _META.get(n.get("name", ""))):
                self.metadata.setdefault(key, text[:10] if key.endswith("_at") else clean(text))
        names = self.package.names
        found = []
        for ref in spine:
            href = hrefs.get(ref, "").lstrip("/")
            if "section" in href.lower():
                found += [p for p in (href, posixpath.join("Contents", href)) if p in names][:1]
        return found or sorted((n for n in names if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _runs(p: ET.Element) -> Iterator[str | ET.Element]:
    """Text, and nested tables and paragraphs, of a paragraph in order."""
    for n in p:
        tag = local(n.tag)
        if tag in SKIPPED:
            continue
        if tag == "t":
            yield (n.text or "") + "".join(_INLINE.get(local(c.tag), "") + (c.tail or "") for c in n)
        elif tag in ("tbl", "p"):
            yield n
        else:
            yield from _runs(n)


def _blocks(p: ET.Element, levels: dict[str, int]) -> list[Block]:
    out: list[Block] = []
    held: list[str] = []
    level = levels.get(p.get("styleIDRef", ""), 0)

    def close() -> None:
        if text := clean("".join(held)):
            out.append(Block(text, "heading", level) if level and len(text) <= LONGEST_HEADING else Block(text))
        held.clear()

    for run in _runs(p):
        if isinstance(run, str):
            held.append(run)
            continue
        close()
        if local(run.tag) == "p":
            out += _blocks(run, levels)
        elif table := markdown([_cells(tr, levels) for tr in run if local(tr.tag) == "tr"]):
            out.append(Block(table, "table"))
    close()
    return out


def _cells(row: ET.Element, levels: dict[str, int]) -> list[str]:
    out: list[str] = []
    for tc in (c for c in row if local(c.tag) == "tc"):
        inside = next((n for n in tc.iter() if local(n.tag) == "subList"), None)
        texts = (b.text.replace("\n", " ") for p in (inside if inside is not None else ()) if local(p.tag) == "p" for b in _blocks(p, levels))
        span = child(tc, "cellSpan")
        wide = span.get("colSpan", "1") if span is not None else "1"
        out += [" ".join(filter(None, texts))] + [""] * ((int(wide) if wide.isdigit() else 1) - 1)
    return out


def parse_hwpx(name: str, data: bytes) -> Part:
    book = _Book(data)
    levels, sections = book.levels(), book.sections()
    roots = filter(lambda r: r is not None, map(book.xml, sections))
    part = Part(name, "hwpx", [b for r in roots for p in r if local(p.tag) == "p" for b in _blocks(p, levels)], book.metadata)
    if not part.text:
        preview = next((n for n in ("Preview/PrvText.txt", "Preview/PrvText") if n in book.package.names), None)
        text = clean(decode(book.package.zip.read(preview)[:MOST_PREVIEW])) if preview else ""
        if text:
            part.warnings.append("the body could not be read; the stored preview stands in for it")
            part.blocks = [Block(p) for p in text.split("\n\n") if p.strip()]
    return part
