"""PDF: layout rules over lines of text, fed by an optional library.

``layout`` turns lines with boxes and sizes into headings and paragraphs and needs no library; ``parse_pdf``
reads the lines with pdfplumber where that is installed. A page on which a second engine (pypdfium2, where installed)
sees more characters, or whose text is garbled, is read again from that engine's glyphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby
from statistics import median
from typing import Any

from .model import Block, Part, ParseError, clean, markdown

HEADING, TITLE, LONGEST_HEADING, GAP = 1.25, 1.6, 60, 0.9


@dataclass
class TextLine:
    text: str
    top: float
    bottom: float
    size: float = 0.0


@dataclass
class Glyph:
    """A character as an engine reports it; ``top`` counts from the upper edge of the page."""

    text: str
    x0: float = 0.0
    top: float = 0.0
    x1: float = 0.0
    bottom: float = 0.0
    size: float = 0.0

    @property
    def visible(self) -> bool:
        return self.text.isprintable() and not self.text.isspace() and self.text not in ("", "\ufffe")

    def within(self, box: tuple[float, float, float, float]) -> bool:
        x, y = (self.x0 + self.x1) / 2, (self.top + self.bottom) / 2
        return box[0] <= x <= box[2] and box[1] <= y <= box[3]


def lines_of_glyphs(glyphs: Iterable[Glyph], tables: list[tuple[float, float, float, float]]) -> list[TextLine]:
    """Lines in reading order. Line feeds, and glyphs that lie in a table, part one line from the next."""
    parts = lambda g: g.text in ("", "\r", "\n") or (not g.text.isspace() and any(g.within(box) for box in tables))
    placed = []
    for parting, run in groupby(glyphs, key=parts):
        members = [] if parting else list(run)
        ink = [g for g in members if not g.text.isspace()]
        if ink:
            line = TextLine("".join(g.text for g in members).strip(), min(g.top for g in ink), max(g.bottom for g in ink), median(g.size for g in ink))
            placed.append(((round(line.top / 3), min(g.x0 for g in ink)), line))  # a third of a line's height counts as level
    return [line for _, line in sorted(placed, key=lambda x: x[0])]


def garbled(text: str) -> bool:
    """The Python twin of ``functions.text.looks_garbled``."""
    return text.count("(cid:") >= 3 or len(re.findall("[\ufffd\ue000-\uf8ff]", text)) > 0.05 * max(len(text), 1)


class SecondEngine:
    """Glyphs of pages by pypdfium2; no page has any where the library is missing or cannot open the file."""

    def __init__(self, data: bytes) -> None:
        try:
            import pypdfium2
            from pypdfium2 import raw

            self.pages, self.raw = pypdfium2.PdfDocument(data), raw
        except Exception:  # noqa: BLE001 - an optional second opinion
            self.pages = None

    def glyphs(self, number: int, height: float) -> list[Glyph]:
        if self.pages is None:
            return []
        try:
            text = self.pages[number - 1].get_textpage()
            boxes = ((text.get_text_range(k, 1), text.get_charbox(k), self.raw.FPDFText_GetFontSize(text.raw, k)) for k in range(text.count_chars()))
            return [Glyph(c, left, height - top, right, height - bottom, size) for c, (left, bottom, right, top), size in boxes]
        except Exception:  # noqa: BLE001
            return []


def second_reading(first: list[Block], shown: int, glyphs: list[Glyph], tables: list[tuple[float, list[list[str | None]]]], boxes: list[tuple[float, float, float, float]], images: int, page: int) -> list[Block] | None:
    """Blocks of the page from a second engine's glyphs, where these are to be preferred: the engine sees more than the
    ``shown`` characters of the first, or the first reading's prose is garbled and the second's is not."""
    again = page_blocks(lines_of_glyphs(glyphs, boxes), tables, images, page)
    prose = lambda blocks: " ".join(b.text for b in blocks if b.kind not in ("table", "image"))
    if sum(g.visible for g in glyphs) > shown:
        return again
    return again if garbled(prose(first)) and prose(again) and not garbled(prose(again)) else None


def layout(lines: list[TextLine], page: int) -> list[tuple[float, Block]]:
    """(top, block): a line much larger than the body is a heading, a wide gap ends a paragraph."""
    lines = [x for x in lines if clean(x.text)]
    body = median([x.size for x in lines if x.size] or [0])
    height = median([x.bottom - x.top for x in lines if x.bottom > x.top] or [10])
    out: list[tuple[float, Block]] = []
    held: list[TextLine] = []

    def close() -> None:
        if held:
            out.append((held[0].top, Block(clean("\n".join(x.text for x in held)), page=page)))
            held.clear()

    for x in lines:
        if body and x.size >= HEADING * body and len(clean(x.text)) <= LONGEST_HEADING:
            close()
            out.append((x.top, Block(clean(x.text), "heading", 1 if x.size >= TITLE * body else 2, page)))
            continue
        if held and x.top - held[-1].bottom > GAP * height:
            close()
        held.append(x)
    close()
    return out


def join_wrapped(text: str | None) -> str | None:
    """The Python twin of ``functions.text.join_wrapped_cell``."""
    if text is None:
        return None
    out = ""
    for line in filter(None, map(str.strip, re.split(r"\r\n|\r|\n", text))):
        word_goes_on = out and "가" <= out[-1] <= "힣" and re.fullmatch(r"[가-힣]{1,2}[.,)]?", line)
        out += line if word_goes_on or not out else " " + line
    return out


def page_blocks(lines: list[TextLine], tables: list[tuple[float, list[list[str | None]]]], images: int, page: int) -> list[Block]:
    """Blocks of a page by their place; ``tables`` are (top, rows)."""
    items = layout(lines, page)
    items += [(top, Block(t, "table", page=page)) for top, rows in tables if (t := markdown([[join_wrapped(c) for c in r] for r in rows]))]
    blocks = [b for _, b in sorted(items, key=lambda x: x[0])]
    return blocks + ([Block(f"[이미지 {images}개 포함]", "image", page=page)] if images else [])


def pdf_date(value: Any) -> str:
    """``D:YYYYMMDD...`` as YYYY-MM-DD."""
    found = re.search(r"(\d{4})(\d{2})(\d{2})", str(value or ""))
    return "-".join(found.groups()) if found else ""


def parse_pdf(name: str, data: bytes) -> Part:
    try:
        import pdfplumber
    except ImportError as e:
        raise ParseError("PDF needs the optional library pdfplumber") from e
    import io

    part, empty, other = Part(name, "pdf"), [], SecondEngine(data)
    try:
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            info = pdf.metadata or {}
            part.metadata = {"title": clean(str(info.get("Title") or "")), "author": clean(str(info.get("Author") or "")), "created_at": pdf_date(info.get("CreationDate")), "page_count": len(pdf.pages)}
            for number, page in enumerate(pdf.pages, 1):
                tables = [t for t in page.find_tables() if t.bbox]
                inside = lambda o, ts=tables: any(t.bbox[0] - 1 <= o["x0"] <= t.bbox[2] + 1 and t.bbox[1] - 1 <= o["top"] <= t.bbox[3] + 1 for t in ts)
                text = page.filter(lambda o: o.get("object_type") != "char" or not inside(o)) if tables else page
                lines = [TextLine(x["text"], x["top"], x["bottom"], median([c["size"] for c in x["chars"]] or [0])) for x in text.extract_text_lines(layout=False, strip=True, return_chars=True)]
                rows, images = [(t.bbox[1], t.extract()) for t in tables], len(page.images or [])
                blocks = page_blocks(lines, rows, images, number)
                if glyphs := other.glyphs(number, float(page.height)):
                    shown = sum(1 for c in page.chars if (c.get("text") or "").strip())
                    if again := second_reading(blocks, shown, glyphs, rows, [t.bbox for t in tables], images, number):
                        blocks, part.metadata["text_engine"] = again, "pdfplumber+pdfium"
                if all(b.kind == "image" for b in blocks):
                    empty.append(number)
                part.blocks += blocks
    except ParseError:
        raise
    except Exception as e:
        raise ParseError("the PDF is protected by a password" if re.search("password|encrypt", str(e), re.I) else f"the PDF could not be read: {e}") from e
    if empty:
        part.warnings.append("pages without text, perhaps scanned: " + ", ".join(map(str, empty[:10])) + (" …" if len(empty) > 10 else ""))
    return part
