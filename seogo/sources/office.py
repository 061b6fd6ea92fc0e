"""Word, PowerPoint and Excel files, read straight from their XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .model import Block, Part, ParseError, clean, markdown, style_level
from .plain import table_blocks

MOST_ROWS = 5000


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(node: ET.Element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def child(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        node = next((c for c in node if local(c.tag) == name), None) if node is not None else None
    return node


class Package:
    """A zip of XML parts with relations."""

    def __init__(self, data: bytes, label: str) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError(f"{label}: not a valid file of this format") from e
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:  # no entity tricks
            raise ParseError(f"{name}: document types are not accepted")
        try:
            return ET.fromstring(raw)
        except ET.ParseError as e:
            raise ParseError(f"{name}: {e}") from e

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target) of a part."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
        return out

    def properties(self) -> dict[str, str]:
        root = self.xml("docProps/core.xml")
        found = {local(n.tag): (n.text or "").strip() for n in root} if root is not None else {}
        return {"title": clean(found.get("title")), "author": clean(found.get("creator")), "created_at": found.get("created", "")[:10], "modified_at": found.get("modified", "")[:10]}


def _run_text(node: ET.Element) -> str:
    """Text of a Word or drawing paragraph with its tabs and breaks."""
    out = []
    for n in node.iter():
        tag = local(n.tag)
        if tag == "t":
            out.append(n.text or "")
        elif tag == "tab" and local(node.tag) == "p" and n.get("pos") is None and attr(n, "pos") is None:
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(name: str, data: bytes) -> Part:
    package = Package(data, "Word")
    root = package.xml("word/document.xml")
    body = child(root, "body")
    if body is None:
        raise ParseError("Word: no document body (save old .doc files as .docx)")
    styles: dict[str, str] = {}
    sheet = package.xml("word/styles.xml")
    for s in sheet if sheet is not None else ():
        if local(s.tag) == "style" and (label := child(s, "name")) is not None:
            styles[attr(s, "styleId") or ""] = attr(label, "val") or ""
    part = Part(name, "docx", metadata=package.properties())
    for item in body:
        if local(item.tag) == "p":
            if block := _word_paragraph(item, styles):
                part.blocks.append(block)
        elif local(item.tag) == "tbl" and (table := markdown(_word_rows(item))):
            part.blocks.append(Block(table, "table"))
    return part


def _word_paragraph(p: ET.Element, styles: dict[str, str]) -> Block | None:
    text = clean(_run_text(p))
    if not text:
        return None
    props = child(p, "pPr")
    named = child(props, "pStyle")
    style = styles.get(attr(named, "val") or "", attr(named, "val") or "") if named is not None else ""
    level = style_level(style)
    if level and len(text) <= 150:
        return Block(text, "heading", level)
    if "list" in style.lower() or child(props, "numPr") is not None:
        return Block(f"- {text}", "list")
    return Block(text)


def _word_rows(table: ET.Element) -> list[list[str]]:
    """Cells of each row; a merged cell keeps its text at its first place and is blank after it."""
    rows = []
    for tr in (r for r in table if local(r.tag) == "tr"):
        cells: list[str] = []
        for tc in (c for c in tr if local(c.tag) == "tc"):
            props = child(tc, "tcPr")
            span, merged = child(props, "gridSpan"), child(props, "vMerge")
            text = "\n".join(_run_text(p) for p in tc if local(p.tag) == "p")
            goes_on = merged is not None and (attr(merged, "val") or "continue") != "restart"
            cells += ["" if goes_on else text] + [""] * (int(attr(span, "val") or 1) - 1 if span is not None else 0)
        rows.append(cells)
    return rows


def parse_pptx(name: str, data: bytes) -> Part:
    package = Package(data, "PowerPoint")
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise ParseError("PowerPoint: no slides (save old .ppt files as .pptx)")
    relations = package.relations("ppt/presentation.xml")
    listed = child(deck, "sldIdLst")
    slides = [relations[i][1] for s in (listed if listed is not None else ()) if (i := _relation_id(s)) in relations]
    meta = package.properties()
    part = Part(name, "pptx", metadata={"title": meta["title"], "author": meta["author"], "page_count": len(slides)})
    for number, slide in enumerate(slides, 1):
        part.blocks += _slide(package, slide, number)
    return part


def _relation_id(node: ET.Element) -> str:
    return next((v for k, v in node.attrib.items() if "relationships" in k and local(k) == "id"), "")


def _shapes(tree: ET.Element) -> Iterator[ET.Element]:
    for s in tree:
        tag = local(s.tag)
        if tag == "grpSp":
            yield from _shapes(s)
        elif tag in ("sp", "graphicFrame", "pic"):
            yield s


def _place(shape: ET.Element) -> str | None:
    holder = child(shape, "nvSpPr", "nvPr", "ph")
    return None if holder is None else holder.get("type", "body")


def _paragraphs_of(shape: ET.Element) -> list[ET.Element]:
    body = child(shape, "txBody")
    return [p for p in (body if body is not None else ()) if local(p.tag) == "p"]


def _slide(package: Package, path: str, page: int) -> list[Block]:
    root = package.xml(path)
    tree = child(root, "cSld", "spTree")
    out: list[Block] = []
    shapes = list(_shapes(tree)) if tree is not None else []
    title = next((s for s in shapes if _place(s) in ("title", "ctrTitle")), None)
    if title is not None and (text := clean("\n".join(map(_run_text, _paragraphs_of(title))))):
        out.append(Block(text, "heading", 2, page))
    pictures = 0
    for s in shapes:
        if s is title:
            continue
        kind = local(s.tag)
        if kind == "pic":
            pictures += 1
        elif kind == "graphicFrame":
            table = next((n for n in s.iter() if local(n.tag) == "tbl"), None)
            rows = [["\n".join(_run_text(p) for p in tc.iter() if local(p.tag) == "p") for tc in tr if local(tc.tag) == "tc"] for tr in (table if table is not None else ()) if local(tr.tag) == "tr"]
            if text := markdown(rows):
                out.append(Block(text, "table", page=page))
        else:
            paragraphs = _paragraphs_of(s)
            lines = []
            for p in paragraphs:
                props = child(p, "pPr")
                level = int(props.get("lvl", "0")) if props is not None else 0
                if text := clean(_run_text(p)):
                    lines.append("  " * level + ("- " if level or len(paragraphs) > 1 else "") + text)
            if lines:
                out.append(Block("\n".join(lines), page=page))
    if pictures:
        out.append(Block(f"[이미지 {pictures}개 포함]", "image", page=page))
    for kind, target in package.relations(path).values():
        if kind == "notesSlide" and (notes := package.xml(target)) is not None:
            inside = child(notes, "cSld", "spTree")
            for s in _shapes(inside) if inside is not None else ():
                if _place(s) == "body" and (text := clean("\n".join(map(_run_text, _paragraphs_of(s))))):
                    out.append(Block(f"발표자 노트: {text}", page=page))
    return out


def parse_xlsx(name: str, data: bytes) -> Part:
    package = Package(data, "Excel")
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ParseError("Excel: no workbook (save old .xls files as .xlsx)")
    relations = package.relations("xl/workbook.xml")
    shared_xml = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in (shared_xml if shared_xml is not None else ())]
    dates = _date_styles(package)
    part = Part(name, "xlsx")
    sheets = child(book, "sheets")
    for number, s in enumerate(sheets if sheets is not None else (), 1):
        title, target = s.get("name", ""), relations.get(_relation_id(s), ("", ""))[1]
        root = package.xml(target)
        rows, cut = _sheet_rows(root, shared, dates) if root is not None else ([], False)
        if not rows:
            continue
        meta = {"sheet": title}
        part.blocks.append(Block(f"시트: {title}", "heading", 2, number, meta))
        part.blocks += table_blocks(rows[0], rows[1:], number, meta)
        if cut:
            part.warnings.append(f"sheet {title}: rows beyond {MOST_ROWS} left out")
    return part


def _date_styles(package: Package) -> set[int]:
    """Cell styles that show a date."""
    root = package.xml("xl/styles.xml")
    if root is None:
        return set()
    custom = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in root.iter() if local(n.tag) == "numFmt"}
    formats = child(root, "cellXfs")
    is_date = lambda i: 14 <= i <= 22 or 45 <= i <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(i, "")).lower()))
    return {k for k, x in enumerate(formats if formats is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _value(cell: ET.Element, shared: list[str], dates: set[int]) -> str:
    kind, raw = cell.get("t", "n"), child(cell, "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if local(t.tag) == "t")
    if raw is None or raw.text is None:
        return ""
    if kind == "s":
        return shared[int(raw.text)]
    if kind == "b":
        return "True" if raw.text == "1" else "False"
    if kind == "n":
        number = float(raw.text)
        if int(cell.get("s", 0)) in dates:
            from datetime import datetime, timedelta

            return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400)))
        return str(int(number)) if number.is_integer() and "." not in raw.text else str(number)
    return raw.text


def _sheet_rows(root: ET.Element, shared: list[str], dates: set[int]) -> tuple[list[list[str]], bool]:
    """Rows with a value among the first ``MOST_ROWS``; whether there are more rows."""
    data = child(root, "sheetData")
    out: list[list[str]] = []
    last = 0
    for row in data if data is not None else ():
        last = int(row.get("r", last + 1))
        if last > MOST_ROWS:
            return out, True
        values: list[str] = []
        for c in row:
            at = _column(c.get("r", "")) or len(values) + 1
            values += [""] * (at - 1 - len(values)) + [_value(c, shared, dates)]
        if any(v.strip() for v in values):
            out.append(values)
    return out, False
