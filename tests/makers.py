"""Small files of every format, made from scratch for the tests."""

import io
import struct
import zipfile
import zlib
from email.message import EmailMessage

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
CORE = '<c xmlns:dc="d" xmlns:t="t"><dc:title>제목 하나</dc:title><dc:creator>담당 가</dc:creator><t:created>2026-01-02T03:04:05Z</t:created></c>'


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def docx() -> bytes:
    def p(text, style="", extra=""):
        props = f'<w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{extra}</w:pPr>'
        return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"

    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    table = "<w:tbl>" + "<w:tr>" + cell("항목") + cell("내용", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("가") + cell("나") + cell("다") + "</w:tr></w:tbl>"
    body = p("회의록", "H1") + p("첫 문단입니다.") + p("할 일", "", '<w:numPr><w:numId w:val="1"/></w:numPr>') + table
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/styles.xml": styles, "docProps/core.xml": CORE})


def pptx() -> bytes:
    def shape(kind, lines):
        ph = f'<p:ph type="{kind}"/>' if kind else ""
        ps = "".join(f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for lvl, t in lines)
        return f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{ps}</p:txBody></p:sp>'

    tree = shape("title", [(0, "계획")]) + "<p:grpSp>" + shape("", [(0, "하나"), (1, "둘")]) + "</p:grpSp><p:pic/><p:pic/>"
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
    notes = f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shape("body", [(0, "말할 것")])}</p:spTree></p:cSld></p:notes>'
    rel = lambda i, kind, target: f'<r><Relationship Id="{i}" Type="x/{kind}" Target="{target}"/></r>'.replace("<r>", '<Relationships>').replace("</r>", "</Relationships>")
    deck = f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>'
    return zipped({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rel("rId1", "slide", "slides/slide1.xml"), "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rel("n", "notesSlide", "../notesSlides/n1.xml"), "ppt/notesSlides/n1.xml": notes, "docProps/core.xml": CORE})


def xlsx(rows: int = 3) -> bytes:
    strings = ["이름", "값", "가", "나"]
    row = lambda n, cells: f'<row r="{n}">{"".join(cells)}</row>'
    body = row(1, ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>']) + "".join(row(n, [f'<c r="A{n}" t="s"><v>2</v></c>', f'<c r="B{n}"><v>{n}</v></c>']) for n in range(2, rows + 2))
    book = f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="계정" r:id="r1"/></sheets></workbook>'
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>',
                   "xl/worksheets/s.xml": f'<worksheet xmlns="{S}"><sheetData>{body}</sheetData></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="{S}">{"".join(f"<si><t>{t}</t></si>" for t in strings)}</sst>'})


def hwpx(broken: bool = False) -> bytes:
    t = lambda text, style="0": f'<hp:p xmlns:hp="h" styleIDRef="{style}"><hp:run><hp:t>{text}</hp:t></hp:run></hp:p>'
    cell = lambda x, span=1: f'<hp:tc><hp:subList>{t(x)}</hp:subList><hp:cellSpan colSpan="{span}"/></hp:tc>'
    table = f'<hp:p xmlns:hp="h"><hp:run><hp:tbl><hp:tr>{cell("구분")}{cell("내용")}</hp:tr><hp:tr>{cell("a")}{cell("b")}</hp:tr></hp:tbl></hp:run></hp:p>'
    section = f'<hs:sec xmlns:hs="s" xmlns:hp="h">{t("절차", "1")}{t("본문<hp:tab/>뒤")}{table}</hs:sec>'
    files = {"Contents/header.xml": '<h><style id="1" name="개요 1"/></h>', "Contents/section0.xml": "<broken" if broken else section,
             "Contents/content.hpf": '<p><title>안내서</title><meta name="creator">작성자</meta><item id="s" href="Contents/section0.xml"/><itemref idref="s"/></p>', "Preview/PrvText.txt": "미리 보기"}
    return zipped(files)


def eml(attach: bool = True) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "요청", "홍길동 <hong@a.example>", "b@b.example, 김 <c@c.example>", "Wed, 30 Sep 2026 10:00:00 +0900"
    m.set_content("안녕하세요.\n\n본문입니다.")
    if attach:
        m.add_attachment("붙임 내용".encode(), maintype="text", subtype="plain", filename="붙임.txt")
        m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="a.exe")
    return m.as_bytes()


def record(tag: int, payload: bytes) -> bytes:
    return struct.pack("<I", tag | min(len(payload), 0xFFF) << 20) + (struct.pack("<I", len(payload)) if len(payload) >= 0xFFF else b"") + payload


def compound(streams: dict) -> bytes:
    """A compound file whose streams are all in full sectors (padded beyond the mini cutoff)."""
    sector, entries, chains, blocks = 512, [], [], []
    folders = {p[0] for p in streams if len(p) == 2}
    names = [("Root Entry", 5)] + [(f, 1) for f in folders] + [(p[-1], 2) for p in streams]
    for data in streams.values():
        padded = data + b"\0" * (max(4096, len(data)) - len(data))
        start = len(blocks)
        parts = [padded[i : i + sector].ljust(sector, b"\0") for i in range(0, len(padded), sector)]
        blocks += parts
        chains.append((start, len(padded), len(parts)))
    fat = []
    for start, _, n in chains:
        fat += [start + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    tops = [1 + i for i, f in enumerate(folders)] + [1 + len(folders) + i for i, p in enumerate(streams) if len(p) == 1]
    right = {a: b for a, b in zip(tops, tops[1:])}
    inner = {}
    for k, f in enumerate(folders):
        ids = [1 + len(folders) + i for i, p in enumerate(streams) if len(p) == 2 and p[0] == f]
        inner[1 + k] = ids[0]
        right |= {a: b for a, b in zip(ids, ids[1:])}
    none = 0xFFFFFFFF
    for i, (name, kind) in enumerate(names):
        raw = name.encode("utf-16-le") + b"\0\0"
        start, length = (0xFFFFFFFE, 0) if kind != 2 else chains[i - 1 - len(folders)][:2]
        below = tops[0] if i == 0 else inner.get(i, none)
        entries.append(raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, none, right.get(i, none), below) + b"\0" * 36 + struct.pack("<IQ", start, length))
    directory = b"".join(entries)
    directory += b"\0" * (-len(directory) % sector)
    first_dir, n_dir = len(blocks), len(directory) // sector
    blocks += [directory[i : i + sector] for i in range(0, len(directory), sector)]
    fat += [first_dir + i + 1 for i in range(n_dir - 1)] + [0xFFFFFFFE]
    n_fat = -(-(len(fat) + 8) // 128)
    where = list(range(len(blocks), len(blocks) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * sector, b"\xff")
    blocks += [table[i : i + sector] for i in range(0, len(table), sector)]
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIII", 0, n_fat, first_dir, 0)
    head += struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", *(where + [none] * (109 - n_fat)))
    return head.ljust(512, b"\0") + b"".join(blocks)


def hwp(flags: int = 1) -> bytes:
    text = struct.pack("<8H", 9, 0, 0, 0, 0, 0, 0, 0) + "본문 문단".encode("utf-16-le") + struct.pack("<H", 13)
    body = record(66, b"\0" * 4) + record(67, text) + record(67, "둘째 문단".encode("utf-16-le"))
    raw = zlib.compressobj(wbits=-15)
    packed = raw.compress(body) + raw.flush()
    header = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000000, flags)
    return compound({("FileHeader",): header, ("BodyText", "Section0"): packed if flags & 1 else body})
