import io
import zipfile

import makers
import pytest
from pyspark.sql import functions as F

from seogo.sources import links as L
from seogo.sources.files import read_files, text_parts
from seogo.sources.hwp import paragraph, records
from seogo.sources.image import set_image_reader
from seogo.sources.markup import html_blocks, title_of
from seogo.sources.model import ParseError, clean, decode, markdown
from seogo.sources.pdf import Glyph, SecondEngine, TextLine, garbled, join_wrapped, lines_of_glyphs, page_blocks, pdf_date, second_reading
from seogo.sources.plain import text_blocks
from seogo.sources.registry import LABELS, parse, supported_extensions
from seogo.settings import Settings


def kinds(part):
    return [(b.kind, b.level, b.text) for b in part.blocks]


def test_decoding_and_tables():
    assert decode("한글".encode("cp949")) == decode(b"\xef\xbb\xbf" + "한글".encode()) == decode("한글".encode("utf-16")) == "한글"
    assert markdown([["a", None, "b|c"], ["1", None, "2\n3"]]) == "| a | b\\|c |\n|---|---|\n| 1 | 2 3 |"
    assert markdown([["x", "", "y"]]) == "x | y" and markdown([]) == markdown([["", None]]) == ""
    assert clean(" a\t b \r\n\r\n\r\n\r\nc​ ") == "a b\n\nc" and clean(None) == ""


def test_plain_markdown_csv_code():
    assert kinds(parse("a.txt", b"one\ntwo\n \n\nthree")) == [("paragraph", 0, "one\ntwo"), ("paragraph", 0, "three")]
    md = parse("a.md", "# 제목 #\n글\n```\n# no\n\nx\n```\n## 둘".encode())
    assert kinds(md) == [("heading", 1, "제목"), ("paragraph", 0, "글\n```\n# no\n\nx\n```"), ("heading", 2, "둘")] and md.type == "markdown"
    table = parse("a.csv", b"h1,h2\n" + b"".join(b"%d,x\n" % i for i in range(81)) + b",\n")
    assert [b.text.count("\n") for b in table.blocks] == [41, 41, 2] and parse("a.csv", b"h1,h2\n").blocks[0].text == "h1 | h2"
    assert parse("a.tsv", b"a\tb\n1\t2").blocks[0].text.startswith("| a | b |") and parse("e.csv", b"").blocks == []
    code = parse("a.py", ("x" * 201 + "\n\n  y = 1\n\nz").encode())
    assert [b.text for b in code.blocks] == ["x" * 201, "  y = 1\n\nz"] and code.metadata["language"] == "python"


def test_html():
    page = """<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><h1>제목 <b>굵게</b></h1><p>한 줄<br>둘째<p>다음 문단
      <ul><li>항목 A<ul><li>세부 B</li></ul></li><li>끝</ul><table><tr><th>a<th colspan=2>b<tr><td>1<td>2<td>3<table><tr><td>in</table></table>
      <pre>  code
 x</pre><!-- no --><img alt="그림"><script>bad()</script><ac:structured-macro><ac:parameter>p</ac:parameter><ac:plain-text-body><![CDATA[cd]]></ac:plain-text-body></ac:structured-macro></body></html>"""
    got = [(b.kind, b.text) for b in html_blocks(page, drop_furniture=True)]
    assert got[:3] == [("heading", "제목 굵게"), ("paragraph", "한 줄\n둘째"), ("paragraph", "다음 문단")]
    assert ("list", "- 항목 A") in got and ("list", "  - 세부 B") in got and ("list", "- 끝") in got
    assert any(k == "table" and t.startswith("| a | b |") and "in" not in t.split("\n")[0] for k, t in got)
    assert ("code", "  code\n x") in got and ("code", "cd") in got and ("paragraph", "[이미지: 그림]") in got
    assert not any("menu" in t or "bad" in t or t == "p" for _, t in got) and any(b.text == "menu" for b in html_blocks(page))
    assert title_of(page) == "T" and title_of('<meta property="og:title" content="O">' + page) == "O" and title_of("<h1>H</h1>") == "H" and title_of("") == ""


def test_office():
    d = parse("a.docx", makers.docx())
    assert kinds(d) == [("heading", 1, "회의록"), ("paragraph", 0, "첫 문단입니다."), ("list", 0, "- 할 일"), ("table", 0, "| 항목 | 내용 |  |\n|---|---|---|\n| 가 | 나 | 다 |")]
    assert d.metadata["title"] == "제목 하나" and d.metadata["created_at"] == "2026-01-02"
    p = parse("a.pptx", makers.pptx())
    assert kinds(p) == [("heading", 2, "계획"), ("paragraph", 0, "- 하나\n  - 둘"), ("image", 0, "[이미지 2개 포함]"), ("paragraph", 0, "발표자 노트: 말할 것")] and p.metadata["page_count"] == 1 and p.blocks[0].page == 1
    x = parse("a.xlsx", makers.xlsx(45))
    assert x.blocks[0].text == "시트: 계정" and x.blocks[0].meta == {"sheet": "계정"} and [b.text.count("\n") for b in x.blocks[1:]] == [41, 6]
    long = parse("a.xlsx", makers.xlsx(5003))
    assert long.warnings and long.blocks[-1].text.splitlines()[-1] == "| 가 | 5000 |"
    for name in ("a.docx", "a.pptx", "a.xlsx", "a.hwpx", "a.zip"):
        with pytest.raises(ParseError):
            parse(name, b"not a zip")
    with pytest.raises(ParseError):
        parse("a.docx", makers.zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'}))


def test_hwpx_and_hwp():
    h = parse("a.hwpx", makers.hwpx())
    assert kinds(h) == [("heading", 1, "절차"), ("paragraph", 0, "본문 뒤"), ("table", 0, "| 구분 | 내용 |\n|---|---|\n| a | b |")] and h.metadata == {"title": "안내서", "author": "작성자"}
    b = parse("a.hwpx", makers.hwpx(broken=True))
    assert b.text == "미리 보기" and b.warnings
    for flags in (0, 1):
        assert [x.text for x in parse("a.hwp", makers.hwp(flags)).blocks] == ["본문 문단", "둘째 문단"]
    with pytest.raises(ParseError, match="password"):
        parse("a.hwp", makers.hwp(2))
    with pytest.raises(ParseError):
        parse("a.hwp", b"plain")
    big = makers.record(67, b"a\0" * 3000)
    assert [(t, len(p)) for t, _, p in records(big)] == [(67, 6000)] and paragraph("a\tb".encode("utf-16-le")[:2] + b"\x1e\0") == "a "


def test_mail_and_archive():
    m = parse("a.eml", makers.eml())
    assert m.metadata["sender_name"] == "홍길동" and m.metadata["recipients"] == "b@b.example, 김 <c@c.example>" and m.metadata["sent_at"].startswith("2026-09-30T10:00")
    assert m.blocks[0].kind == "meta" and m.blocks[-1].text == "첨부파일: 붙임.txt, a.exe" and [c.name for c in m.children] == ["붙임.txt"] and m.children[0].metadata["parent_name"] == "요청"
    korean = b"Subject: x\nContent-Type: text/plain; charset=ks_c_5601-1987\nContent-Transfer-Encoding: 8bit\n\n" + "본문 글".encode("cp949")
    assert parse("k.eml", korean).blocks[-1].text == "본문 글"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("app/main.py", "print(1)")
        info = zipfile.ZipInfo("x.md")
        z.writestr(info, "# 설명")
        z.writestr("node_modules/x.js", "1")
        z.writestr("image.png", b"1")
        z.writestr("in.zip", makers.zipped({"a.txt": "a"}))
        z.writestr("mail.eml", makers.eml())
        z.writestr("bad.docx", b"no")
    a = parse("묶음.zip", out.getvalue())
    assert [c.name for c in a.children] == ["app/main.py", "x.md", "mail.eml"] and len(a.warnings) == 2 and a.metadata["file_count"] == 3
    assert a.children[2].children == [] and a.children[0].metadata["path_in_archive"] == "app/main.py"
    rows = a.rows("s")
    assert [(r["part_ordinal"], r["parent_ordinal"], r["depth"]) for r in rows] == [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 0, 1)]
    cp = zipfile.ZipInfo("x")
    cp.filename = "문서.md".encode("cp949").decode("cp437")
    from seogo.sources.archive import entry_name

    assert entry_name(cp) == "문서.md"
    with pytest.raises(ParseError):
        parse("a.exe", b"")
    assert ".hwpx" in supported_extensions() and LABELS["eml"] == "메일"


def test_image_reader_and_pdf_layout():
    with pytest.raises(ParseError):
        parse("a.png", b"1")
    try:
        set_image_reader(lambda data, kind: f"읽음 {kind}")
        assert parse("a.jpg", b"1").text == "읽음 image/jpeg"
        with pytest.raises(ParseError):
            parse("a.jpg", b"1" * (5 * 1024 * 1024 + 1))
        set_image_reader(lambda data, kind: " ")
        assert parse("a.png", b"1").warnings
        set_image_reader(lambda data, kind: 1 / 0)
        with pytest.raises(ParseError):
            parse("a.png", b"1")
    finally:
        set_image_reader(None)
    line = lambda t, top, size=10: TextLine(t, top, top + 10, size)
    got = page_blocks([line("큰 제목", 0, 17), line("작은 제목", 20, 13), line("첫 줄", 40), line("둘째 줄", 52), line("새 문단", 90)], [(70, [["a", "관\n리"], ["1", "2"]])], 1, 3)
    assert [(b.kind, b.level, b.text) for b in got] == [("heading", 1, "큰 제목"), ("heading", 2, "작은 제목"), ("paragraph", 0, "첫 줄\n둘째 줄"), ("table", 0, "| a | 관리 |\n|---|---|\n| 1 | 2 |"), ("paragraph", 0, "새 문단"), ("image", 0, "[이미지 1개 포함]")]
    assert join_wrapped("abc\ndef") == "abc def" and join_wrapped(None) is None and pdf_date("D:20240131120000+09'00'") == "2024-01-31" and pdf_date(None) == ""


def test_reading_files_as_rows(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(makers.eml())
    (tmp_path / "b.txt").write_text("글")
    (tmp_path / "c.exe").write_bytes(b"1")
    (tmp_path / "d.txt").write_bytes(b"1" * (2 * 1024 * 1024))
    rows = read_files(spark, str(tmp_path), most_mb=1).collect()
    assert {(r.source_name, r.part_ordinal, r.error is None) for r in rows} == {("a.eml", 0, True), ("붙임.txt", 1, True), ("b.txt", 0, True), ("c.exe", 0, False), ("d.txt", 0, False)}
    assert read_files(spark, str(tmp_path), pattern="*.md").count() == 0


def test_text_parts_agree_with_the_python_splitter(spark):
    texts = ["a\n \nb\r\n\r\nc", "\n\n", "", None, "한 줄", "x \n\t\ny  z\n\n\n\nw", "a\rb", "끝 \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {int(r.source_id): [b.text for b in r.blocks] for r in text_parts(df, source_id="i", text="t", source_name="n").collect()}
    assert got == {i: [b.text for b in text_blocks(t or "")] for i, t in enumerate(texts)}


class Web:
    """A transport that answers from a table and remembers what it was asked."""

    def __init__(self, pages):
        self.pages, self.seen = pages, []

    def __call__(self, url, headers):
        self.seen.append((url, headers))
        return self.pages.get(url, L.Response(404))


def test_links():
    s = Settings.in_session(confluence_pat="tok", nanumi_cookie="c=1", nanumi_base_url="https://board.corp.example")
    assert L.parse_wiki_url("https://w.atlassian.net/wiki/spaces/DEV/pages/12/x") == L.WikiRef("https://w.atlassian.net/wiki", "12", "DEV")
    assert L.parse_wiki_url("https://w.example/pages/viewpage.action?pageId=7").page_id == "7"
    assert L.parse_wiki_url("https://w.example/display/OPS/a+b%20c") == L.WikiRef("https://w.example", None, "OPS", "a b c")
    kind = lambda u: L.detect_link_type(u, s)
    assert [kind(u) for u in ("https://board.corp.example/1", "https://x.atlassian.net/a", "https://h/display/A/b", "https://nanumi.x/1", "https://h/a")] == ["nanumi", "confluence", "confluence", "nanumi", "web"]
    body = b'{"id": "12", "title": "P", "space": {"name": "S"}, "body": {"view": {"value": "<p>hi</p>"}}, "version": {"when": "2026-01-02T00"}, "ancestors": [{"title": "R"}]}'
    web = Web({f"https://w.atlassian.net/wiki/rest/api/content/12?expand={L._EXPAND}": L.Response(200, body, {"Content-Type": "application/json"}),
               "https://h.example/p": L.Response(200, b"<title>T</title><body><nav>n</nav><p>text</p>", {"content-type": "text/html"}), "https://h.example/r": L.Response(302, headers={"Location": "/login?x"}),
               "https://h.example/login?x": L.Response(200, b"<p>in</p>", {"content-type": "text/html"}), "https://h.example/s": L.Response(302, headers={"Location": "http://127.0.0.1/a"}), "https://h.example/d": L.Response(403),
               "https://h.example/f.csv": L.Response(200, b"a,b\n1,2", {"content-type": "application/x"}), "https://board.corp.example/1": L.Response(200, b"plain", {"content-type": "text/plain"})})
    f = L.Fetcher(s, web, check_dns=False)
    wiki = L.fetch_link("https://w.atlassian.net/wiki/spaces/DEV/pages/12/x", s, fetcher=f)
    assert wiki.text == "hi" and wiki.metadata["breadcrumb"] == "R" and wiki.metadata["space"] == "S" and web.seen[0][1]["Authorization"] == "Bearer tok"
    page = L.fetch_link(" https://h.example/p ", s, fetcher=f)
    assert page.name == "T" and page.text == "text" and page.type == "web" and page.metadata["url"] == "https://h.example/p"
    assert L.fetch_link("https://board.corp.example/1", s, fetcher=f).type == "nanumi" and web.seen[-1][1]["Cookie"] == "c=1"
    assert L.fetch_link("https://h.example/f.csv", s, fetcher=f).blocks[0].kind == "table"
    for url in ("https://h.example/r", "https://h.example/d", "https://h.example/none", "ftp://h/x", "https:///x"):
        with pytest.raises(ParseError):
            L.fetch_link(url, s, fetcher=f)
    with pytest.raises(ParseError):
        L.Fetcher(s, Web({}), check_dns=True).get("http://127.0.0.1/")
    with pytest.raises(ParseError):
        L.check_url("http://169.254.169.254/", s)
    L.check_url("http://127.0.0.1/", Settings.in_session(allow_loopback=True))
    only = Settings.in_session(allowed_hosts=["corp.example"])
    L.check_url("https://a.corp.example/", only, check_dns=False)
    with pytest.raises(ParseError):
        L.check_url("https://xcorp.example/", only, check_dns=False)


def test_links_as_rows(spark):
    df = spark.createDataFrame([("https://h.example/p",), ("ftp://x",)], "url string")
    answer = lambda url, headers: L.Response(200, b"<p>ok</p>", {"content-type": "text/html"})
    rows = L.read_links(df, Settings.in_session(), transport=answer, check_dns=False).orderBy("source_name").collect()
    assert [r.error is None for r in rows] == [True, False] or [r.error is None for r in rows] == [False, True]
    assert any(b.text == "ok" for r in rows for b in r.blocks)


def test_native_twins_agree(spark):
    from seogo.functions import text as T

    urls = ["https://board.corp.example/1", "https://x.atlassian.net/a", "https://h/display/A/b", "https://nanumi.x/1", "https://h/a", "bad", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(T.link_type(F.col("u"), "", "https://board.corp.example")).collect()]
    s = Settings.in_session(nanumi_base_url="https://board.corp.example")
    assert got[:-1] == [L.detect_link_type(u, s) for u in urls[:-1]]
    ok = [r[0] for r in df.select(T.url_allowed(F.col("u"), ["corp.example"])).collect()]
    assert ok == [True] + [False] * 6


def test_large_plain_files_are_read_to_their_end():
    from seogo.sources.plain import parse_code, parse_delimited, parse_text

    body = ("x" * 999 + "\n") * 21_000  # over 20 MB
    for parse, name in ((parse_text, "a.txt"), (parse_delimited, "a.csv"), (parse_code, "a.py")):
        assert "the_end" in parse(name, (body + "the_end").encode()).blocks[-1].text


def test_second_reading_of_pdf_pages():
    def glyphs(text, top, x=10.0, size=10.0):
        return [Glyph(c, x + 6 * k, top, x + 6 * k + 5, top + 10, size) for k, c in enumerate(text)] + [Glyph("\n")]

    page = glyphs("아래 줄", 40) + glyphs("오른쪽", 21, 200) + glyphs("왼쪽", 20) + glyphs("표 안", 70) + glyphs("제목", 0, size=18)
    lines = lines_of_glyphs(page, [(0, 65, 300, 90)])
    assert [x.text for x in lines] == ["제목", "왼쪽", "오른쪽", "아래 줄"] and lines[0].size == 18
    bad = page_blocks([TextLine("(cid:1)(cid:2)(cid:3)", 0, 10, 10)], [], 0, 1)
    assert garbled(bad[0].text) and not garbled("멀쩡한 글")
    again = second_reading(bad, 99, page, [(65, [["표 안", "값"], ["1", "2"]])], [(0, 65, 300, 90)], 0, 3)
    assert [b.kind for b in again][0] == "heading" and again[-1].kind == "table" and all(b.page == 3 for b in again)
    good = page_blocks([TextLine("멀쩡한 글", 0, 10, 10)], [], 0, 1)
    assert second_reading(good, 99, page, [], [], 0, 1) is None and second_reading(good, 2, page, [], [], 0, 1) is not None
    assert SecondEngine(b"no pdf").glyphs(1, 100.0) == [] and lines_of_glyphs([], []) == []
