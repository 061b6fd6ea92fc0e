from pyspark.sql import functions as F

from seogo.functions import text as T
from seogo.sources import model
from seogo.sources.pdf import join_wrapped

HARD = ["", None, " a \t b\xa0\n\n\n\n c \r\n d​ ", "한글", "\x01x\x0c", "a\u2003\nb\u2009", "　전각　", "\n\n", "x\r\ry", "é" * 5000]


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.c for r in df.select("i", make(F.col("v")).alias("c")).orderBy("i").collect()]


def test_cleaning_agrees_with_its_python_twin(spark):
    assert column(spark, HARD, T.clean_text) == [model.clean(t) for t in HARD]
    cells = ["a|b", "1\n2", None, " x "]
    assert column(spark, cells, T.clean_cell) == [model.cell(t) for t in cells]


def test_tables_styles_and_cells(spark):
    grids = [[["a", None, "b|c"], ["1", None, "2\n3"]], [["x", "", "y"]], [], [["", None]], [["h"], ["1", "2"]], None]
    assert column(spark, grids[:-1], T.markdown_table, "array<array<string>>") == [model.markdown(g) for g in grids[:-1]]
    styles = ["Heading 2", " 제목 ", "개요 9", "outline 0", "본문", None, "title", "heading"]
    assert column(spark, styles, T.heading_level) == [model.style_level(s) for s in styles]
    wrapped = ["홈페이지 관\n리", "abc\ndef", "가\n나다라", None, " \n", "관\n리."]
    assert column(spark, wrapped, T.join_wrapped_cell) == [join_wrapped(t) for t in wrapped]


def test_sentences_garbling_addresses(spark):
    assert column(spark, ["한다.그리고 둘. 셋!\n넷… 다섯"], T.sentences) == [["한다.", "그리고 둘.", "셋!", "넷…", "다섯"]]
    assert column(spark, ["(cid:1)(cid:2)(cid:3)", "ok", "\ufffd" * 2 + "a" * 10, None, ""], T.looks_garbled) == [True, False, True, False, False]
    df = spark.createDataFrame([("이름", "a@b"), ("", "a@b"), ("이름", None), (None, None)], "n string, a string")
    assert [r[0] for r in df.select(T.format_address(F.col("n"), F.col("a"))).collect()] == ["이름 <a@b>", "a@b", "이름", ""]
    urls = spark.createDataFrame([("http://x/login", "http://x/a"), ("http://x/login", "http://x/login"), ("http://x/b", "http://x/a")], "f string, o string")
    assert [r[0] for r in urls.select(T.looks_like_login(F.col("f"), F.col("o"))).collect()] == [True, False, False]
    pages = ['<TITLE> a <b>x</b></TITLE>', '<meta property="og:title" content="O"><title>t</title>', "<h1>h</h1>", "", None]
    assert column(spark, pages, T.html_title) == ["a x", "O", "h", "", ""]


def test_citations(spark):
    keys = "file_type source_type file_name source_name sender_name sender sent_at subject created_at parent_name sheet".split()

    def cite(page=None, page_end=None, **meta):
        df = spark.createDataFrame([(*(meta.get(k) for k in keys), page, page_end)], ", ".join(f"{k} string" for k in keys) + ", page int, page_end int")
        return df.select(T.citation(F.col).alias("c")).first().c

    assert cite(file_type="pdf", file_name="a.pdf", page=3) == "a.pdf p.3" and cite(file_type="pdf", file_name="a.pdf", page=3, page_end=4) == "a.pdf p.3-4"
    assert cite(file_type="pptx", file_name="b.pptx", page=2) == "b.pptx 슬라이드 2" and cite(file_type="xlsx", file_name="c.xlsx", page=1, sheet="목록") == "c.xlsx [목록]"
    assert cite(source_type="confluence", source_name="운영 가이드") == "컨플루언스: 운영 가이드" and cite() == "자료"
    assert cite(file_type="eml", subject="월간", sender_name="김", sent_at="2024-03-02T1") == "메일 '월간' (김, 2024-03-02)" and cite(file_type="msg", file_name="m.msg") == "메일 'm.msg'"
    assert cite(file_type="note", file_name="메모", created_at="2024-01-01T") == "메모 (2024-01-01)" and cite(file_type="pdf", file_name="x", parent_name="묶음.zip") == "묶음.zip › x"
