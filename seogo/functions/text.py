"""Text functions as Column expressions.

Only Unicode composition (NFC) has no JVM builtin; it runs as an Arrow UDF whose argument is null for
all rows that a quick check proves stable, so nothing but the few unstable texts crosses to Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the tokenizer and of the cleaning rules.
WORD = r"[가-힣]+|[a-zA-Z][a-zA-Z0-9_]*|\p{Nd}+"
CONTROLS = "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\u007f\\ufeff\\u200b]"
SPACES = "[ \\t\\u00a0\\u3000]+"
SENTENCE_END = r"(?<=[.!?。…])(?U:\s)+|(?<=다\.)|\n+"
# Endings stripped once from a word of a question, longest first, then one-syllable particles.
ENDINGS = "인가요 입니까 이에요 입니다 하는지 한가요 되나요 있나요 했나요 하나요 나요 인가 했나 하나 받나 나면 에게 에서는 에서 까지 부터 으로 에는 에도 이란 인지 이며".split()
PARTICLES = "은는이가을를에의로도와과만"
QUESTION_WORDS = "어떻게 언제 누구 누가 얼마 어디 어디에 무엇 무슨 몇 어떤 방법 절차 알려줘 알려 주세요".split()
LIGHT_SYLLABLES = "하되있없안누"
# Labels of citations by source type.
LINK_LABELS = {"confluence": "컨플루언스:", "nanumi": "나누미:", "web": "웹:"}

_MAY_CHANGE = r"[\p{M}\u0340-\u0374\u037e\u0387\u1100-\u11ff\u1f71-\u1fff\u2000\u2001\u2126\u212a\u212b\u2329\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e]"


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; null stays null."""
    return F.coalesce(pandas_udf(_composed, StringType())(F.when(text.rlike(_MAY_CHANGE), text)), text)


def strip(text: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Composed text without control characters, with single spaces and at most one blank line; ''
    for null."""
    t = nfc(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, CONTROLS, "")
    t = F.regexp_replace(t, SPACES, " ")
    # white space at the ends of lines, except line feeds
    t = F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|$)|(?<=\n)[^\S\n]+|^[^\S\n]+", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_cell(text: Column) -> Column:
    """A table cell: cleaned, pipes escaped, on one line."""
    return F.replace(F.replace(clean_text(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def words(text: Column) -> Column:
    """Words of the lower-cased text in order."""
    return F.regexp_extract_all(F.lower(nfc(F.coalesce(text, F.lit("")))), F.lit(f"({WORD})"), F.lit(1))


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, 2))


def _is_hangul(word: Column) -> Column:
    return F.substring(word, 1, 1).between("가", "힣")


def _kept(word: Column) -> Column:
    return (F.length(word) > 1) | word.rlike(r"^\p{Nd}$")


def tokens(text: Column) -> Column:
    """Search tokens in order, with repeats: words, and for Hangul words their syllable pairs too."""
    return F.flatten(
        F.transform(
            words(text),
            lambda w: F.when(_is_hangul(w) & (F.length(w) > 1), F.concat(F.array(w), _bigrams(w))).when(_is_hangul(w) | _kept(w), F.array(w)).otherwise(F.array().cast("array<string>")),
        )
    )


def strip_suffix(word: Column) -> Column:
    """A Hangul word without one ending (longest that leaves something), else without a particle if two
    syllables stay."""
    longest = "|".join(sorted(ENDINGS, key=lambda e: (-len(e), e)))
    ending = F.regexp_extract(word, f"^.+?({longest})$", 1)
    particle = (F.length(word) >= 3) & F.lit(PARTICLES).contains(F.right(word, F.lit(1)))
    return F.when(ending != "", F.substring(word, F.lit(1), F.length(word) - F.length(ending))).when(particle, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def content_units(text: Column) -> Column:
    """The set of units that tell whether a text is about a question: Latin words and numbers, and
    syllable pairs of Hangul words without endings, question words and light syllables."""

    def units(word: Column) -> Column:
        w = F.when(_is_hangul(word), strip_suffix(word)).otherwise(word)
        none = F.array().cast("array<string>")
        hangul = F.when((w == "") | w.isin(*QUESTION_WORDS, *LIGHT_SYLLABLES), none).when(F.length(w) == 1, F.array(w)).otherwise(_bigrams(w))
        return F.when(_is_hangul(word), hangul).when(_kept(word), F.array(word)).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(words(text), units)))


def sentences(text: Column) -> Column:
    """Sentences in order, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def looks_garbled(text: Column) -> Column:
    """Three or more ``(cid:`` marks, or over 5 % replacement and private-use characters."""
    bad = F.regexp_count(text, F.lit("[\\ufffd\\ue000-\\uf8ff]"))
    return F.coalesce((F.regexp_count(text, F.lit(r"\(cid:")) >= 3) | (bad / F.greatest(F.length(text), F.lit(1)) > 0.05), F.lit(False))


def heading_level(style: Column) -> Column:
    """Level 1 to 6 named by a style, 0 if it names no heading."""
    name = F.lower(strip(F.coalesce(style, F.lit(""))))
    level = F.regexp_extract(name, r"^(?:heading|제목|개요|outline)(?U:\s)*(\d)", 1)
    return F.when(name.isin("title", "제목"), 1).when(level != "", F.greatest(F.lit(1), F.least(level.try_cast("int"), F.lit(6)))).otherwise(0)


def join_wrapped_cell(text: Column) -> Column:
    """Lines of a narrow cell joined: one or two Hangul syllables continue a word, others follow a space."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), strip), lambda x: x != "")

    def fold(out: Column, line: Column) -> Column:
        tail = (out != "") & F.right(out, F.lit(1)).between("가", "힣") & line.rlike(r"^[가-힣]{1,2}[.,)]?$")
        return F.when(tail, F.concat(out, line)).when(out != "", F.concat(out, F.lit(" "), line)).otherwise(line)

    return F.aggregate(lines, F.lit(""), fold)


def markdown_table(rows: Column) -> Column:
    """A Markdown table of array<array<string>>, first row as header; blank rows and columns are left out,
    a single row comes as its cells joined by ' | ', nothing as ''."""
    cleaned = F.transform(rows, lambda r: F.transform(r, clean_cell_plain))
    kept = F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(kept, F.size)), F.lit(0))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    columns = F.when(width > 0, F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(kept, lambda r: cell(r, i) != ""))).otherwise(F.array().cast("array<int>"))
    table = F.transform(kept, lambda r: F.transform(columns, lambda i: cell(r, i)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(table, F.lit(0)), lambda c: F.lit("---")), "|"), F.lit("|"))
    one = F.array_join(F.filter(F.get(table, F.lit(0)), lambda c: c != ""), " | ")
    many = F.concat_ws("\n", line(F.get(table, F.lit(0))), rule, F.array_join(F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), line), "\n"))
    return F.when(F.size(table) == 0, "").when(F.size(table) == 1, one).otherwise(many)


def clean_cell_plain(cell: Column) -> Column:
    """``clean_cell`` without composition, which cannot run inside a lambda; compose the input before."""
    t = F.regexp_replace(F.coalesce(cell, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, CONTROLS, ""), SPACES, " ")
    t = strip(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|$)|(?<=\n)[^\S\n]+|^[^\S\n]+", ""))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def contextual_text(title: Column, file_name: Column, section: Column, subject: Column, text: Column) -> Column:
    """The text under a line of its title (or file name), section and subject."""
    head = F.concat_ws(" / ", F.coalesce(_present(title), _present(file_name)), _present(section), _present(subject))
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)


def citation(c) -> Column:  # noqa: ANN001
    """The source of a chunk in words. ``c(name)`` gives the column of a metadata key."""
    kind = F.coalesce(_present(c("file_type")), _present(c("source_type")), F.lit(""))
    name = F.coalesce(_present(c("file_name")), _present(c("source_name")), F.lit("자료"))
    who = F.coalesce(_present(c("sender_name")), _present(c("sender")))
    detail = F.concat_ws(", ", who, _present(F.substring(c("sent_at"), 1, 10)))
    mail = F.concat(F.lit("메일 '"), F.coalesce(_present(c("subject")), name), F.lit("'"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    noted = _present(F.substring(c("created_at"), 1, 10))
    note = F.concat(name, F.when(noted.isNotNull(), F.concat(F.lit(" ("), noted, F.lit(")"))).otherwise(""))
    parent = _present(c("parent_name"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LINK_LABELS.items() for x in kv)), kind)
    span = F.concat(c("page").cast("string"), F.when(c("page_end") > c("page"), F.concat(F.lit("-"), c("page_end").cast("string"))).otherwise(""))
    page = F.when((c("page") > 0) & (kind != "xlsx"), F.concat(F.when(kind == "pptx", "슬라이드 ").otherwise("p."), span))
    sheet = F.when(_present(c("sheet")).isNotNull(), F.concat(F.lit("["), c("sheet"), F.lit("]")))
    named = F.when(parent != name, F.concat(parent, F.lit(" › "), name)).otherwise(name)
    return F.when(kind.isin("eml", "msg"), mail).when(kind.isin("note", "chat"), note).otherwise(F.concat_ws(" ", label, named, page, sheet))


def format_address(name: Column, address: Column) -> Column:
    """``name <address>``, or whichever of the two there is."""
    n, a = clean_text(name), F.coalesce(address, F.lit(""))
    return F.when((n != "") & (a != ""), F.concat(n, F.lit(" <"), a, F.lit(">"))).when(n != "", n).otherwise(a)


def looks_like_login(final_url: Column, url: Column) -> Column:
    """Whether a request was led to a login page."""
    return (final_url != url) & F.lower(final_url).rlike(r"/login|login\.action|/sso|signin|/auth")


def link_type(url: Column, confluence_base: str = "", board_base: str = "") -> Column:
    """confluence, nanumi or web, by configured hosts first, then by the look of host and path."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    base_host = lambda base: F.lower(F.try_parse_url(F.lit(base), F.lit("HOST")))
    out = F.when(F.lit(bool(confluence_base)) & (host == base_host(confluence_base)), "confluence").when(F.lit(bool(board_base)) & (host == base_host(board_base)), "nanumi")
    return out.when(host.contains("atlassian.net") | host.contains("confluence") | url.rlike(r"/wiki/spaces/|/display/|viewpage\.action"), "confluence").when(host.contains("nanumi"), "nanumi").otherwise("web")


def url_allowed(url: Column, hosts: list[str] | None = None) -> Column:
    """Scheme, host and allow-list part of the URL guard (addresses are checked when fetching)."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    ok = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)) & (host != "")
    if hosts:
        some = F.lit(False)
        for h in hosts:
            some = some | (host == h) | host.endswith("." + h)
        ok = ok & some
    return ok


def html_title(html: Column) -> Column:
    """Title of a page: og:title, else title, else the first h1."""
    pick = lambda rx: _present(clean_text(F.regexp_replace(F.regexp_extract(html, rx, 1), "<[^>]*>", " ")))
    return F.coalesce(pick(r"(?is)<meta[^>]*property\s*=\s*[\"']og:title[\"'][^>]*content\s*=\s*[\"']([^\"']*)"), pick(r"(?is)<title[^>]*>(.*?)</title>"), pick(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(""))
