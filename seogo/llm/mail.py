"""Reducing mails to what their sender newly wrote (problem 1).

The lines of a mail, over all its blocks, are parsed by a recursive layout grammar:

    mail      := notice* part
    part      := (authored | quote | reply)* [closing tail]
    quote     := marked line (marked or wrapped line)*      its content, less one mark, is a part again
    reply     := introduction (quote | part)                 introduction: "On ... wrote:", header fields
    forward   := divider [header fields] part                of a mail client, or an original-message line
    closing   := a closing formula on its own line
    tail      := (signature | device line | notice | quote | reply | forward | earlier mail)*
                 a signature has no sentences, an earlier mail begins with a greeting or ends with a closing of its own;
                 where other sentences follow a closing formula, or the sender's name stands below the next one, it was
                 a request in the middle of the text, which goes on

Everything is a tree of nodes; only authored leaves of the outermost part are serialised. What looks
like layout inside authored text stays authored: menu paths with ">", rulers around figures, options
that start with "--", single fields such as "제목:".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closing formulas, compared without the mark at their end.
CLOSINGS = frozenset(
    "감사합니다|고맙습니다|수고하세요|수고하십시오|검토 부탁드립니다|확인 부탁드립니다|회신 부탁드립니다|잘 부탁드립니다|이상입니다|감사드립니다|감사합니다 수고하세요|"
    "best regards|kind regards|regards|warm regards|best wishes|best|thanks|many thanks|thank you|cheers|sincerely|yours sincerely|"
    "viele grüße|mit freundlichen grüßen|beste grüße|freundliche grüße|herzliche grüße|mfg|vg|danke".split("|")
)
# How a mail begins.
GREETING = re.compile(
    r"^(?:안녕하(?:세요|십니까)|(?:늘|항상|매번) .{0,12}(?:많으십니다|감사|고맙)|수고(?:가)? (?:많|하)|\S+(?: \S+)?(?:님|선생님|팀장님|과장님|부장님),?(?: 안녕.*)?$|반갑습니다|바쁘신|답장이|.{0,12}연락드립니다|"
    r"(?:hello|hi|dear|good (?:morning|afternoon|evening)|thanks for|thank you for|hope)\b|(?:hallo|guten (?:tag|morgen|abend)|liebe|sehr geehrte|danke für|vielen dank für)\w*\b)",
    re.I,
)
# Patterns of lines that mail programs and organisations add.
DEVICE = re.compile(r"^(?:(?:내|나의)? ?\S* ?(?:휴대전화|휴대폰|모바일|아이폰|스마트폰|핸드폰)\S*(?: 메일)?(?:에서| 앱에서)? (?:보냄|보냈습니다|발송됨)\.?|(?:sent|get|gesendet|von meinem)\b.{0,40}(?:phone|mobile|android|ipad|handy|outlook|mail app|gesendet)\S*\.?)$", re.I)
NOTICE = re.compile(
    r"^(?:\[(?:외부 ?메일|외부|보안 ?안내|주의|external|extern)\]|caution\b|external e-?mail|confidential|this (?:e-?mail|message) (?:is|and|may|was|contains)|if you (?:received|are not)|diese (?:nachricht|e-?mail)|wenn sie nicht|"
    r"본 (?:메일|전자우편|메시지|이메일)|이 (?:메일|전자우편|메시지|이메일)|※ ?(?:이|본) (?:메시지|메일|전자우편)|메일에 포함된|발신 ?전용|수신을 원하지|허락 없이|인쇄하기 전|please consider the environment|please do not reply|think before you print|bitte prüfen sie, ob)",
    re.I,
)
RULER = re.compile(r"^\s*(?:[-_=*~ㅡ─━—–#+.]{2,}|--\s?)\s*$")
_FIELD = re.compile(r"^(보낸 ?사람|보낸 ?날짜|받는 ?사람|참조|숨은 ?참조|제목|발신(?:자|인)?|수신(?:자|인)?|일시|날짜|from|sent|date|to|cc|bcc|subject|von|gesendet|datum|an|betreff)\s*:\s*(.*)$", re.I)
_SENDER_FIELD = re.compile(r"^(?:보낸 ?사람|발신(?:자|인)?|from|von)\s*:", re.I)
_ORIGINAL = re.compile(r"^\s*[-_=]{2,}\s*(?:original message|forwarded message|original-?nachricht|weitergeleitete nachricht|ursprüngliche nachricht|원본 ?메시지|원본 ?메일|이전 ?메시지|이전 ?메일|previous message|earlier message|vorherige nachricht|전달된 ?메시지|전달된 ?메일|원문|전달)\s*[-_=]{2,}\s*$|^\s*begin forwarded message:", re.I)
_INTRO = re.compile(
    r"^\s*(?:on\b.{4,200}\bwrote:?|am\b.{4,200}\bschrieb\b.{0,200}:?|.{0,120}\d.{0,120}님이 (?:작성|씀|쓴 글|작성함)\s*:?|.{0,120}\d.{0,120}\S+ ?님?(?:이|가) (?:쓴 글|작성)\s*:?|le\b.{4,200}\ba écrit\s*:)\s*$", re.I
)
_INTRO_START = re.compile(r"^\s*(?:on (?:mon|tue|wed|thu|fri|sat|sun)|am \d{1,2}\.\s?\d{1,2}\.\d{2,4} um|\d{4}(?:년|[-.])\s?\d{1,2}(?:월|[-.])\s?\d{1,2}.{0,40}\d:\d\d,)", re.I)
_INTRO_END = re.compile(r"(?:wrote|schrieb.{0,120}|님이 작성|쓴 글)\s*:?\s*$", re.I)
MARK = re.compile(r"^\s?(?:[>|»│┃¦]|&gt;)+ ?")
_ONE_MARK = re.compile(r"^\s?(?:[>|»│┃¦]|&gt;) ?")
_MENU = re.compile(r"\S > \S")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_SENTENCE = re.compile(r"[.!?。…]\s*$")
_POSTSCRIPT = re.compile(r"(?:추신|덧붙임|p\.? ?s\.?)\s*[:.)]", re.I)
_END = re.compile(r"(?:[.!?。…:]|[)\]\"'”’])\s*$")

#: Shortest line, without marks, that a mail program may have wrapped.
WRAPPED = 8


@dataclass
class Line:
    block: int
    no: int
    text: str


@dataclass
class Node:
    kind: str  # part, authored, closing, notice, device, signature, intro, quote, earlier
    lines: list[Line] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def _closing(text: str) -> bool:
    return text.strip().rstrip(".,!~ ").lower() in CLOSINGS


def _bare(text: str) -> str:
    return _ONE_MARK.sub("", text, count=1)


class _Parser:
    """Recursive descent over the lines of one part; ``name`` is the sender's, for signatures."""

    def __init__(self, lines: list[Line], texts: list[str], name: str, depth: int) -> None:
        self.lines, self.texts, self.name, self.depth, self.at = lines, texts, name, depth, 0
        self.known = (0, -1)  # a stretch without a break, as far as it was looked at

    def more(self) -> bool:
        return self.at < len(self.lines)

    def take(self, kind: str, count: int = 1) -> Node:
        node = Node(kind, self.lines[self.at : self.at + count])
        self.at += count
        return node

    def marked(self, k: int) -> bool:
        """Line ``k`` belongs to a quotation: it has a mark and is no menu path or table row alone."""
        text = self.texts[k]
        if not MARK.match(text):
            return False
        if _TABLE.match(text) and text.lstrip().startswith("|") and text.count("|") > 2:
            return False
        if text.lstrip().startswith(">") and _MENU.search(_bare(text)):
            # the second line of a menu path that the line before began
            before = self.texts[k - 1] if k else ""
            return MARK.match(before) is not None or not _MENU.search(before)
        return True

    def header(self, k: int) -> int:
        """Lines of a block of header fields at ``k``, 0 if there is none: a sender and one more."""
        n = 0
        while k + n < len(self.texts) and _FIELD.match(self.texts[k + n].strip()):
            n += 1
        block = self.texts[k : k + n]
        return n if n >= 2 and any(_SENDER_FIELD.match(t.strip()) for t in block) else 0

    def introduction(self, k: int) -> int:
        """Lines of the introduction of an earlier mail at ``k``, 0 if there is none."""
        text = self.texts[k]
        if _ORIGINAL.match(text):
            n = 1
            return n + self.header(k + n)
        if RULER.match(text) and k + 1 < len(self.texts) and (n := self.header(k + 1)):
            return n + 1
        if _INTRO.match(text):
            return 1
        if _INTRO_START.match(text) and k + 1 < len(self.texts) and not _INTRO_END.search(text) and _INTRO_END.search(self.texts[k + 1]) and len(self.texts[k + 1]) < 120:
            return 2
        return self.header(k)

    def quote(self) -> Node:
        """Marked lines with the ends of wrapped ones; parsed again without one mark."""
        start = self.at
        while self.more():
            if self.marked(self.at) or (MARK.match(self.texts[self.at]) and self.at > start):
                self.at += 1
                continue
            # an unmarked line that completes a wrapped one
            before = self.texts[self.at - 1]
            if self.at > start and self.lines[self.at].block == self.lines[self.at - 1].block and not _END.search(before) and len(MARK.sub("", before).strip()) >= WRAPPED and self.wrapped(self.at):
                self.at += 1
                continue
            break
        lines = self.lines[start : self.at]
        inner = _Parser(lines, [_bare(t) for t in self.texts[start : self.at]], "", self.depth + 1)
        return Node("quote", lines, [inner.part()] if self.depth < 40 else [])

    def wrapped(self, k: int) -> bool:
        """Whether line ``k`` may read on from a sentence that the line before left open."""
        return bool(self.texts[k].strip()) and not _closing(self.texts[k]) and not self.introduction(k)

    def part(self) -> Node:
        node = Node("part")
        while self.more() and NOTICE.match(self.texts[self.at].strip()):
            node.children.append(self.take("notice"))
        while self.more():
            text = self.texts[self.at].strip()
            if self.marked(self.at):
                node.children.append(self.quote())
            elif n := self.introduction(self.at):
                node.children.append(self.take("intro", n))
                if self.more() and not (MARK.match(self.texts[self.at]) or not self.texts[self.at].strip()):
                    # an earlier mail without marks goes on to the end
                    node.children.append(self.rest("earlier"))
            elif _closing(text):
                node.children.append(self.take("closing"))
                if self.ends_here(self.at):
                    node.children.extend(self.tail())
            elif DEVICE.match(text) or NOTICE.match(text):
                node.children.append(self.take("device" if DEVICE.match(text) else "notice"))
            elif self.signature(self.at):
                node.children.extend(self.tail())
            else:
                node.children.append(self.take("authored"))
        return node

    def stretch(self, k: int) -> list[str]:
        """Lines from ``k`` up to the next quotation, introduction, device line or notice."""
        first, end = self.known
        if not first <= k <= end:
            end = k
            while end < len(self.texts) and not self.breaks(end):
                end += 1
            self.known = k, end
        return [t.strip() for t in self.texts[k:end] if t.strip()]

    def breaks(self, k: int) -> bool:
        text = self.texts[k].strip()
        return bool(text) and bool(self.marked(k) or DEVICE.match(text) or NOTICE.match(text) or self.introduction(k))

    def ends_here(self, k: int) -> bool:
        """Whether what follows a closing at ``k`` is a tail and not more of the text."""
        lines = self.stretch(k)
        if not lines or RULER.match(lines[0]) or _POSTSCRIPT.match(lines[0]) or self.named(lines[0]):
            return True
        first = next((n for n, t in enumerate(lines) if _SENTENCE.search(t) or GREETING.match(t)), None)
        if first is None or GREETING.match(lines[first]):
            return True
        # sentences without a greeting: an earlier mail has a closing of its own, and the sender's name is not below it
        last = max((n for n, t in enumerate(lines) if _closing(t)), default=None)
        return last is not None and not (last + 1 < len(lines) and (self.named(lines[last + 1]) or (RULER.match(lines[last + 1]) and last + 2 < len(lines) and self.named(lines[last + 2]))))

    def named(self, text: str) -> bool:
        return bool(self.name) and text.startswith(self.name)

    def signature(self, k: int) -> bool:
        """The sender's name, or a divider right above it, begins a signature before any closing."""
        if not self.name:
            return False
        text = self.texts[k].strip()
        if text.startswith(self.name) and len(text) <= len(self.name) + 60 and k > 0 and not _END.search(text):
            return not any(_SENTENCE.search(t) for t in self.stretch(k)[1:])
        return bool(RULER.match(text)) and k + 1 < len(self.texts) and self.texts[k + 1].strip().startswith(self.name)

    def tail(self) -> Iterator[Node]:
        """After the closing nothing is newly written: signature, notices, or an earlier mail."""
        while self.more():
            text = self.texts[self.at].strip()
            if _POSTSCRIPT.match(text):
                yield self.take("authored")
            elif self.marked(self.at):
                yield self.quote()
            elif n := self.introduction(self.at):
                yield self.take("intro", n)
            elif DEVICE.match(text):
                yield self.take("device")
            elif NOTICE.match(text):
                yield self.take("notice")
            else:
                yield self.take("signature")

    def rest(self, kind: str) -> Node:
        lines, texts = self.lines[self.at :], self.texts[self.at :]
        self.at = len(self.lines)
        inner = _Parser(lines, texts, "", self.depth + 1)
        return Node(kind, lines, [inner.part()] if self.depth < 40 else [])


def parse_mail(lines: list[Line], sender: str) -> Node:
    """The tree of one mail; its outermost part holds the authored leaves."""
    return _Parser(lines, [x.text for x in lines], sender.strip(), 0).part()


def authored_lines(tree: Node) -> list[Line]:
    """Lines the sender wrote: authored and closing leaves of the outermost part."""
    return [x for child in tree.children if child.kind in ("authored", "closing") for x in child.lines]


def _mail_lines(blocks: list[tuple[int, str]]) -> list[Line]:
    return [Line(b, k, t) for b, text in blocks for k, t in enumerate((text or "").split("\n"), 1)]


_SCHEMA = "block_id bigint, line_no bigint, line string, authored boolean"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by mail and position; holds the blocks of one mail at a time."""
    key, held, sender, last = None, [], "", None
    out: list[tuple] = []

    def done() -> None:
        lines = _mail_lines(held)
        own = {(x.block, x.no) for x in authored_lines(parse_mail(lines, sender))}
        out.extend((x.block, x.no, x.text, (x.block, x.no) in own) for x in lines)

    for batch in batches:
        for source, name, pos, block, text in zip(batch["source_id"], batch["sender"], batch["pos"], batch["block_id"], batch["text"], strict=True):
            if source != key:
                if held:
                    done()
                key, held, sender, last = source, [], name or "", None
            if block != last:
                held.append((block, text))
            last = block
        if len(out) > 20000:
            yield pd.DataFrame(out, columns=["block_id", "line_no", "line", "authored"])
            out = []
    if held:
        done()
    yield pd.DataFrame(out, columns=["block_id", "line_no", "line", "authored"])


def mail_lines(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(block_id, line_no, line, authored) of the lines of mails, without ``meta`` blocks.

    Mails are parts of type eml or msg at depth 0. Blocks and parts that come twice count once; a null
    text is one empty line. Blocks of a mail are brought together by one shuffle and read in the order of
    ``pos``; a task holds one mail at a time, whatever its group's size.
    """
    mails = parts.filter(F.col("source_type").isin("eml", "msg") & (F.col("depth") == 0)).groupBy("source_id", "part_ordinal").agg(F.max(F.coalesce(F.col("metadata")["sender_name"], F.regexp_extract(F.coalesce(F.col("metadata")["sender"], F.lit("")), r"^\s*([^<@]*[^<@\s])\s*<", 1))).alias("sender"))
    body = blocks.filter(~F.col("kind").eqNullSafe("meta")).select("block_id", "source_id", "part_ordinal", "pos", "text")
    rows = body.join(mails, ["source_id", "part_ordinal"]).withColumn("source_id", F.concat_ws(":", "source_id", "part_ordinal"))
    ordered = rows.select("source_id", "sender", "pos", "block_id", "text").repartition("source_id").sortWithinPartitions("source_id", "pos", "block_id")
    return ordered.mapInPandas(_parse_batches, _SCHEMA)


def found_unwritten(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(block_id, line_no) of lines that the sender did not write for this mail; blank lines too
    where they stand inside quoted text."""
    return mail_lines(blocks, parts).filter("not authored").select("block_id", "line_no").distinct()


def authored_texts(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(block_id, text) of mail blocks reduced to authored lines; blocks without any are left out."""
    lines = mail_lines(blocks, parts).filter("authored").groupBy("block_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("x"))
    return lines.select("block_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))
