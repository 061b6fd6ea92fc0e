"""Personal information in free text (problem 3).

High-recall generators propose overlapping spans with a type: digit formats, mail addresses also in
disguise, street and lot addresses, words that may be names. Each candidate gets features of its
format and context; gradient-boosted trees score them, Platt scaling on held-out texts calibrates
the scores, and a threshold per type selects what is redacted. Overlaps go to the likelier span.
The model is fitted on a bounded set of labelled texts made from templates (see ``pii_samples``). Calibration and
thresholds come from scores of texts whose templates the scoring trees have not seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_batches
from .boosting import BoostedTrees, platt
from .pii_samples import FAMILY, FAMILY_TWO, TITLES, labelled

TYPES = ("person", "email", "phone", "id_number", "address")
#: Labelled texts the model is fitted on, and folds of templates that are held out in turn; bounds the driver's work.
FIT_TEXTS, FOLDS = 7000, 4

# One character for one: positions in the plain text are positions in the original.
_PLAIN = str.maketrans({**{chr(0xFF10 + d): str(d) for d in range(10)}, **dict.fromkeys("－–—‑‐−", "-"), "．": ".", "（": "(", "）": ")", "＋": "+", "＠": "@", "　": " ", "\xa0": " ", "：": ":"})

_WIDE = re.compile("[" + re.escape("".join(map(chr, _PLAIN))) + "]")
# Stretches that can hold a number at all; the formats are tried inside them only.
_CLUSTER = re.compile(r"[A-Z+(]?\(?\d[\d .()\-A-Z]{6,}")
_NUMBER = re.compile(
    r"""(?P<licence>(?<![\d-])\d{2}-\d{2}-\d{6}-\d{2}(?![\d-]))
    |(?P<birth>(?<![\d.\-A-Za-z])\d{6}\ ?-?\ ?\d{7}(?![\d-]))
    |(?P<mobile>(?<![\d.\-])(?:\+82[ -]?\(?0?\)?1\d|\(01\d\)|01\d)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d|-\d))
    |(?P<trunk>(?<![\d.\-])(?:\+82[ -]?[2-7]\d?[ -]|\(0\d{1,2}\)\ ?|0\d{1,2}[)\-. ]\ ?)\d{3,4}[ .-]\d{4}(?!\d|-[\dA-Z]))
    |(?P<us>(?<![\d.\-])(?:\+1[ .-]?)?(?:\(\d{3}\)\ ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d|-\d))
    |(?P<abroad>(?<![\d.\-])\+(?!82|1\b)\d{1,3}(?:[ .()-]{1,2}\d{2,5}){2,4}(?!\d))
    |(?P<social>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<passport>(?<![A-Za-z\d])[A-Z](?:\d{8}|\d{3}[A-Z]\d{4})(?![\dA-Za-z]))""",
    re.X,
)
_FORM_TYPE = {"licence": "id_number", "birth": "id_number", "social": "id_number", "passport": "id_number", "mobile": "phone", "trunk": "phone", "us": "phone", "abroad": "phone"}
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|골뱅이)\s?[)\]}]\s?|\s(?:at|골뱅이)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|점)\s?[)\]}]\s?|\s(?:dot|점)\s)"
_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+", re.I)
_MAY_EMAIL = re.compile(r"@|골뱅이|[(\[{ ]at[)\]} ]", re.I)
# A Korean address is found by the number after its road or village, then read back to its first word.
_KOREAN_NUMBER = re.compile(r"(?:(?<=[로길동리])|(?<=\d가))(?:\s?\d{1,3}(?:번)?길)?\s\d{1,4}(?:-\d{1,4})?(?:번지)?(?:,? \d{1,3}동 \d{1,4}호| \d{1,2}층| \([가-힣]{2,5}\))?")
_KOREAN_HEAD = re.compile(r"(?<![가-힣])(?:(?:[가-힣]{1,6}(?:시|도)\s)?(?:[가-힣]{1,6}(?:시|군|구)\s)?(?:[가-힣]{1,6}(?:읍|면)\s)?)[가-힣]{1,8}(?:\d가)?$")
#: No match of the pattern above is longer.
LONGEST_HEAD = 3 * (6 + 1 + 1) + 8 + 2
_ENGLISH_PLACE = re.compile(r"(?<![\w.\-])\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Drive|Dr|Way|Court|Close|Hill|Square|Place|Terrace|Row|Boulevard|Blvd)\b\.?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?)?")
_GERMAN_PLACE = re.compile(r"(?<!\w)(?:[A-ZÄÖÜ][a-zäöüß]+ (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Ring|Damm)|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|gasse|platz|allee|ufer|ring|damm)|Am [A-ZÄÖÜ][a-zäöüß]+) \d{1,4}[a-z]?(?:, \d{5} [A-ZÄÖÜ][a-zäöüß]+)?(?!\w)")
_TITLE = "|".join(TITLES)
_NAME = re.compile(rf"(?<![가-힣])(?:{'|'.join(FAMILY_TWO)}|[{FAMILY}])[가-힣]{{1,3}}")
# What stands around a word that may be a name; a candidate needs something on its right that can end a name.
_LEFT_CUE = re.compile(
    r"(?:(?P<label>(?:성명|이름|담당자|신청인|신청자|민원인|입금자명|입금자|예금주|인계자|인수자|입회|작성|작성자|검토|검토자|승인자|참석|참석자|대표|강사|보호자|수령인|받는 분은|받는 사람|보낸 사람|연락 담당|witnessed|Signed|Contact|Attn)\s?:?\s?)|(?P<team>[가-힣]{1,8}(?:팀|실|부|과|파트|센터|본부)(?:\s|\s?\())|(?P<cell>\|\s)|(?P<item>(?:^|\n)\s*-\s)|(?P<start>(?:^|\n)\s*)|(?P<list>[,/→·]\s)|(?P<topic>(?:중에는|대상은|건으로|[은는])\s)|(?P<open>\()|(?P<stop>[.?!。]\s))$"
)
_RIGHT_CUE = re.compile(
    rf"(?:(?P<honor>\s?(?:님|씨)(?![가-힣]{{3}}))|(?P<title>\s(?:{_TITLE})(?:이|가|은|는|과|와|께|에게|[\s,.(]|$))|(?P<contact>\s?\((?=[\d(+]|[A-Za-z0-9._+\-]+\s?[@(\[]|번호))|(?P<colon>:\s)|(?P<copula>입니다|\s입니다)|(?P<cell>\s\|)|(?P<to>에게|께서)|(?P<home>의 댁)|(?P<subject>[이가] 신청서)|(?P<done>\s확인 완료)|(?P<mark>\s?[,·→/)])|(?P<end>\s*(?:\n|$))|(?P<particle>[이가은는을를의과와]\s))"
)
_LEFT_KINDS = {k: v + 1 for v, k in enumerate(("label", "team", "cell", "item", "start", "list", "topic", "open", "stop"))}
_RIGHT_KINDS = {k: v + 1 for v, k in enumerate(("honor", "title", "contact", "colon", "copula", "cell", "to", "home", "subject", "done", "mark", "end", "particle"))}
_STRONG = {"honor", "title", "contact", "to", "home", "subject", "done", "copula", "colon", "cell", "end", "mark"}
_CAPITAL = re.compile("[A-ZÄÖÜ][a-zäöüß]")
_LATIN = re.compile(r"(?<![A-Za-zÀ-ÿ])(?=([A-Z][a-zà-ÿ]{1,15} (?:[A-Z]\. )?[A-Z][a-zà-ÿ]{1,18}(?![A-Za-zÀ-ÿ])))")  # overlapping
_LATIN_LEFT = re.compile(r"(?:(?P<label>Contact: |Signed: |witnessed: |attention |Attn:? |Visitor |applicant, |According to |Mr\.? |Ms\.? |Mrs\.? |Dr\.? |Herr |Frau |Ansprechpartner: |신청인 |성명:? |담당자: |작성 |검토 |인계자 |인수자 )|(?P<verb>(?:ask|with|cc|from|by|fragen Sie|of|to|call|tell) )|(?P<join>\band |/ |, |→ |· )|(?P<start>(?:^|\n)\s*)|(?P<cell>\| )|(?P<stop>[.?!:;] ))$")
_LATIN_RIGHT = re.compile(r"(?:(?P<mark>,)|(?P<angle> <)|(?P<joins> and | oder )|(?P<verb> (?:showed|handed|gave|called|will|has|said|from|about|signed|wrote)\b)|(?P<own>'s)|(?P<cell> \|| /)|(?P<end>\.?\s*(?:\n|$))|(?P<stop>[.;:]))")
_LATIN_LEFT_KINDS = {k: v + 20 for v, k in enumerate(("label", "verb", "join", "start", "cell", "stop"))}
_LATIN_RIGHT_KINDS = {k: v + 20 for v, k in enumerate(("mark", "angle", "joins", "verb", "own", "cell", "end", "stop"))}
_ID_WORD = re.compile(r"(?:주민|등록|식별|면허|여권|외국인)\S*\s?:?\s*$|(?:passport|licen[cs]e|social security|ssn|id)\b(?: (?:no\.?|number))?\s*$|성명|지급용\s*$|신청인 [가-힣]{2,4}, $", re.I)
_NOT_WORD = re.compile(r"(?:주문|계약|송장|품번|접수|관리|일련|문서|시각|일련값|part no\.?|order|ref\.?|code|item|time)\S*(?: 값은| 값)?\s?:?\s*$", re.I)
_PHONE_WORD = re.compile(r"(?:☎|전화|연락처|번호는|급하면|긴급 시|야간에는|또는|도착하면|call|tel\.?|phone|mobile|fax|H\.?P\.?|T\.)\s?:?\s*$", re.I)
_PLACE_WORD = re.compile(r"(?:주소:?|댁\(|현장은|곳은|택배는|원본은|소재지|lives at|keys of|ship\b.{1,30} to|address:?|wohnt)\s*$", re.I)
_MAIL_WORD = re.compile(r"(?:✉|메일:?|회신은|자료는|e-?mail:?|mail|<|\(|또는|,)\s*$", re.I)
_SPLIT_GIVEN = re.compile("|".join((*FAMILY_TWO, f"[{FAMILY}]")))


def _wraps(plain: str, s: int, e: int) -> bool:
    """Whether the bracket at ``s`` opens around a number like 02)123-4567 and is closed after it."""
    if plain[plain.index(")", s) + 1] == " ":
        return False
    depth = 0
    for c in plain[e : e + 80]:
        if c == "\n":
            return False
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return True
    return False


def _numbers(plain: str):  # noqa: ANN202
    for c in _CLUSTER.finditer(plain):
        yield from _NUMBER.finditer(plain, c.start(), min(len(plain), c.end() + 3))


def _korean_places(plain: str):  # noqa: ANN202
    done = 0
    for m in _KOREAN_NUMBER.finditer(plain):
        # the search sees the character before its start, so that no word is taken from its middle
        if head := _KOREAN_HEAD.search(plain, max(done, m.start() - LONGEST_HEAD), m.start()):
            yield head.start(), m.end()
            done = m.end()


def _valid_birth(digits: str) -> bool:
    return 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= 31


def candidates(text: str) -> list[tuple[int, int, int, tuple]]:
    """(start, end, type number, features) of overlapping proposals; positions count from 0."""
    plain = text.translate(_PLAIN) if _WIDE.search(text) else text
    out = []
    contacts: list[int] = []
    for m in _numbers(plain):
        form, s, e = m.lastgroup, m.start(), m.end()
        kind = _FORM_TYPE[form]
        if plain[s] == "(" and _wraps(plain, s, e):
            s += 1
        left, right = plain[max(0, s - 24) : s], plain[e : e + 6]
        digits = re.sub(r"\D", "", m[0])
        born = form == "birth" and _valid_birth(digits)
        sex = int(digits[6]) if form == "birth" else -1
        out.append((s, e, TYPES.index(kind), _pack(kind, ("licence", "birth", "social", "passport", "mobile", "trunk", "us", "abroad").index(form) + 1, len(digits), bool(_ID_WORD.search(left)), bool(_NOT_WORD.search(left)), bool(_PHONE_WORD.search(left)), born, sex, right[:1].isalpha() and right[:1].isascii(), plain[s] in "+(", m[0].count("-"), left[-1:] in ".-", 0, 0)))
        if kind == "phone":
            contacts.append(s)
    if _MAY_EMAIL.search(plain):
        for m in _EMAIL.finditer(plain):
            s, e = m.start(), m.end()
            left = plain[max(0, s - 12) : s]
            out.append((s, e, 1, _pack("email", 1 if "@" in m[0] else 2, e - s, bool(_MAIL_WORD.search(left)), False, False, False, 0, False, False, m[0].count(" "), False, 0, 0)))
            contacts.append(s)
    latin = bool(_CAPITAL.search(plain))
    for form, spans in ((1, _korean_places(plain)), (2, _ENGLISH_PLACE.finditer(plain) if latin else ()), (3, _GERMAN_PLACE.finditer(plain) if latin else ())):
        for m in spans:
            s, e = m if form == 1 else m.span()
            whole = plain[s:e]
            words = whole.split()
            city = form == 1 and words[0][-1] in "시도" and len(words) > 2
            area = form == 1 and any(w[-1] in "구군시" for w in words[:-2])
            road = next((w for w in words if re.search(r"(?:로|길|동|리|가)(?:\d+길)?$", w)), "") if form == 1 else ""
            left, right = plain[max(0, s - 40) : s], plain[e : e + 2]
            unit = right[:1] in "주명번부개건대원%차회일월년점초단시분장권쪽층" and right[:1] != ""
            out.append((s, e, 4, _pack("address", form, e - s, bool(_PLACE_WORD.search(left)), unit, city, area, len(road), whole.endswith(("번지", "층", "호", ")")), bool(re.search(r"길$|대로|\d길", road)), len(words), "," in whole, 0, 0)))
    for m in _NAME.finditer(plain):
        s, word = m.start(), m[0]
        family = 2 if word[:2] in FAMILY_TWO else 1
        best = None
        for n in (3, 2, 4) if family == 1 else (4, 3):
            if len(word) < n or n - family > 2:
                continue
            rc = _RIGHT_CUE.match(plain, s + n)
            if rc and (best is None or (rc.lastgroup in _STRONG and best[1].lastgroup not in _STRONG)):
                best = (n, rc)
        if best is None:
            continue
        lc = _LEFT_CUE.search(plain[max(0, s - 16) : s])
        lk = _LEFT_KINDS[lc.lastgroup] if lc else 0
        n, rc = best
        after = plain[s + n : s + n + 40]
        near = bool(re.match(r".{0,30}?(?:01\d[ .-]?\d{3}|\+\d|@|\(at\)|\(0\d)", after, re.S))
        common = FAMILY.index(word[0]) if family == 1 else -1
        out.append((s, s + n, 0, _pack("person", family, n, lk == 1, lk == 2, lk in (3, 4), near, _RIGHT_KINDS[rc.lastgroup], lk == 6, rc.lastgroup in ("honor", "title"), lk, rc.lastgroup == "particle", common, _syllables(word[family:n]))))
    if latin:
        for m in _LATIN.finditer(plain):
            s, e = m.span(1)
            lc, rc = _LATIN_LEFT.search(plain[max(0, s - 20) : s]), _LATIN_RIGHT.match(plain, e)
            lk, rk = (_LATIN_LEFT_KINDS[lc.lastgroup] if lc else 0), (_LATIN_RIGHT_KINDS[rc.lastgroup] if rc else 0)
            near = bool(re.match(r".{0,12}?(?:@|\(at\)|\[at\]|\d{3}[- .]\d{3})", plain[e : e + 40], re.S))
            out.append((s, e, 0, _pack("person", 3, e - s, lk == 20, lk == 21, lk in (23, 24), near, rk, lk == 22, rk in (21, 23), lk, rk == 20, 0, 0)))
    return out


def _pack(kind: str, *values) -> tuple:  # noqa: ANN002
    return (TYPES.index(kind), *map(float, values))


_GIVEN_OFTEN = frozenset("가나다라미서지민준현우진연수영은해소유태도예찬슬새초보여결람늘봄빛샘솔율온완휘롬린별들묵담겸하아윤채빈호성재승훈경희숙자순")


@lru_cache(maxsize=1 << 14)
def _syllables(given: str) -> float:
    """Share of the given name's syllables that are usual in given names."""
    return sum(c in _GIVEN_OFTEN for c in given) / max(1, len(given))


class Redactor:
    """Fitted trees with calibrated thresholds."""

    def __init__(self, fit: int = FIT_TEXTS, folds: int = FOLDS, seed: int = 7) -> None:
        parts = [self._rows(labelled(fit // folds, seed + k, k, folds)) for k in range(folds)]
        x, y, kinds = (np.concatenate(c) for c in zip(*parts, strict=True))
        fold = np.repeat(np.arange(folds), [len(p[1]) for p in parts])
        raw = np.zeros(len(y))
        for k in range(folds):
            raw[fold == k] = BoostedTrees(x[fold != k], y[fold != k]).raw(x[fold == k])
        self.model = BoostedTrees(x, y)
        self.model.scale = a, c = platt(raw, y)
        p = 1 / (1 + np.exp(-np.clip(a * raw + c, -30, 30)))
        self.thresholds = np.array([self._threshold(p[kinds == k], y[kinds == k]) for k in range(len(TYPES))])

    @staticmethod
    def _rows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, kinds = [], [], []
        for text, spans in texts:
            true = {(s, t) for s, _, t in spans}
            for s, _, k, features in candidates(text):
                x.append(features)
                y.append(float((s, TYPES[k]) in true))
                kinds.append(k)
        return np.array(x), np.array(y), np.array(kinds)

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The highest calibrated probability whose F1 on unseen templates is all but the best."""
        if not len(p) or not y.any():
            return 0.5
        grid = np.linspace(0.1, 0.9, 33)
        f1 = np.array([2 * (y * (p >= t)).sum() / ((p >= t).sum() + y.sum()) for t in grid])
        return float(grid[np.flatnonzero(f1 >= f1.max() - 0.001)[-1]])

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Non-overlapping (start, end, type) per text, in order."""
        rows, owner = [], []
        for k, t in enumerate(texts):
            got = candidates(t) if t else []
            rows += got
            owner += [k] * len(got)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not rows:
            return out
        p = self.model.probability(np.array([r[3] for r in rows]))
        keep = p >= self.thresholds[[r[2] for r in rows]]
        chosen: dict[int, list] = {}
        for i in np.flatnonzero(keep).tolist():
            chosen.setdefault(owner[i], []).append((-p[i], rows[i][0] - rows[i][1], rows[i]))
        for k, spans in chosen.items():
            taken: list[tuple[int, int]] = []
            for _, _, (s, e, kind, _) in sorted(spans, key=lambda x: x[:2]):
                if all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    out[k].append((s, e, TYPES[kind]))
            out[k].sort()
        return out


@lru_cache(maxsize=4)
def fitted(fit: int = FIT_TEXTS, folds: int = FOLDS) -> Redactor:
    """The model, fitted once a driver; the same for the same parameters."""
    return Redactor(fit, folds)


PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with its spans replaced by typed placeholders."""
    out, at = [], 0
    for s, e, kind in spans:
        out += (text[at:s], PLACEHOLDERS[kind])
        at = e
    return "".join((*out, text[at:]))


def free_texts(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(place, record_id, text): distinct chunk texts and the values ``description`` and ``comments``."""
    a = chunks.select(F.lit("text").alias("place"), F.col("chunk_id").alias("record_id"), "text")
    b = parts.select(F.col("part_id").cast("string").alias("record_id"), F.explode(F.map_filter("metadata", lambda k, v: k.isin("description", "comments") & v.isNotNull())).alias("place", "text"))
    return a.unionByName(b.select("place", "record_id", "text")).filter("text is not null")


def found_personal(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(place, record_id, start_pos, pii_type) of every occurrence; positions count from 1.

    Null and empty texts have none; rows that come twice count once; texts are read whole.
    """
    redactor = fitted()

    def make():  # noqa: ANN202
        def run(places, ids, texts):  # noqa: ANN001, ANN202
            out: list[list] = [[], [], [], []]
            for place, key, spans in zip(places, ids, redactor.find(texts), strict=True):
                for s, _, kind in spans:
                    for column, x in zip(out, (place, key, s + 1, kind), strict=True):
                        column.append(x)
            return out

        return run

    return map_batches(free_texts(chunks, parts), make, "place string, record_id string, start_pos bigint, pii_type string").distinct()


def redacted(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(place, record_id, text) with typed placeholders in place of personal information."""
    redactor = fitted()

    def make():  # noqa: ANN202
        def run(places, ids, texts):  # noqa: ANN001, ANN202
            return places, ids, [redact(t, s) for t, s in zip(texts, redactor.find(texts), strict=True)]

        return run

    return map_batches(free_texts(chunks, parts), make, "place string, record_id string, text string").distinct()
