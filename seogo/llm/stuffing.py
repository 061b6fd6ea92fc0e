"""Keyword-stuffed and link-list pages (problem 10).

Every page becomes a sequence of word classes: function words by their kind, Hangul words by
particle or ending, and content words, numbers, codes, identifiers, links, tags and separators by
class. Two cache classes stand for content words that come back while nothing new is said, and
one for numbers, codes and identifiers that the page already had.

Trigram models over these classes are trained on the honest lines of all pages, one on prose and,
because lists, tables and code that inform are no prose, one on lines that bring new numbers or
codes and one on lines of code. Each stretch of a page is scored by the model that expects it best, and its log
perplexity compared with what is usual under that model. A page is flagged if the mean is abnormally
high or low against the median and median absolute deviation over all pages. Nothing but the perplexity decides.

Counts combine before the shuffle; the tables are bounded by the cube of the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .arrowmap import map_batches

# Function words of English and German by kind.
FUNCTION_WORDS = {
    "A": "a an the this that these those each every der die das den dem des ein eine einen einem einer eines dieser diese dieses jede jeder",
    "P": "of to in on at by for from with without into over under after before between about until during against next as than per "
    "von zu zum zur in im an am auf bei mit ohne nach vor seit bis aus über unter um durch für gegen zwischen laut gemäß ab",
    "J": "and or but if when while although because so yet nor whether otherwise und oder aber wenn weil dass ob sonst obwohl während",
    "V": "is are was were be been being has have had will would can could may must should do does did not no nobody "
    "ist sind war waren sein hat haben hatte wird werden wurde wurden kann können muss müssen soll nicht kein keine",
    "I": "i you he she it we they me him her us them my your his its our their who which what there here please "
    "ich du er sie es wir ihr mich uns ihnen mein ihr unser sich wer welche was hier bitte alle nichts",
}
# Last syllables of Hangul words by kind; longer ones are tried first.
ENDINGS = {
    "t": "은 는", "s": "이 가", "o": "을 를", "l": "에 에서 에게 로 으로 까지 부터 에는 에서는 로는 까지는", "w": "와 과 나 이나",
    "g": "의", "m": "도 만", "c": "고 며 면 서 해 여 어 게 지 니 자 려면 라고", "f": "다 요 까 시오 니다 습니다 세요",
}
_WORD_KIND = {w: kind for kind, words in FUNCTION_WORDS.items() for w in words.split()}
_ENDING = sorted(((e, kind) for kind, es in ENDINGS.items() for e in es.split()), key=lambda x: -len(x[0]))
#: H, L, M: Hangul, lower-case and capitalised content words; R, Q: came back while nothing new was said, again and again;
#: N, C, K: number, code, identifier; Y: one of these that the page already had; U link; T tag; S separator; D leader;
#: "." sentence end; "," list mark; "/" line end.
ALPHABET = "".join([*FUNCTION_WORDS, *ENDINGS, *"HLMRQNCKYUTSD.,/"])
_CODE = {c: k for k, c in enumerate(ALPHABET)}
_HANGUL_END = re.compile(r"[가-힣]$")
_TAG = re.compile(r"[★☆◆◇▲▼▶◀●○♥♡♣♠◎]|^#\w|\[태그\]")
_LINK = re.compile(r"https?:|www\.", re.I)
_IDENTIFIER = re.compile(r"[A-Za-z]\w*_\w|\w[(=]|[)\]:]$.*[(\[]")
#: A word came back if it stood at most ``WINDOW`` words before; nothing new was said if the last ``STALE`` words were all known.
WINDOW, STALE = 80, 6
#: Classes scored together by one model.
STRETCH = 16
_MARK = re.compile(r"(?<!\d)[,·]|[,·](?!\d)")
_INFORMS = frozenset("NCK")
_KEPT = frozenset([*FUNCTION_WORDS, "f", "U", "T"])


@lru_cache(maxsize=1 << 17)
def word_class(word: str) -> tuple[str, bool]:
    """(class, sentence ends here) of one word; content words as if seen for the first time."""
    if word == ",":
        return ",", False
    if _LINK.search(word):
        return "U", False
    if _TAG.search(word):
        return "T", False
    bare = word.strip("()[]{}<>\"'“”‘’«»「」,.;:!?…·*~").lower()
    ends = word.rstrip("\"'”’»)").endswith((".", "!", "?", "。"))
    if not bare:
        return ("D" if len(word) > 3 else "S"), False
    if not any(c.isalnum() for c in bare):
        return "S", False
    if _IDENTIFIER.search(word):
        return "K", False
    if bare.endswith("%"):
        return "H", False  # a share alone says nothing new
    if any(c.isdigit() for c in bare):
        return ("C" if any(c.isalpha() for c in bare) else "N"), False
    if _HANGUL_END.search(bare):
        for e, kind in _ENDING:
            if len(bare) > len(e) and bare.endswith(e):
                return kind, ends and kind == "f"
        return "H", False
    if bare in _WORD_KIND:
        return _WORD_KIND[bare], ends
    first = word.lstrip("()[]\"'“‘«")[:1]
    return ("M" if first.isupper() else "L"), ends and len(bare) > 1


def class_sequence(text: str) -> str:
    """Word classes of a page; lines that have words are separated by ``/``."""
    lines: list[str] = []
    last: dict[str, int] = {}
    times: dict[str, int] = {}  # uses in a row of which each follows the one before it closely
    pos = known = 0
    for line in text.split("\n"):
        seq: list[str] = []
        for w in _MARK.sub(" , ", line).split():
            kind, ends = word_class(w)
            if kind in "SD,":
                seq.append(kind)
                continue
            seen = last.get(w)
            known = 0 if seen is None and kind not in "UT" else known + 1
            if kind in _INFORMS:
                kind = kind if seen is None else "Y"
            elif kind not in _KEPT and seen is not None and known > STALE:
                if pos - seen <= WINDOW:
                    times[w] = t = times.get(w, 1) + 1
                    kind = "R" if t < 4 else "Q"
                else:
                    times[w] = 1
            last[w] = pos
            pos += 1
            seq.append(kind + "." if ends else kind)
        if seq:
            lines.append("".join(seq))
    return "/".join(lines)


def _sequences():  # noqa: ANN202
    def run(ids, texts):  # noqa: ANN001, ANN202
        return ids, [class_sequence(t or "") for t in texts]

    return run


#: Kinds of honest lines that have a model each.
GENRES = ("prose", "records", "code")
#: Largest share of cache classes in a training line of prose or records.
REPEATED = 0.02


def genre(line: str) -> int | None:
    """Which model a line of classes trains; null for links and tags without a sentence, and for lines that go round in circles."""
    around = line.count("R") + 2 * line.count("Q") > REPEATED * len(line)
    if line[-1:] == "." and len(line) >= 6:  # a sentence may tell of a link
        return None if around else 0
    if "U" in line or "T" in line:
        return None
    if "K" in line:
        return 2
    return 1 if not around and ("N" in line or "C" in line) else None


_LOOKUP = np.full(128, _CODE["/"], np.int64)
for _c, _v in _CODE.items():
    _LOOKUP[ord(_c)] = _v


def _codes(lines: list[str]) -> np.ndarray:
    """Codes of all lines with two line ends before each and after the last."""
    return _LOOKUP[np.frombuffer(("//" + "//".join(lines) + "//").encode("ascii"), np.uint8)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): counts of class triples of a task, by genre."""
    k = len(ALPHABET)
    total = np.zeros(len(GENRES) * k**3, np.int64)
    for batch in batches:
        lines: list[list[str]] = [[] for _ in GENRES]
        for page in batch.column(0).to_pylist():
            for line in page.split("/"):
                if (g := genre(line)) is not None:
                    lines[g].append(line)
        for g, mine in enumerate(lines):
            if mine:
                x = _codes(mine)
                gram = (x[:-2] * k + x[1:-1]) * k + x[2:]
                keep = x[2:] != _CODE["/"]
                total += np.bincount(gram[keep] + g * k**3, minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])


class Models:
    """Negative log probabilities (natural) of class triples by genre, trigram backing off to bigram and unigram.

    ``prior`` is the negative log share of a genre in all training classes, ``usual`` what its training lines cost a class.
    """

    def __init__(self, counts: np.ndarray) -> None:
        k = len(ALPHABET)
        grams = counts.reshape(-1, k, k, k).astype(float)
        n = grams.sum((1, 2, 3))
        tables = []
        for tri in grams:
            uni = (tri.sum((0, 1)) + 0.02) / (tri.sum() + 0.02 * k)
            bi = tri.sum(0)
            bi = (bi + 2 * uni) / (bi.sum(1, keepdims=True) + 2)
            tables.append(-np.log((tri + 4 * bi[None]) / (tri.sum(2, keepdims=True) + 4)))
        self.tables = np.stack(tables)
        with np.errstate(divide="ignore"):
            self.prior = -np.log((n + 1e-9) / (n.sum() + 1e-9))
        self.usual = (grams * self.tables).sum((1, 2, 3)) / np.maximum(n, 1)


def log_perplexities(models: Models, pages: list[str]) -> tuple[list[float | None], list[float | None]]:
    """Of each page the mean negative log probability of a class, every stretch under the model that expects it
    best, and by how much it exceeds what is usual under these models."""
    lines = [line for page in pages for line in page.split("/")]
    if not lines:
        return [], []
    x = _codes(lines)
    surprise = models.tables[:, x[:-2], x[1:-1], x[2:]]  # of the class at each place from the third
    length = np.array([len(line) for line in lines])
    start = np.concatenate([[0], np.cumsum(length + 2)[:-1]])  # first class of each line
    pieces = -(-length // STRETCH)
    owner = np.repeat(np.arange(len(lines)), pieces)
    no = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = start[owner] + no * STRETCH
    size = np.minimum(length[owner] - no * STRETCH, STRETCH)
    sums = np.concatenate([np.zeros((len(surprise), 1)), np.cumsum(surprise, 1)], 1)
    costs = sums[:, lo + size] - sums[:, lo]
    best = (costs + models.prior[:, None]).argmin(0)
    cost = costs[best, np.arange(len(best))]
    page = np.repeat(np.arange(len(pages)), [p.count("/") + 1 for p in pages])[owner]
    n = np.bincount(page, size, len(pages))
    total, excess = np.bincount(page, cost, len(pages)), np.bincount(page, cost - models.usual[best] * size, len(pages))
    return tuple([float(v / m) if m else None for v, m in zip(t, n, strict=True)] for t in (total, excess))


def page_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, log_perplexity, excess) of every page.

    ``log_perplexity`` is the mean negative log probability of a class under the models of honest
    lines, ``excess`` the part above what is usual for them. Null and empty texts have no words and null scores. Rows that come twice are scored
    twice; extra columns are ignored. Texts of any length are read whole. Without honest lines to
    train on all classes are equally likely.
    """
    pages = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    seqs = written(map_batches(pages, _sequences, "doc_id bigint, seq string"), "p10")
    counts = np.zeros(len(GENRES) * len(ALPHABET) ** 3, np.int64)
    for r in seqs.select("seq").mapInArrow(_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most a row per cell
        counts[r.cell] = r.n
    models = Models(counts)

    def make():  # noqa: ANN202
        return lambda ids, pages: (ids, *log_perplexities(models, pages))

    return map_batches(seqs, make, "doc_id bigint, log_perplexity double, excess double")


#: A page is abnormal if its excess of log perplexity is this many scaled median deviations from the median.
DEVIATIONS = 9.5


def found_junk(documents: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(doc_id) of pages of abnormally high or low perplexity: repeated keywords, links or tags for the most part.

    Pages without words are not flagged; an empty table gives an empty result. If more than half of all
    pages have one and the same perplexity, every other page is abnormal.
    """
    scores = written(page_scores(documents), "p10-scores")
    y = F.col("excess")
    mid = scores.agg(F.percentile_approx(y, 0.5, 10000)).first()[0]
    if mid is None:
        return scores.filter("false").select("doc_id")
    spread = scores.agg(F.percentile_approx(F.abs(y - mid), 0.5, 10000)).first()[0]
    return scores.filter(F.abs(y - mid) > deviations * 1.4826 * spread).select("doc_id").distinct()
