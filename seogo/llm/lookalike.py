"""One consistent form for text that looks the same (problem 4).

Most text is stable: ASCII, precomposed Hangul, everyday punctuation. A quick check, derived from the
quick-check properties of Unicode and the rules below, finds the runs of characters that a canonical form may change, widens each run by its boundary context (the
starter before it and the combining marks after it), normalises only these segments and splices
them between the unchanged stretches.

The form folds width, composition, invisible characters, kinds of space, compatibility forms and
ligatures, hyphens, middle dots and letters of other scripts with one shape. Characters that look
different stay different: super- and subscripts, circled and squared forms and fractions are not
folded, dashes (en, em) are not hyphens, the number of spaces counts, and case is kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .arrowmap import map_batches, texts_of
from .pairs import FULL_CLASS, expand_links

# Letters of other scripts and the Latin letter of the same shape.
SHAPES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "α": "a", "ρ": "p",
    "ϲ": "c", "ϳ": "j", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ѡ": "w",
    "Ս": "U", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i",
    "ӓ": "ä", "ӧ": "ö", "Ӓ": "Ä", "Ӧ": "Ö", "ї": "ï", "ё": "ë", "Ё": "Ë", "Ї": "Ï",
}
HYPHENS = "‐‑‒−﹣－⁃˗"
MIDDLE_DOTS = "·∙⋅・･ㆍ‧᛫•"
# Compatibility decompositions that look different from their result and are kept.
KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")

@lru_cache(maxsize=1 << 16)
def canon_char(ch: str) -> str:
    """The folded form of one character before composition; empty for invisible ones."""
    if ch in HYPHENS:
        return "-"
    if ch in MIDDLE_DOTS:
        return "·"
    if ch in SHAPES:
        return SHAPES[ch]
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️" or "\U000e0000" <= ch <= "\U000e0fff":
        return ""
    if ch in "\x85  ":
        return "\n"
    how = unicodedata.decomposition(ch)
    if how.startswith("<") and not how.startswith(KEPT_TAGS):
        return "".join(canon_char(chr(int(x, 16))) for x in how.split()[1:])
    if how and not how.startswith("<"):
        return "".join(canon_char(x) for x in unicodedata.normalize("NFD", ch))
    return ch


# Ranges of common text that may be left alone; which of their characters really are stable is derived.
_COMMON = "\t\n\x20~가힣一鿿぀ヿ–—‘”「』※※→→←←↑↓─╿■◿☎☎✉✉¡ÿ"


def _composing() -> frozenset[str]:
    """Characters that can compose with the one before them: their quick check is not an unconditional yes."""
    found = set()
    for code in range(sys.maxunicode + 1):
        how = unicodedata.decomposition(chr(code))
        if how and how[0] != "<" and " " in how:
            found.add(chr(int(how.split()[1], 16)))
    return frozenset(found)


def _stable_class() -> str:
    """A regular expression class of the common characters whose quick checks are all yes: already composed, starters,
    composing with nothing before them, and kept by ``canon_char``."""
    composing = _composing()
    parts = ["\t\n"]
    ranges = zip(_COMMON[2::2], _COMMON[3::2], strict=True)
    for lo, hi in ranges:
        start = None
        for code in range(ord(lo), ord(hi) + 2):
            ch = chr(code)
            ok = code <= ord(hi) and unicodedata.is_normalized("NFC", ch) and not unicodedata.combining(ch) and ch not in composing and unicodedata.normalize("NFC", canon_char(ch)) == ch
            if ok and start is None:
                start = ch
            elif not ok and start is not None:
                parts.append(re.escape(start) + "-" + re.escape(chr(code - 1)))
                start = None
    return "".join(parts)


_UNSTABLE = re.compile(f"[^{_stable_class()}]+")


def _segment(text: str) -> str:
    """Canonical form of one segment together with its boundary context."""
    folded = unicodedata.normalize("NFC", "".join(map(canon_char, text)))
    again = "".join(SHAPES.get(c, c) for c in folded)
    return again if again == folded else unicodedata.normalize("NFC", again)


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; null stays null. Applying it twice changes nothing."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii() or not (found := _UNSTABLE.search(text)):
        return text
    out, done = [], 0
    while found:
        lo, hi = found.span()
        # context: the starter before the run can take its marks, vowels or final consonants
        lo = max(done, lo - 1)
        out.append(text[done:lo])
        out.append(_segment(text[lo:hi]))
        done = hi
        found = _UNSTABLE.search(text, hi)
    out.append(text[done:])
    return "".join(out)


def canonical_texts(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with the column ``out`` holding the canonical form of ``text``.

    Null texts give null, empty ones stay empty; all other columns pass through unchanged, whatever
    their names (an existing column ``out`` is replaced). Texts of any length are handled whole.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def fold(s):  # noqa: ANN001, ANN202
        return s.map(canonical)

    return df.withColumn(out, fold(F.col(text)))


def _hashes():  # noqa: ANN202
    def run(kinds, ids, texts):  # noqa: ANN001, ANN202
        h = xxhash.xxh3_128_digest
        form = [h(t.encode("utf-8", "surrogatepass")) for t in texts]
        canon = [h(canonical(t).encode("utf-8", "surrogatepass")) for t in texts]
        return kinds, ids, form, canon

    return run


def _lookalikes(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(grp, cls, id) of items in groups of one canonical form and at least two strings."""
    items = texts_of(blocks, chunks).filter(F.col("text").isNotNull())
    # hashed once; the steps below read it several times
    hashed = written(map_batches(items, _hashes, "item_kind string, item_id string, form binary, canon binary"), "p4-hashes")
    # a group matters only if it holds two forms: min and max combine before the shuffle
    groups = hashed.groupBy("item_kind", "canon").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).filter("lo <> hi").select("item_kind", "canon")
    rows = hashed.join(groups, ["item_kind", "canon"], "left_semi").distinct()
    order = F.when(F.col("item_kind") == "block", F.lpad("item_id", 20, "0")).otherwise(F.col("item_id"))
    rows = rows.select(F.struct("item_kind", "canon").alias("grp"), F.struct("item_kind", "form").alias("cls"), F.struct("item_kind", order.alias("o"), "item_id").alias("id"))
    return written(rows, "p4-rows")  # few, and read by each of the steps that follow


def found_lookalikes(blocks: DataFrame, chunks: DataFrame, full_class: int | None = FULL_CLASS) -> DataFrame:
    """(item_kind, id_a, id_b): two items of one kind with equal canonical forms and different texts.

    Texts are compared by 128-bit hashes. Null texts are no items; empty texts are like any other.
    Rows that come twice count once. Block ids order as numbers, chunk ids as strings. Copies
    of one string are a class: classes of up to ``full_class`` items (null: all) are expanded into all
    pairs with other classes, larger ones are linked by their representative; ``lookalike_members``
    holds the class of every item.
    """
    rows = _lookalikes(blocks, chunks)
    classes = rows.select("grp", "cls").distinct()
    links = classes.select("grp", F.col("cls").alias("class_a")).join(classes.select("grp", F.col("cls").alias("class_b")), "grp").filter("class_a.form < class_b.form").select("class_a", "class_b")
    pairs = expand_links(links, rows.select("cls", "id"), full_class)
    return pairs.select(F.col("id_a.item_kind").alias("item_kind"), F.col("id_a.item_id").alias("id_a"), F.col("id_b.item_id").alias("id_b"))


def lookalike_members(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id, class_id, group_id) of all items whose text another item shows with different characters.

    A class has one string, a group one canonical form; both are named by hashes. Whatever ``found_lookalikes`` links
    through a representative follows from here: two items of one group and different classes look the same.
    """
    rows = _lookalikes(blocks, chunks)
    return rows.select(F.col("id.item_kind").alias("item_kind"), F.col("id.item_id").alias("item_id"), F.hex("cls.form").alias("class_id"), F.hex("grp.canon").alias("group_id"))
