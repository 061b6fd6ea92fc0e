"""Cutting oversized items at natural boundaries (problem 2).

A text is a row of tokens with sizes; their prefix sums give the offset of every boundary. For each
piece the last boundary under the limit is found by binary search in the sorted boundary array;
the next piece starts at the first boundary that repeats no more than the overlap. A stretch that
is itself longer than the limit is cut hard. One text is one unit of work, texts are independent:
nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_batches, texts_of

LIMIT, OVERLAP = 900, 150
_BREAK = re.compile(r"(\n|(?<=[.!?。…]) )")
_SPACE = re.compile(r"\s")


def boundaries(text: str) -> list[int]:
    """Sorted offsets before and after each boundary character, with both ends of the text: prefix sums of the sizes
    of the tokens, which are stretches and the boundary characters between them."""
    return sorted(set(accumulate(map(len, _BREAK.split(text)), initial=0)))


def _hard(text: str, start: int, end: int) -> int:
    """A hard cut at ``end`` that does not part a character from its marks, if it can be avoided."""
    at = end
    while at > start + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️"):
        at -= 1
    return at if at > start + 1 else end


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, cut hard at the end) of each piece; no piece is longer than ``limit``.

    Consecutive pieces share at most ``overlap`` characters and leave no gap. A text within the
    limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")
    cuts, n, start, done, out = boundaries(text), len(text), 0, 0, []
    while done < n:
        end = cuts[bisect_right(cuts, start + limit) - 1]
        hard = end <= done
        if hard:
            end = _hard(text, max(start, done), start + limit)
        out.append((start, end, hard))
        done = end
        if end >= n:
            break
        back = max(end - overlap, start + 1)
        nxt = cuts[bisect_right(cuts, end)]  # the stretch to come has to fit after the repeated part
        if nxt - end <= limit:
            back = max(back, nxt - limit)
        k = bisect_left(cuts, back)
        if k < len(cuts) and cuts[k] < end and not hard:
            start = cuts[k]
        elif overlap and (space := _SPACE.search(text, back, end)) and space.end() < end:
            start = space.end()
        else:
            start = min(back, end)
    return out


def split_items(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, start_pos, piece, forced) of every item; positions count from 1.

    ``forced`` is true where the piece ends in a hard cut. Items within the limit give one piece;
    null and empty texts give none. Repeated rows are cut each on their own; ``keys`` may have any
    type and name except those of the results. The pieces of a text, less their overlaps,
    give the text again.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`_k{i}` {types[k]}" for i, k in enumerate(keys)) + ", piece_no int, start_pos int, piece string, forced boolean"

    def make():  # noqa: ANN202
        def run(*columns):  # noqa: ANN002, ANN202
            out = [[] for _ in range(len(keys) + 4)]
            for *key, value in zip(*columns, strict=True):
                if not value:
                    continue
                for no, (lo, hi, hard) in enumerate(split_text(value, limit, overlap)):
                    for column, x in zip(out, (*key, no, lo + 1, value[lo:hi], hard), strict=True):
                        column.append(x)
            return out

        return run

    pieces = map_batches(df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text).alias("_text")), make, schema)
    return pieces.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def found_oversized(blocks: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id, forced) of every block and chunk longer than ``limit`` characters."""
    items = texts_of(blocks, chunks).filter(F.length("text") > limit)
    pieces = split_items(items, ["item_kind", "item_id"], limit=limit, overlap=overlap)
    return pieces.groupBy("item_kind", "item_id").agg(F.max(F.col("forced").cast("bigint")).alias("forced"))
