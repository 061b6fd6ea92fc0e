import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seogo.llm.split import found_oversized, split_items, split_text


@settings(max_examples=300, deadline=None)
@given(st.text("가나. \n!…́", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_fit_and_overlap(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
    rebuilt, at = "", 0
    for a, b, _ in pieces:
        rebuilt, at = rebuilt + text[at:b], b
    assert rebuilt == text
    if len(text) <= limit:
        assert len(pieces) == bool(text)


@settings(max_examples=200, deadline=None)
@given(st.text("가나. \n", max_size=300), st.integers(5, 40))
def test_hard_cuts_only_in_stretches_beyond_the_limit(text, limit):
    import re

    stretches = re.split(r"\n|(?<=[.!?。…]) ", text)
    forced = any(h for _, _, h in split_text(text, limit, 3 if limit > 3 else 0))
    assert forced == (max(map(len, stretches)) > limit)


def test_natural_ends_and_marks():
    text = "한 문장입니다. " * 100
    assert all(text[a:b].rstrip().endswith(".") for a, b, _ in split_text(text, 900, 150))
    assert split_text("", 900) == [] and len(split_text("x" * 1_000_000)) > 1100
    cut = split_text("a" * 9 + "é" * 10, 10, 0)
    assert not any(("a" * 9 + "é" * 10)[a] == "́" for a, _, _ in cut)
    with pytest.raises(ValueError):
        split_text("x", 10, 10)


def test_tables(spark, rows):
    b = spark.createDataFrame([(1, "x" * 901, 1), (1, "x" * 901, 1), (2, "a. " * 400, 2), (3, None, 3), (4, "", 4), (5, "y" * 900, 5)], "block_id bigint, text string, _text int")
    c = spark.createDataFrame([("c:1", "줄\n" * 600), (None, "z" * 1000)], "chunk_id string, text string")
    assert rows(found_oversized(b, c)) == [("block", "1", 1), ("block", "2", 0), ("chunk", "c:1", 0), ("chunk", None, 1)]
    assert found_oversized(b.limit(0), c.limit(0)).count() == 0
    got = rows(split_items(b.select("_text", "block_id", "text"), ["block_id", "_text"]))
    assert [r[:3] for r in got if r[0] == 5] == [(5, 5, 0)] and not [r for r in got if r[0] in (3, 4)] and len([r for r in got if r[0] == 1]) == 4
