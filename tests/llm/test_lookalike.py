import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from seogo.llm.lookalike import canon_char, canonical, canonical_texts, found_lookalikes, lookalike_members

SAME = ["Office ERP-01 한글 · ﬁle, 金年", "Оffice ЕRP‑01 한글 ∙ file, 金年", "Ｏｆｆｉｃｅ　ＥＲＰ－０１ 한글 ・ ﬁｌｅ， 金年", unicodedata.normalize("NFD", "Office\xa0ERP−01 한글 · file, 金年"), "Off​ice ERP-­01 ‎한﻿글 · file, 金年"]


def test_looks_the_same():
    assert len({canonical(t) for t in SAME}) == 1
    assert canonical("Über") == canonical("Über") == canonical("U​̈ber") == "Über"
    assert canonical("a\r\nb") == canonical("a\nb")


def test_visible_differences_stay():
    for a, b in (("A", "a"), ("x²", "x2"), ("①", "1"), ("–", "-"), ("a  b", "a b"), ("a\nb", "a b"), ("ß", "ss"), ("½", "1/2"), ("a.", "a"), ("O", "0")):
        assert canonical(a) != canonical(b), (a, b)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_spliced_equals_whole_and_is_stable(text):
    whole = unicodedata.normalize("NFC", "".join(map(canon_char, unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")))))
    once = canonical(text)
    assert canonical(once) == once
    if all(unicodedata.category(c) not in ("Cf", "Mn") for c in text):
        assert unicodedata.normalize("NFD", once) == unicodedata.normalize("NFD", "".join(canon_char(c) for c in whole)) or once == canonical(whole)


def test_pairs(spark, rows):
    b = spark.createDataFrame([(10, SAME[0]), (9, SAME[1]), (9, SAME[1]), (11, SAME[0]), (12, "other"), (13, None), (14, ""), (15, "​")], "block_id bigint, text string")
    c = spark.createDataFrame([("b:1", SAME[2], "x"), ("a:1", SAME[0], "y")], "chunk_id string, text string, canon string")
    assert rows(found_lookalikes(b, c)) == [("block", "14", "15"), ("block", "9", "10"), ("block", "9", "11"), ("chunk", "a:1", "b:1")]
    assert found_lookalikes(b.limit(0), c.limit(0)).count() == 0
    out = canonical_texts(b.withColumnRenamed("block_id", "canonical"), out="form")
    assert out.columns == ["canonical", "text", "form"] and out.filter("form is null").count() == 1


def test_large_classes_are_linked_through_one_member(spark):
    b = spark.createDataFrame([(i, "ERP") for i in range(100)] + [(1000, "ЕRP"), (1001, "ЕRP")], "block_id bigint, text string")
    got = found_lookalikes(b, spark.createDataFrame([], "chunk_id string, text string")).collect()
    pairs = {(int(r.id_a), int(r.id_b)) for r in got}
    assert pairs == {(i, 1000) for i in range(100)} | {(0, 1001)}
    assert canonical("ab" * 500_000) == "ab" * 500_000


def test_every_composing_pair_has_one_form():
    """Each canonical pair of the code table, decomposed and composed, and both after a stable stretch."""
    import sys

    from seogo.llm.lookalike import _UNSTABLE

    for code in range(sys.maxunicode + 1):
        c = chr(code)
        how = unicodedata.decomposition(c)
        if how and how[0] != "<":
            apart = unicodedata.normalize("NFD", c)
            assert canonical(apart) == canonical(c), hex(code)
            assert canonical("가나 " + apart + " 끝") == canonical("가나 " + c + " 끝"), hex(code)
    assert canonical("が") == "が" and _UNSTABLE.search("゙") and not _UNSTABLE.search("가힣 ASCII – 漢字 かな カナ ä")


def test_members_name_classes_and_groups(spark):
    b = spark.createDataFrame([(i, "ERP") for i in range(100)] + [(1000, "ЕRP"), (2000, "else")], "block_id bigint, text string")
    got = lookalike_members(b, spark.createDataFrame([], "chunk_id string, text string")).collect()
    assert len(got) == 101 and len({r.class_id for r in got}) == 2 and len({r.group_id for r in got}) == 1
