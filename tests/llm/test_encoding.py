import pytest

from seogo.llm.encoding import CHAINS, HONEST, ChainModel, found_garbled, garble, invert, repair, repaired

CLEAN = [
    f"{a} {b} 승인 일정을 {c}까지 정리하고 담당 부서에 알려 주세요. 보관 기한과 접속 오류는 {n}건입니다."
    for n, (a, b, c) in enumerate((a, b, c) for a in ("정보보안팀", "총무팀", "연구지원실", "인사팀") for b in ("요금 정산", "계약 갱신", "재고 조사", "문서 폐기") for c in ("3월 2일", "다음 주", "월말"))
] + [f"Die Prüfstelle hat {n} Einträge geprüft; die mündliche Rückgabe entfällt für das örtliche Büro am {n}. März. Gemäß Blatt wird künftig gezählt." for n in range(1, 30)]


@pytest.fixture(scope="module")
def model():
    return ChainModel(CLEAN)


def test_chains_invert_what_they_garble():
    for chain in CHAINS:
        for text in (CLEAN[0], CLEAN[-1]):
            bad = garble(text, chain)
            if bad and bad != text and "�" not in bad:
                assert invert(bad, chain) == text, chain


def test_held_out_accuracy(model):
    """Unseen sentences, every chain: found, and restored exactly where nothing was lost."""
    held = ["총무팀은 다음 주까지 계약 일정을 정리하고 접속 오류 승인을 인사팀에 알려 주세요.", "Für die nächste Übergabe prüft das Büro die Einträge der Prüfstelle am 4. März."]
    found = restored = total = whole = 0
    for chain in CHAINS:
        for text in held:
            bad = garble(text, chain)
            if not bad or bad == text:
                continue
            hit, back, _ = repair(model, f"{CLEAN[3]}\n{bad}\n{CLEAN[4]}")
            total += 1
            found += hit
            if "�" not in bad:
                whole += 1
                restored += back == f"{CLEAN[3]}\n{text}\n{CLEAN[4]}"
    assert found >= 0.93 * total and restored >= 0.85 * whole, (found, total, restored, whole)


def test_honest_text_is_left_alone(model):
    for text in [*HONEST, *CLEAN, "", "plain ascii", "ERP를 쓰고", "ＦＵＬＬ width", "││ 인용", "A seção 260 não mudou: São Ventão mantém a gestão.", "온도 13±3°C, 면적 75 m², 비용 £201"]:
        assert repair(model, text)[0] is False, text


def test_tables(spark, rows):
    bad = garble(CLEAN[0], CHAINS[0])
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*CLEAN, bad, None, "", "가" * 200_000])] + [(0, CLEAN[0], 1)], "block_id bigint, text string, garbled int")
    p = spark.createDataFrame([(1, ["정상 경고입니다.", bad]), (2, None), (3, []), (4, ["정상"]), (1, ["정상 경고입니다.", bad])], "part_id bigint, warnings array<string>")
    assert rows(found_garbled(b, p)) == [("block", str(len(CLEAN))), ("warning", "1")]
    assert found_garbled(b.limit(0), p.limit(0)).count() == 0
    out = repaired(b.select("block_id", "text"), ["block_id"], "text").filter("garbled").collect()
    assert [(r.block_id, r.restored) for r in out] == [(len(CLEAN), CLEAN[0])]


def test_the_classifier_decides(model):
    """With the classes' tables in another order, garbled text is no longer found or put right."""
    import copy

    import numpy as np

    bad = [b for c in CHAINS[:5] for t in CLEAN[:6] if (b := garble(t, c)) and b != t and "�" not in b]
    assert len(bad) > 5 and all(repair(model, b)[0] for b in bad)
    shuffled = copy.copy(model)
    shuffled.table = np.roll(model.table, 1, axis=0)
    ChainModel.ranked.cache_clear()
    assert sum(shuffled.examine(b)[0] for b in bad) <= len(bad) / 2
    ChainModel.ranked.cache_clear()


def test_the_sample_can_say_that_replacement_marks_are_honest():
    text = "The mark \ufffd stands for an unknown sign."
    assert repair(ChainModel(CLEAN), text)[0]
    ChainModel.ranked.cache_clear()
    assert not repair(ChainModel(CLEAN, honest=[text], weight=5000), text)[0]


def test_marks_alone_are_layout(model):
    assert not any(repair(model, t)[0] for t in ("││ 인용한 줄", "┃┃", "═══ ※ ═══"))
