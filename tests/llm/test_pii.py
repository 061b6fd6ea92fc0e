import numpy as np
import pytest

from seogo.llm.boosting import BoostedTrees
from seogo.llm.pii import fitted, found_personal, redact, redacted
from seogo.llm.pii_samples import labelled


@pytest.fixture(scope="module")
def redactor():
    return fitted()


def test_trees_learn_an_interaction_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(x[:2000], y[:2000])
    m.calibrate(x[2000:2500], y[2000:2500])
    p = m.probability(x[2500:])
    assert ((p > 0.5) == (y[2500:] > 0.5)).mean() > 0.95 and abs(p.mean() - y[2500:].mean()) < 0.05 and len(m.probability(np.zeros((0, 6)))) == 0


def test_held_out_accuracy_by_type(redactor):
    test = labelled(1200, seed=1234)
    hit, found, true = {}, {}, {}
    for (text, spans), got in zip(test, redactor.find([t for t, _ in test])):
        want = {(s, k) for s, _, k in spans}
        have = {(s, k) for s, _, k in got}
        for k in ("person", "email", "phone", "id_number", "address"):
            a, b = {x for x in want if x[1] == k}, {x for x in have if x[1] == k}
            hit[k], found[k], true[k] = hit.get(k, 0) + len(a & b), found.get(k, 0) + len(b), true.get(k, 0) + len(a)
    for k in hit:
        assert hit[k] >= 0.95 * true[k] and hit[k] >= 0.95 * found[k], (k, hit[k], found[k], true[k])


def test_look_alikes_and_forms(redactor):
    none = ["주문번호 805963-6066043 은 MG-1483 로 바뀌었습니다.", "장비 주소는 10.231.18.86 이고 품번은 01-7925-3744-C 입니다.", "내선 6752 번은 구매계약팀 공용입니다.", "계약번호 2026-0767-9809 승인", "010-88-609 belongs to the backup pool.",
            "담당: 총무팀 / 성명 칸은 비워 두고 @ 기호도 쓰지 않습니다.", "과장 이상 결재, 대리 이하는 열람만 합니다.", "", "전산실 공사로 1차 점검은 32주 늦어집니다."]
    assert redactor.find(none) == [[] for _ in none]
    text = "담당자: 한다완 / 연락처: (051) 003-7564 / 메일: torvin(at)dodam.example"
    (spans,) = redactor.find([text])
    assert redact(text, spans) == "담당자: [PERSON] / 연락처: [PHONE] / 메일: [EMAIL]"
    text = "신청인 최새, ０１０８０１－３３９５２６０, 주소 한빛도 햇살구 고운빛길 61 9층."
    assert redact(text, redactor.find([text])[0]) == "신청인 [PERSON], [ID_NUMBER], 주소 [ADDRESS]."
    text = "Visitor Tamsel Lorrimay showed Passport No. M77805920 at the gate."
    assert redact(text, redactor.find([text])[0]) == "Visitor [PERSON] showed Passport No. [ID_NUMBER] at the gate."


def test_tables(spark, rows):
    c = spark.createDataFrame([("c:1", "문의 ☎ 010-1234-5678", 1)] * 2 + [("c:2", None, 1), ("c:3", "", 1), ("c:4", "가나 다라. " * 30000 + "회신은 a.b@c.example 로", 1)], "chunk_id string, text string, place int")
    p = spark.createDataFrame([(7, {"comments": "김보들님, 점검표 확인 부탁드려요.", "title": "김보들님"}), (8, None), (9, {"description": None})], "part_id bigint, metadata map<string,string>")
    got = rows(found_personal(c, p))
    assert got == [("comments", "7", 1, "person"), ("text", "c:1", 6, "phone"), ("text", "c:4", 210005, "email")]
    out = {r.record_id: r.text for r in redacted(c, p).collect()}
    assert out["c:1"] == "문의 ☎ [PHONE]" and out["7"].startswith("[PERSON]님") and out["c:3"] == ""
    assert found_personal(c.limit(0), p.limit(0)).count() == 0


def test_long_addresses_begin_at_their_first_word(redactor):
    place = "가나다라마바시 가나다라마바군 가나다라마바읍 가나다라마바사로 12"
    text = f"택배는 {place} 로, 받는 분은 김하늘 입니다."
    (spans,) = redactor.find([text])
    assert ("address", place) in {(k, text[s:e]) for s, e, k in spans}
    assert redact(text, spans).startswith("택배는 [ADDRESS] 로")


# Written by hand, not made from the templates of the fit.
UNSEEN = [
    ("어제 김도연 씨에게서 온 편지를 보관함에 넣었습니다.", [("person", "김도연")]),
    ("Rückfragen bitte an petra.k@solbit.invalid richten.", [("email", "petra.k@solbit.invalid")]),
    ("공구를 빌린 사람은 박서준 대리(010-3321-8876)로 확인됩니다.", [("person", "박서준"), ("phone", "010-3321-8876")]),
    ("보험 서류에 적힌 주민등록번호 880412-2345678 은 지워 주세요.", [("id_number", "880412-2345678")]),
    ("자료실이 푸른시 나래구 은하수길 45 로 옮겼습니다.", [("address", "푸른시 나래구 은하수길 45")]),
    ("대표 전화는 02-345-6789 하나뿐입니다.", [("phone", "02-345-6789")]),
    ("다음 분기 예산은 12,345,678원이고 문서 번호는 2024-1182 입니다.", []),
    ("서버 10.20.30.40 의 버전을 3.11.2 로 올렸습니다.", []),
    ("홍보실과 감사실이 정리 기준을 함께 정했습니다.", []),
    ("The release 4.12.0 fixes 17 defects in the calendar feed.", []),
]


def test_sentences_not_made_from_the_templates(redactor):
    hit = found = true = 0
    for (text, want), got in zip(UNSEEN, redactor.find([t for t, _ in UNSEEN]), strict=True):
        have = {(k, text[s:e]) for s, e, k in got}
        hit, found, true = hit + len(have & set(want)), found + len(have), true + len(want)
    assert hit >= 0.85 * true and hit >= 0.85 * found, (hit, found, true)


def test_thresholds_come_from_unseen_templates(redactor):
    assert len(set(redactor.thresholds.tolist())) > 1 and (redactor.thresholds > 0.1).all()
    assert len(labelled(200, 3, 0, 4)) == 200
