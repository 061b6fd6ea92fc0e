from seogo.llm.mail import Line, authored_lines, authored_texts, found_unwritten, parse_mail


def own(text, sender="김하나"):
    lines = [Line(0, k, t) for k, t in enumerate(text.split("\n"), 1)]
    return [x.text for x in authored_lines(parse_mail(lines, sender))]


def test_top_posting_with_signature_device_and_notice():
    mail = "안녕하세요.\n새 글입니다.\n감사합니다.\n--\n김하나\n총무팀 | 회사\n내 휴대전화에서 보냄\n본 메일은 지정된 수신인만을 위한 것입니다.\nOn Sat, Apr 5, 2025 at 1:57 PM 박둘 <a@b> wrote:\n> 옛 글\n> 감사합니다."
    assert own(mail) == ["안녕하세요.", "새 글입니다.", "감사합니다."]


def test_forward_without_marks_goes_to_the_end():
    for head in ("---------- Forwarded message ---------\nFrom: A <a@b>\nSent: Tue\nTo: B\nSubject: x", "보낸 사람: A <a@b>\n보낸 날짜: 2024년 5월 3일\n받는 사람: B\n제목: x", "-----Original Message-----", "=== 원문 ===\n발신: A\n일시: 2025.06.27 03:46\n수신: B"):
        assert own(f"새 글입니다.\n확인 부탁드립니다.\n{head}\n옛 글입니다.\n고맙습니다.\n--\nA") == ["새 글입니다.", "확인 부탁드립니다."]
        assert own(f"새 글입니다.\n{head}\n옛 글입니다.") == ["새 글입니다."]


def test_earlier_mail_without_any_introduction():
    assert own("답장이 늦었습니다.\n새 글.\nCheers,\n늘 고생이 많으십니다.\n옛 글.\n검토 부탁드립니다.") == ["답장이 늦었습니다.", "새 글.", "Cheers,"]


def test_answers_between_quoted_lines_and_wrapped_quotes():
    inline = "> 첫 질문은 여기까지입니다.\n첫 답입니다.\n> 둘째 질문은 여기까지입니다.\n둘째 답입니다.\n감사합니다."
    assert own(inline) == ["첫 답입니다.", "둘째 답입니다.", "감사합니다."]
    wrapped = "Am 8.10.2025 um 03:30 schrieb 박둘:\n| 이 문장은 너무 길어서 메일 프로그램이\n여기서 줄을 바꾸었습니다.\n| 다음 줄.\n새 글입니다.\n감사합니다."
    assert own(wrapped) == ["새 글입니다.", "감사합니다."]


def test_layout_look_alikes_stay():
    mail = "CAUTION: This e-mail came from outside the organisation.\n메뉴 위치: 설정 > 사용 빈도 > 대기 인원\n> 설정 > 모바일 문서 보관함 > 색인 상태 순서로 여세요.\n신청서에는 아래처럼 적어 주세요.\n제목: 요금 정산 신청\n기간: 4월 14일부터\n----------\n백업 주기: 278건\n----------\n--split-queues 59\n보낸 사람: 칸이 비어 있으면 반려됩니다.\n검토 부탁드립니다.\n김하나 드림"
    assert own(mail) == mail.split("\n")[1:-1]


def test_nested_quotes_deep_and_long():
    deep = "\n".join(">" * k + " 옛 글" for k in range(1, 200))
    assert own("새 글.\n감사합니다.\n" + deep) == ["새 글.", "감사합니다."]
    assert len(own("줄입니다.\n" * 30000 + "감사합니다.")) == 30001


SCHEMA_B = "block_id bigint, source_id string, part_ordinal int, pos int, text string, kind string, sender string, line string"
SCHEMA_P = "source_id string, part_ordinal int, depth int, source_type string, metadata map<string,string>, text string"


def test_tables_with_repeats_nulls_and_other_types(spark, rows):
    part = ("s", 0, 0, "eml", {"sender_name": "김하나"}, "x")
    blocks = [(2, "s", 0, 2, "감사합니다.\n김하나 드림", "paragraph", "x", "y"), (1, "s", 0, 1, "새 글", "paragraph", "x", "y"), (0, "s", 0, 0, "제목: 머리", "meta", "", ""), (3, "s", 0, 3, None, "paragraph", "", ""), (9, "t", 0, 0, "> 아님", None, "", ""), (10, "u", 0, 0, "> 인용", None, "", "")]
    b = spark.createDataFrame(blocks * 2, SCHEMA_B)
    p = spark.createDataFrame([part, part, ("t", 0, 0, "pdf", None, None), ("u", 0, 0, "msg", None, None), ("s", 1, 1, "eml", {}, None)], SCHEMA_P)
    got = rows(found_unwritten(b, p))
    assert got == [(10, 1), (2, 2), (3, 1)]
    assert rows(authored_texts(b, p)) == [(1, "새 글"), (2, "감사합니다.")]
    assert found_unwritten(b.limit(0), p).count() == 0 and found_unwritten(b, p.limit(0)).count() == 0


def test_requests_in_the_middle_do_not_end_the_text():
    assert own("새 글입니다.\n확인 부탁드립니다.\n그리고 내일 회의는 3시입니다.\n자료는 제가 가져갑니다.") == ["새 글입니다.", "확인 부탁드립니다.", "그리고 내일 회의는 3시입니다.", "자료는 제가 가져갑니다."]
    assert own("A question.\nThanks\nOne more thing. The hall is closed.\nBest regards,\n김하나\n총무팀") == ["A question.", "Thanks", "One more thing. The hall is closed.", "Best regards,"]


def test_name_above_a_long_quotation_is_a_signature():
    quoted = "\n".join(f"> 옛 글 {k}입니다." for k in range(12))
    assert own(f"새 글입니다.\n김하나 대리\nT. 02-000-0000\nOn Sat, Apr 5, 2025 at 1:57 PM 박둘 <a@b> wrote:\n{quoted}") == ["새 글입니다."]
    assert own("일정을 맞추었습니다.\n김하나 외 두 명 참석\n회의는 3시에 시작합니다.") == ["일정을 맞추었습니다.", "김하나 외 두 명 참석", "회의는 3시에 시작합니다."]


def test_many_closings_in_one_mail_stay_fast():
    assert len(own("한 줄입니다.\n감사합니다.\n" * 20000)) > 0
