"""Labelled sentences for the personal-information classifier, made from templates.

Placeholders of personal kinds are labelled spans; the others fill in ordinary things that look alike
(order numbers, part numbers, network addresses, teams, extensions, menu words). Names and places are
invented; the share of each template is even.
"""

from __future__ import annotations

import re
from random import Random

# Korean family names, one and two syllables.
FAMILY = "김이박최정강조윤장임한오서신권황안송류홍유전고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예경봉사부가복태목형피두감호음빈동온"
FAMILY_TWO = ["남궁", "제갈", "선우", "황보", "독고", "사공", "서문", "동방"]
COMMON_FAMILY = "김이박최정강조윤장임한오서신권황안송류홍표탁봉"
GIVEN = "가나다라마바사아자하서지민준현우진연수영은정해미소유태도예찬슬새초보여결람늘봄빛샘솔율온완휘롬린별들묵담겸"
TITLES = "과장 대리 사원 주임 선임 책임 부장 차장 팀장 파트장 연구원 주무관 실장 이사 교수 매니저".split()
FIRST = "Anna Brenda Carl Dorian Elena Fergus Greta Henrik Isolde Jonas Karin Lorenz Mira Nils Oona Pavel Rosa Stellan Tilda Ugo Vera Wendel Yara Zeno Livvy Maro Hestor Quilla".split()
LAST = "Aldermoor Brackett Copperfield Dunsany Ellingham Farrow Grimsby Hollis Ingram Jessop Kestrel Lindqvist Marlow Northcote Oakes Penhallow Quentin Ravensworth Stroud Thackeray Underhill Varley Whitlock Yardley Zeller".split()
TEAMS = "총무팀 재무팀 인사팀 감사실 홍보실 정보보안팀 시설관리팀 디자인파트 구매계약팀 연구지원실 기록관리파트 교육기획팀 법무팀 영업부 고객지원팀".split()
THINGS = "요금 정산|계약 갱신|재고 조사|보안 교육|성능 측정|자료 이관|인증서 갱신|문서 폐기|권한 신청|업무 인계".split("|")
ITEMS = "점검표 회의록 일정표 비용 명세서 결과 보고서 운영 매뉴얼 업무정의서".split()
EN_TEAMS = "support crew|data desk|planning board|archive staff|audit cell|web group|finance desk|onboarding team".split("|")
EN_ITEMS = "storage limit|queue length|label text|seat plan|risk list|cost sheet|release note".split("|")
CITIES = "가람시 너울시 한빛도 푸른시 은별시 미리내시 여울도 새봄시 단비시 늘푸른시 해솔시 강마루시".split()
AREAS = "햇살구 나래구 바람군 솔빛구 달빛군 하늘구 이슬구 윤슬구 새싹군 중구".split()
STREETS = "도담로 새벽별로 가온대로 참새미로 물푸레길 고운빛길 안개꽃로 모래내울길 느티나무로 은하수길 별마루로".split()
VILLAGES = "도담동 산들동 미르동 꽃샘동 아라동 온새미리 별내울동 해맑은리".split()
HOSTS = "maru.test gaon.example mail.daon.example example.org neoul.test solbit.invalid dodam.example".split()
# Ordinary words that begin like family names.
WORDS = (
    "기준 예산 문제 설명회 안내 명단 신청 조사 이용 정보 서식 권한 조건 주소 전화 변경 공용 고장 임시 주말 장비 문서 방문 오전 오후 표시 표준 구매 연구 계정 계약 대상 현장 원격 신규 안내문 이력 장애 서명 주문 최종 최저가 정리 정산 조정 강사료 배포 "
    "송장 유지 전원 고객 양식 손실 배송 백업 허가 심사 노후 성능 차세대 구성 민원 지하 진단 원칙 방법 공사 현재 변환기 추가 도장 소식 설정 마이크 길이 연장 위험 표본 명세서 기록 반납 금액 옥상 인쇄 제출 여부 은행 편성 용량 예외 경로 봉투 사내 가격 복구 목록 형식 감사 "
    "빈도 동쪽 홍보실 감사실 연구지원실 인사팀 총무팀 정보보안팀 구매계약팀 기록관리파트 전산실 서버실 교육장 회의실 신청자 담당자 관리자 이용자 참석자 인수자 조합원 위원회 추진단 사업부 주무부서 이사회 정기 분기 연간 공동 사전 사후 나머지 마무리 우선 전날 점심 반드시 감지기 판독기 기준 수집기 안내서 문의처 전달 주기 유형 구분 이름 성격 정도 방향 국내 노선 조명 현황 민간 장소 한도 안전 전체"
).split()

TEMPLATES = """
담당자: {name} / 연락처: {phone} / 메일: {email}
담당: {team} / 성명 칸은 비워 두고 @ 기호도 쓰지 않습니다.
성명: {name}, 소속 {team}
신청인 {name}, {idword} {id}, 주소 {addr}.
신청인 {name}, {id}, 주소 {addr}.
신청인 결과와 담당 범위를 확인합니다.
강사료 지급용 {idword} {id}, 성명 {name} 확인 완료.
강사료 지급용 {id}, 성명 {name} 확인 완료.
입금자명 {name}이 신청서와 달라 {idword} {id} 앞자리로 대조했습니다.
방문 등록을 위해 {idword} {id} 를 적어 두었으나 2022년 5월 20일 이후 삭제합니다.
방문 등록을 위해 {id} 를 적어 두었으나 2022년 5월 20일 이후 삭제합니다.
입금자명 {name}이 신청서와 달라 {id} 앞자리로 대조했습니다.
본인 확인에 쓴 {id} 는 기록하지 않습니다.
처리 시각 값은 {epoch} 로 기록되었습니다.
기록 {epoch} 에서 오류가 났고 {order} 를 다시 보냈습니다.
{name} 씨가 {thing} 문제를 먼저 알려 왔고, 번호는 {phone} 입니다.
{name} 님께서 2021년 7월 8일에 장비를 반납하셨습니다.
{name}님, {item} 확인 부탁드려요. 급하면 {phone}
자세한 내용은 {team} {name} {title}({phone})에게 문의해 주세요.
문의 ☎ {phone} ✉ {email}
회신은 {email} 또는 {phone} 로 부탁드립니다.
긴급 시 {phone}, 야간에는 {phone} 로 전화합니다.
휴가 중에는 {name}에게 연락하세요 ({phone}, {email}).
{thing}은 {name} {title}이 맡고, 자료는 {email} 로 보냅니다.
계정 발급 대상은 {name}({email})이며 게시판 권한만 줍니다.
지난 6월 3일 민원인 {name}의 댁({addr})에 책상을 전달했다.
택배는 {addr} 로, 받는 분은 {name} 입니다.
현장은 {addr} 이며 도착하면 {phone} 로 전화 주세요.
이사한 곳은 {addr} 이고 집 전화는 없습니다.
{item} 원본은 {addr} 에 있는 창고로 보내 주세요.
{addrbare} 구간 공사 소식은 홍보실 게시물을 보세요.
작성 {name} · 검토 {name} · 2021년 4월 15일
인계자 {name} → 인수자 {name}, 입회 {name} {title}.
인계자 회의와 인수자 교육은 {team} 담당입니다.
참석: {name} {title}, {name} {title}, {name} {title}
참석: 총무팀 과장, 재무팀 대리, 외부 위원
{name}: {thing} 끝났나요? / {name}: 네, 8월 22일에 올렸습니다.
회의: 요금 정산 끝났나요? / 답변: 네, 8월 22일에 올렸습니다.
3층 회의실 열쇠는 {team}({name})에 있습니다.
3층 회의실 열쇠는 {team}(사무실)에 있습니다.
{team} {name}입니다. {item}를 첨부합니다.
{team} 서식입니다. 신청 조건을 첨부합니다.
{code} 건으로 {name} {title}과 통화했고 보관 기한은 보류합니다.
{code} 건으로 서식 번호를 확인했고 보관 기한은 보류합니다.
{thing} 명단
- {name} ({phone})
- {name} ({phone})
- {name} (번호 없음)
- 신청 결과 (번호 없음)
- 조사 일정 (2층)
- 서식 번호: 안내문을 고친 뒤 공유합니다.
- 이용 문의가 185건 들어왔고 대부분 접속 오류와 관련되어 정리했습니다.
| {name} | {title} | {phone} | {email} |
| 서식 번호 | 신형 책상 | 정보보안팀 | 고장 난 노트북 |
| 예외 목록 | 정리 | 이력 | 조건 |
| {code} | 인사팀 | 신형 | 공용 |
과장 이상 결재, 대리 이하는 게시판에서 열람만 합니다.
내선 {short} 번은 {team} 공용입니다.
내선 {short} 번으로 거세요. 서식은 공용입니다.
장비 주소는 {ip} 이고 품번은 {part} 입니다.
주문번호 {order} 은 {code} 로 바뀌었습니다.
주문번호: {order}
송장 {order} 확인 부탁드립니다.
{contract} 승인이 끝나 신형 책상을 설치했습니다.
계약번호 {contract2} 건은 {item}에 적힌 대로 처리합니다.
{short3} belongs to the shared calendar feed.
The part no. {short3} belongs to the regional access log.
응답 시간이 바뀌면 {item}와 안내문을 함께 고쳐야 바르게 나타납니다.
{team}에서 받은 {item} 243부는 남문 초소에 두고 이력을 붙여 둡니다.
정보보안팀은 2025년 3월 2일부터 {thing}을 진행하며 서식 번호는 보류합니다.
사용 빈도로 12개를 나누고 {thing}은 한 달에 138번만 합니다.
민원 창구 공사로 2차 점검은 32주 늦어지며 이력은 그대로 둡니다.
3층 상담실 공사로 30일 동안 권한 신청을 받지 않습니다.
공용 게시판의 담당 범위로 44건을 나누고 자동으로 330건을 처리합니다.
전산실 공사로 1차 점검은 32주 늦어지며 이력만 따로 적습니다.
신형 복합기 구입비 82,458,359원은 {code}에 반영했습니다.
이용자가 늘어 조사 결과는 2021년 9월 27일로 옮기고, 권한은 우선 인사팀이 관리합니다.
연휴가 끼어 있어 서명은 {team} 대신 홍보실이 합니다.
따라서 신규 게시판을 빌리려면 서식을 내려받아 신청합니다.
조사 대상: 신형 책상, 공용 마이크, 노후 도장
문의: 이용 안내, 신청 절차, 장애 신고
작성일 2021년 3월 2일 · 검토 중 · 보류
전화 {phone}
연락처 {phone}
H.P. {phone}
주민등록번호 {id}
주소: {addr}
이메일: {email}
{team}과 {word}은 정기 검수를 나누어 맡고 {item}를 보냅니다.
{team} {word}은 다음 주에 정합니다.
{team} {word}이 바뀌었습니다.
{team}에서 {word}를 열고 {item}를 나누어 드립니다.
{word} {word}은 {code}를 따르되 게시판에서는 보류합니다.
{word}: {word}, {word}
{word}: {team}
| {word} | {word} | {word} |
| {code} | 11,049,494원 | {word} | {short} |
| 2025년 4월 3일 | {team} | {word} |
| {item} | {word} | 반납된 도장 |
- {word}
- {word} ({word})
{word}
파일 이름 {word}은 {code}를 따르되 {team}과 협의합니다.
- 파일 이름 {word}은 {contract}에 맞춥니다.
대여용 온습도 {word} 이력을 {item}에 적습니다.
| {code} | 대여용 온습도 {word} | {word} |
담당: {team} / 검토: {team}
{word} 관리 {word}
참석 {word} · 검토 {word}
작성 {word}, {word}
{thing} {word}은 82,458,359원이며 그중 10%는 {word}입니다.
{thing} 결과 10건에서 {word}가 나와 {word}로 옮깁니다.
{team}({word})에 있는 {word}의 {word}입니다.
{word} 담당 과장, {word} 담당 대리
{word} → {word}, {word} / {word}
{word}에게 {word}를 묻고 {word} ({short}) 번으로 겁니다.
Contact: {latin}, {email}, {phone}
Signed: {latin} / witnessed: {name} / 18 November 2019
cc {latin} <{email}>; call {phone} before 17 January 2026.
According to {latin}, the {enitem} needs a second look.
Please ask {latin} from the {enteam} or call {phone}.
Please ask the {enteam} or use extension {short}.
I spoke with {latin} about {code}; the number is {phone}.
I spoke with the {enteam} about {code}; the number is {code}.
The applicant, {latin}, gave {enid} and lives at {enaddr}.
Visitor {latin} showed {enid} at the gate.
The keys of {enaddr} were left with {latin} and {latin}.
Ship the draft {enitem} to {enaddr}, attention {latin}.
Mr. {latin} handed the keys over on 3 November 2025.
Ms. {latin} will call back tomorrow.
Mail {email} if the {enitem} is wrong.
The {enteam} and the {enteam} share the final review until 2 March 2020.
On 27 June 2022 the {enteam} moved 191 folders from the backup upload form.
Request {code} was sent back, although the {enteam} had signed the {enitem}.
New Staff read the Printed Guide first and join the Monthly Review.
Open Point: Release v3.21.38 of the staging queue changed the {enitem}.
Kind Regards, the Planning Board
Main Street is closed and Market Lane stays open.
Rules for the Storage Limit > Notes on the Monthly Handover
Data Desk | Support Crew | Finance Desk
Die Netzgruppe hat 178 Einträge geprüft; die Buchhaltung weiß Bescheid.
Für das neue Suchverzeichnis ist die Alte Aktenstelle zuständig.
Bitte fragen Sie {latin} oder schreiben Sie an {email}.
Ansprechpartner: {latin}, Tel. {phone}
Im Neuen Archiv liegen 12 Bände; Vorgang {code} ist geprüft.
Der Weg 3 und die Straße 7 sind gesperrt.
""".strip().splitlines()


def _pick(r: Random, xs):  # noqa: ANN001, ANN202
    return xs[r.randrange(len(xs))]


def _digits(r: Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def name(r: Random) -> str:
    family = _pick(r, FAMILY_TWO) if r.random() < 0.15 else _pick(r, COMMON_FAMILY if r.random() < 0.85 else FAMILY)
    return family + "".join(_pick(r, GIVEN) for _ in range(1 if r.random() < 0.06 else 2))


def phone(r: Random) -> str:
    a, b = _digits(r, 4), _digits(r, 4)
    kind = r.randrange(14)
    sep = _pick(r, ["-", "-", "-", ".", " "])
    if kind < 5:
        text = f"010{sep}{a}{sep}{b}"
    elif kind == 5:
        text = f"010{a}{b}"
    elif kind == 6:
        text = _pick(r, [f"+82 10 {a} {b}", f"+82-10-{a}-{b}", f"+8210{a}{b}"])
    elif kind in (7, 11, 12, 13):
        text = _pick(r, [f"02-{a[:3]}-{b}", f"(02) {a[:3]}-{b}", f"02){a[:3]}-{b}", f"031-{a[:3]}-{b}", f"(051) {a[:3]}-{b}", f"070-{a}-{b}"])
    elif kind == 8:
        text = _pick(r, [f"+1 202 555 {b}", f"(415) 555-{b}", f"303-555-{b}"])
    elif kind == 9:
        text = f"02-{a}-{b}"
    else:
        text = f"+49 30 {_digits(r, 3)} {b}"
    return _wide(r, text)


def _wide(r: Random, text: str) -> str:
    if r.random() < 0.05:
        return text.translate(str.maketrans("0123456789-", "０１２３４５６７８９－"))
    if r.random() < 0.05:
        return text.replace("-", "–")
    return text


def email(r: Random) -> str:
    user = _pick(r, ["kim.mk", "lee72", "park-fin", "choi_hs", "anna+work", "jung732", "dkwon-hq"])
    host = _pick(r, HOSTS)
    form = r.randrange(8)
    if form == 0:
        return f"{user}(at){host}"
    if form == 1:
        return f"{user} [at] {host.replace('.', ' [dot] ')}"
    if form == 2:
        return f"{user}{_pick(r, ['＠', ' @ '])}{host}"
    return (user + "@" + host).upper() if form == 3 else f"{user}@{host}"


def identity(r: Random) -> str:
    kind = r.randrange(5)
    if kind < 3:
        birth = f"{r.randrange(100):02d}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"
        return _wide(r, birth + _pick(r, ["-", "-", "-", " - ", ""]) + str(r.randrange(1, 9)) + _digits(r, 6))
    if kind == 3:
        return f"{r.randrange(11, 29)}-{_digits(r, 2)}-{_digits(r, 6)}-{_digits(r, 2)}"
    return "M" + (_digits(r, 8) if r.random() < 0.7 else _digits(r, 3) + _pick(r, "ABCDE") + _digits(r, 4))


def address(r: Random) -> str:
    place = f"{_pick(r, CITIES)} {_pick(r, AREAS)} "
    if r.random() < 0.06:
        place = ""
    if r.random() < 0.5:
        side = f"{r.randrange(2, 60)}길" if r.random() < 0.4 else ""
        street = f"{_pick(r, STREETS)}{side} {r.randrange(1, 500)}" + (f"-{r.randrange(1, 90)}" if r.random() < 0.3 else "")
        return place + street + _pick(r, ["", "", " 5층", ", 119동 2002호", " (산들동)"])
    return place + f"{_pick(r, VILLAGES)} {r.randrange(1, 900)}" + (f"-{r.randrange(1, 90)}" if r.random() < 0.5 else "") + _pick(r, ["번지", ""])


def english_address(r: Random) -> str:
    if r.random() < 0.5:
        return f"{r.randrange(1, 950)} {_pick(r, ['Larkhaven', 'Bellfrost', 'Tarn Hollow', 'Ostwick', 'Mill Pond'])} {_pick(r, ['Lane', 'Street', 'Road', 'Ave.', 'Avenue', 'Drive'])}, {_pick(r, ['Ostwick', 'Marrowby', 'Tellford Vale'])}"
    return f"{_pick(r, ['Birkenauer Weg', 'Tannfelder Straße', 'Lindgrabengasse', 'Oberer Platz', 'Hauptstraße', 'Am Ring'])} {r.randrange(1, 200)}, 0{_digits(r, 4)} {_pick(r, ['Oberlindau', 'Tannfeld', 'Wiesenkrug'])}"


def _order(r: Random) -> str:
    first = f"{_digits(r, 2)}{r.randrange(13, 99):02d}{_digits(r, 2)}" if r.random() < 0.9 else _digits(r, 6)
    return first + "-" + _pick(r, "0679") + _digits(r, 6)


_ORDINARY = {
    "team": lambda r: _pick(r, TEAMS), "thing": lambda r: _pick(r, THINGS), "item": lambda r: _pick(r, ITEMS), "title": lambda r: _pick(r, TITLES),
    "code": lambda r: f"{_pick(r, ['DX', 'KE', 'MN', 'RG'])}-{_digits(r, 4)}", "idword": lambda r: _pick(r, ["주민번호", "주민등록번호", "식별번호", "운전면허번호", "면허", "여권번호", "여권:", "주민번호:"]),
    "short": lambda r: _digits(r, 4), "short3": lambda r: f"010-{_digits(r, 2)}-{_digits(r, 3)}", "ip": lambda r: f"10.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}",
    "part": lambda r: f"01-{_digits(r, 4)}-{_digits(r, 4)}-{_pick(r, 'ABC')}", "order": _order, "epoch": lambda r: f"1{r.randrange(56, 80)}{_digits(r, 10)}",
    "contract": lambda r: f"제{r.randrange(2019, 2027)}-{_digits(r, 4)}호", "contract2": lambda r: f"{r.randrange(2019, 2027)}-{_digits(r, 4)}-{_digits(r, 4)}",
    "word": lambda r: _pick(r, WORDS), "addrbare": lambda r: _pick(r, STREETS), "enteam": lambda r: _pick(r, EN_TEAMS), "enitem": lambda r: _pick(r, EN_ITEMS),
}
_PERSONAL = {
    "name": (name, "person"), "phone": (phone, "phone"), "email": (email, "email"), "id": (identity, "id_number"), "addr": (address, "address"), "enaddr": (english_address, "address"),
    "latin": (lambda r: f"{_pick(r, FIRST)} {_pick(r, LAST)}", "person"),
}


def labelled(count: int, seed: int = 7, fold: int | None = None, folds: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts with (start, end, type) of their personal spans; the same for the same seed. With ``fold`` only
    every ``folds``-th template, from that one on, is used."""
    r, out = Random(seed), []
    templates = TEMPLATES if fold is None else TEMPLATES[fold::folds]
    for _ in range(count):
        text, spans = "", []
        for k in range(r.randrange(1, 4)):
            text += ("" if not k else _pick(r, [" ", "\n", "\n\n"]))
            for part in re.split(r"(\{\w+\})", _pick(r, templates)):
                key = part[1:-1]
                if part.startswith("{") and key == "enid":
                    text += _pick(r, ["passport ", "Passport No. ", "SSN ", "social security number "])
                    value = f"9{_digits(r, 2)}-{_digits(r, 2)}-{_digits(r, 4)}" if text.endswith(("SSN ", "number ")) else "M" + _digits(r, 8)
                    spans.append((len(text), len(text) + len(value), "id_number"))
                elif part.startswith("{") and key in _PERSONAL:
                    make, kind = _PERSONAL[key]
                    value = make(r)
                    spans.append((len(text), len(text) + len(value), kind))
                elif part.startswith("{"):
                    value = _ORDINARY[key](r)
                else:
                    value = part
                text += value
        out.append((text, spans))
    return out
