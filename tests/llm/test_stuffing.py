import random

from seogo.llm import stuffing
from seogo.llm.stuffing import class_sequence, found_junk, genre, page_scores

TEAMS = ["총무팀", "재무팀", "인사팀", "감사실", "홍보실", "연구지원실"]


def honest(r, n):
    kind = n % 5
    s = lambda: r.choice([
        f"{r.choice(TEAMS)}은 2025년 {r.randrange(1, 13)}월 {r.randrange(1, 29)}일부터 새 게시판을 대상으로 점검을 진행하며 보관 기한은 {r.randrange(9, 400)}일로 정했습니다.",
        f"용량이 부족해 자료 이관은 {r.randrange(1, 13)}월로 옮기고, 응답 시간은 {r.choice(TEAMS)}이 관리합니다.",
        f"On {r.randrange(1, 28)} May 2024 the data desk moved {r.randrange(9, 400)} folders from the backup queue to the central wiki space.",
        f"Die Prüfstelle hat {r.randrange(9, 400)} Einträge geprüft; die Rückgabe entfällt am {r.randrange(1, 28)}. März.",
    ])
    if kind == 0:
        return "| 항목 | 값 | 담당 |\n|---|---|---|\n" + "\n".join(f"| RG-{r.randrange(1000, 9999)} | {r.randrange(9, 400)} | {r.choice(TEAMS)} |" for _ in range(12))
    if kind == 1:
        return "차례\n" + "\n".join(f"{k}.1 {r.choice(TEAMS)} 담당 업무 ........ {2 * k + 3}" for k in range(1, 25))
    return "안내\n\n" + " ".join(s() for _ in range(12))


def junk(r, n):
    words = r.sample(["사무실 청소", "복합기 임대", "명함 인쇄", "문서 파쇄", "정수기 렌탈", "간판 시공", "중고 노트북"], 4)
    kind = n % 4
    if kind == 0:
        return " ".join(words[0] + r.choice(["", " 가격", " 후기"]) for _ in range(80))
    if kind == 1:
        return "\n".join(f"{r.choice(words)} ▶ https://shop{r.randrange(99)}.example/p/{r.randrange(10**6)}" for _ in range(25))
    if kind == 2:
        return "\n".join(f"★{r.choice(words)}★ 최저가 tel-300 ◆추천◆" for _ in range(25))
    return " | ".join(f"{r.choice(words)} {r.choice(['가격', '후기', '비교'])}" for _ in range(70))


def test_pages(spark):
    r = random.Random(4)
    pages = [(n, honest(r, n)) for n in range(300)] + [(1000 + n, junk(r, n)) for n in range(16)] + [(5000, None), (5001, ""), (5002, "   "), (1000, None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "doc_id bigint, text string, seq string").repartition(4)
    # 300 pages made of four sentences spread wider around their median than a large table: fewer deviations tell them apart
    got = {x.doc_id for x in found_junk(df.union(df), deviations=6).collect()}
    assert got == set(range(1000, 1016)), (sorted(got ^ set(range(1000, 1016))))
    scores = page_scores(df)
    assert scores.filter("doc_id in (5000, 5001, 5002) and excess is not null").count() == 0 and scores.count() == df.count()
    assert found_junk(df.limit(0)).count() == 0 and found_junk(df.filter("text is null")).count() == 0


def test_the_perplexity_decides(spark, monkeypatch):
    r = random.Random(4)
    pages = [(n, honest(r, n)) for n in range(300)] + [(1000 + n, junk(r, n)) for n in range(16)]
    df = spark.createDataFrame(pages, "doc_id bigint, text string").repartition(4)

    class Uniform(stuffing.Models):
        def __init__(self, counts):
            super().__init__(counts)
            self.tables, self.usual = 0 * self.tables + 3.0, 0 * self.usual + 3.0  # all classes alike

    monkeypatch.setattr(stuffing, "Models", Uniform)
    assert found_junk(df, deviations=6).count() == 0


def test_long_page_and_classes():
    seq = class_sequence("요금 정산 " * 300_000)
    assert len(seq) == 600_000 and seq.endswith("QQQQ")
    assert class_sequence("") == "" and class_sequence("\n \n") == ""
    assert genre("HtCHlf.") == 0 and genre("NHHC") == 1 and genre("HKHK") == 2
    assert genre("HHU") is None and genre("QQQQQQf.") is None


def test_scores_of_pages_do_not_depend_on_their_neighbours():
    models = stuffing.Models(stuffing.np.arange(len(stuffing.GENRES) * len(stuffing.ALPHABET) ** 3) % 7)
    pages = ["HtC.", "", "QQQQ/UUU", "H" * 100, "N"]
    alone = [x for p in pages for x in zip(*stuffing.log_perplexities(models, [p]), strict=True)]
    together = list(zip(*stuffing.log_perplexities(models, pages), strict=True))
    assert together[1] == alone[1] == (None, None)
    assert all(abs(a - b) < 1e-9 for x, y in zip(alone, together, strict=True) for a, b in zip(x, y, strict=True) if a is not None)
