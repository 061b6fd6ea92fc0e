import json

import makers
import pytest

from seogo.cli import expand_paths, main
from seogo.kb import KnowledgeBase, get_knowledge_base
from seogo.settings import Settings
from seogo.sources.model import ParseError
from seogo.store import EmbedderMismatch, collection_name
from seogo.streaming.landing import watch_folder


@pytest.fixture()
def kb(spark, tmp_path):
    return KnowledgeBase(spark, "회의 kb/1", Settings.in_session(data_dir=f"file://{tmp_path}/store"))


def test_ingest_search_replace_delete(kb, tmp_path):
    (tmp_path / "요청.eml").write_bytes(makers.eml())
    one = kb.add_file(str(tmp_path / "요청.eml"), source_id="mail")
    assert one["chunk_count"] == 2 and one["attachment_count"] == 1 and one["metadata"]["subject"] == "요청"
    kb.add_text("홈페이지 유지보수 담당자는 김철수 대리입니다. 대금은 매월 25일에 지급합니다.", source_name="메모", source_id="note")
    kb.add_text("ERP 권한 신청은 정보보안팀에서 받습니다.", source_name="대화", source_type="chat", source_id="chat")
    got = kb.search("홈페이지 담당자", 3)
    assert got[0]["source_id"] == "note" and got[0]["relevant"] and got[0]["citation"].startswith("메모 (20") and [r["position"] for r in got] == [1, 2, 3]
    assert got[0]["score"] >= got[1]["score"] and 0 < got[0]["vector_score"] <= 1 and got[0]["keyword_score"] > 0.5
    assert kb.search("요금", only_relevant=True)[0]["source_id"] == "note", "synonyms reach the index"
    assert {r["source_id"] for r in kb.search("홈페이지", source_types=["chat"])} == {"chat"} and {r["source_id"] for r in kb.search("홈페이지", source_ids=["mail"])} == {"mail"}
    assert len(kb.search("본문 내용 요청", per_source_limit=1, source_ids=["mail"])) == 1
    mail = kb.search("붙임 내용")[0]
    assert mail["sender_name"] == "홍길동" and mail["parent_name"] == "요청" and mail["citation"] == "요청 › 붙임.txt"
    assert kb.search("  ") == [] and kb.search("x", 0) == []
    before = kb.stats()
    assert before["source_count"] == 3 and before["chunk_count"] == 4
    kb.add_file(str(tmp_path / "요청.eml"), source_id="mail")
    assert kb.stats() == before and [s.source_id for s in kb.list_sources().collect()][-1] == "mail"
    assert [r.chunk_index for r in kb.get_chunks("mail").collect()] == [0, 1] and kb.get_chunks(limit=1).count() == 1
    assert kb.delete_source("mail") == 2 and kb.delete_source("mail") == 0 and kb.search("붙임 내용", source_ids=["mail"]) == []
    strict = KnowledgeBase(kb.spark, kb.kb_id, Settings(data_dir=kb.settings.data_dir, min_relevance=1.1))
    assert strict.search("홈페이지 담당자", only_relevant=True) == []
    kb.clear()
    assert kb.stats()["chunk_count"] == 0 and kb.search("홈페이지") == []


def test_batch_search_agrees_with_single(kb):
    kb.add_text("가 나 다 라 마\n\n바 사 아", source_name="a", source_id="a")
    kb.add_text("홈페이지 담당자", source_name="b", source_id="b")
    qs = kb.spark.createDataFrame([("1", "홈페이지"), ("2", "가 나"), ("3", " ")], "query_id string, query string")
    rows = kb.search_batch(qs, 2).collect()
    assert {r.query_id for r in rows} == {"1", "2"}
    assert [r.chunk_id for r in sorted((r for r in rows if r.query_id == "1"), key=lambda r: r.position)] == [r["chunk_id"] for r in kb.search("홈페이지", 2)]


def test_errors_and_empty_documents(kb, tmp_path):
    with pytest.raises(ParseError):
        kb.add_file(str(tmp_path / "none.txt"))
    (tmp_path / "big.txt").write_bytes(b"1" * 2048)
    with pytest.raises(ParseError):
        KnowledgeBase(kb.spark, "x", Settings.in_session(max_file_mb=0)).add_file(str(tmp_path / "big.txt"))
    assert kb.add_text(" \n ", source_name="빈")["warnings"] == ["no text was found"]


def test_store_versions_upsert_and_embedder(kb):
    kb.add_text("하나", source_name="a", source_id="a")
    store, first = kb.store, kb.store.version(kb.kb_id)
    row = store.get(kb.kb_id)
    held = row.collect()
    from pyspark.sql import functions as F

    store.upsert(kb.kb_id, row.withColumn("text", F.lit("둘")))
    store.upsert(kb.kb_id, row.withColumn("chunk_id", F.lit("a:0009")))
    assert {r.chunk_id: r.text for r in store.get(kb.kb_id).collect()} == {"a:0000": "둘", "a:0009": "하나"} and store.version(kb.kb_id) != first
    assert store.count("unknown") == 0 and store.delete(kb.kb_id, {"chunk_id": {"$in": ["a:0009"]}}) == 1 and held[0].text == "하나"

    class Other:
        name = "other"
        embed_documents = staticmethod(lambda texts: [[1.0]] * len(texts))
        embed_query = staticmethod(lambda text: [1.0])

    with pytest.raises(EmbedderMismatch):
        KnowledgeBase(kb.spark, kb.kb_id, kb.settings, Other()).add_text("x", source_name="x")
    with pytest.raises(EmbedderMismatch):
        KnowledgeBase(kb.spark, kb.kb_id, kb.settings, Other()).search("x")
    assert collection_name("a b/c") == "kb_a_b_c" and collection_name("!!") == "kb_default"


def test_landing_stream_replaces_what_comes_again(kb, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("첫 글")
    watch_folder(kb, f"file://{folder}", f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    (folder / "b.md").write_text("# 둘째\n글")
    watch_folder(kb, f"file://{folder}", f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    assert kb.stats()["source_count"] == 2


def test_settings_and_module_api(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("SEOGO_CHUNK_SIZE", "no")
    monkeypatch.setenv("SEOGO_ALLOWED_HOSTS", "A.x, b ")
    monkeypatch.setenv("SEOGO_VERIFY_SSL", "off")
    monkeypatch.setenv("SEOGO_MIN_RELEVANCE", "0.5")
    s = Settings()
    assert (s.chunk_size, s.allowed_hosts, s.verify_ssl, s.min_relevance, s.max_file_mb) == (900, ["a.x", "b"], False, 0.5, 50)
    assert len(s.synonym_groups().groups) == 9 and not Settings(synonyms="off").synonym_groups()
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"groups": [["a", "b"]]}))
    assert Settings(synonyms=str(path)).synonym_groups().groups == [["a", "b"]]
    monkeypatch.setenv("SEOGO_DATA_DIR", f"file://{tmp_path}/x")
    assert get_knowledge_base(spark, "k") is get_knowledge_base(spark, "k") is not get_knowledge_base(spark, "k", Settings.in_session())


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SEOGO_DATA_DIR", f"file://{tmp_path}/kb")
    (tmp_path / "a.md").write_text("# 제목\n홈페이지 담당자는 김철수입니다.")
    assert expand_paths([str(tmp_path / "*.md"), "http://x/*"]) == [str(tmp_path / "a.md"), "http://x/*"]
    assert main(["parse", str(tmp_path / "a.md")]) == 0 and "[heading1] 제목" in capsys.readouterr().out
    assert main(["ingest", "demo", str(tmp_path / "a.md"), str(tmp_path / "no.txt")]) == 0 and "1 chunks" in capsys.readouterr().out
    assert main(["search", "demo", "홈페이지 담당자"]) == 0 and "a.md" in capsys.readouterr().out
    assert main(["sources", "demo"]) == 0 and "a.md" in capsys.readouterr().out
    assert main(["chunks", str(tmp_path / "a.md")]) == 0 and "# 제목" in capsys.readouterr().out
    (tmp_path / "b.exe").write_text("")
    assert main(["parse", str(tmp_path / "b.exe")]) == 1


def test_a_change_writes_in_proportion_to_it(kb, tmp_path):
    """Layers: the second ingest writes its own source only, reads see the latest rows, compaction changes nothing."""
    from seogo import store as S

    size = lambda: sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    big = kb.spark.createDataFrame([(f"s{i}:0000", " ".join(f"낱말{i}{k}" for k in range(200)), f"s{i}", 0) for i in range(300)], "chunk_id string, text string, source_id string, chunk_index int")
    kb.store.replace_sources(kb.kb_id, big, big)
    before = size()
    kb.store.replace_sources(kb.kb_id, big.limit(1).withColumn("text", big.text.substr(1, 3)), big.limit(1))
    assert size() - before < before / 5 and kb.store.count(kb.kb_id) == 300
    kb.store.upsert(kb.kb_id, big.filter("source_id = 's7'").withColumn("text", big.source_id))
    assert kb.store.delete(kb.kb_id, {"source_id": "s9"}) == 1
    rows = lambda: sorted((r.chunk_id, r.text) for r in kb.store.get(kb.kb_id).collect())
    held = rows()
    assert len(held) == 299 and ("s7:0000", "s7") in held and sum(len(t) == 3 for _, t in held) == 1
    kb.store.replace_sources(kb.kb_id, big.filter("source_id = 's9'"), big.filter("source_id = 's9'"))
    assert kb.store.count(kb.kb_id) == 300, "what was deleted can come again"
    kb.store.delete(kb.kb_id, {"source_id": "s9"})
    kb.store.compact(kb.kb_id)
    assert rows() == held and len(kb.store.layers(kb.kb_id)) == 1
    for k in range(S.LAYERS + 1):
        kb.store.upsert(kb.kb_id, big.filter("source_id = 's8'"))
    assert len(kb.store.layers(kb.kb_id)) < S.LAYERS and kb.store.count(kb.kb_id) == 299
