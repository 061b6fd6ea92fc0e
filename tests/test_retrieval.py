import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seogo.functions import text as T
from seogo.functions.embedding import HashingEmbedder, embed, get_embedder, sparse_features
from seogo.operators import retrieval as R
from seogo.operators.filters import combined, compile_where
from seogo.operators.synonyms import DEFAULT_GROUPS, Synonyms

DOCS = [("1", "홈페이지 담당자는 김철수 대리입니다.", "a.pdf"), ("2", "ERP 권한 신청은 정보보안팀에서 받습니다. ERP ERP", None), ("3", "Vièle 2026 월 대금 지급", "비용.xlsx"), ("4", "", None), ("5", None, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("kb", i, t, f, i) for i, t, f in DOCS], "kb_id string, chunk_id string, text string, file_name string, source_id string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "kb", "홈페이지 담당자는 누구인가요"), ("q2", "kb", "ERP 권한"), ("q3", "kb", "!!"), ("q4", "kb", "없는말만")], "query_id string, kb_id string, query string")


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_tokens_and_units(spark):
    tok = lambda t: one(spark, T.tokens(F.lit(t)))
    assert tok("한국어 나 ERP e 7 v_2") == ["한국어", "한국", "국어", "나", "erp", "7", "v_2"] and tok("Vièle") == ["vi", "le"] and tok("") == []
    assert tok("한글") == ["한글", "한글"]
    unit = lambda t: set(one(spark, T.content_units(F.lit(t))))
    assert unit("권한은 어떻게 신청하나요") == {"권한", "신청"} and "회의" in unit("회의 참석자") and {"erp", "10"} <= unit("ERP 10월") and unit("") == set()


def test_bm25_against_the_formula(chunks, asked):
    index = R.build_index(chunks)
    got = {(r.query_id, r.chunk_id): r.score for r in R.bm25(index, asked).collect()}
    bodies = {r.chunk_id: Counter(r.t) for r in chunks.select("chunk_id", T.tokens(R.index_body(chunks)).alias("t")).collect()}
    n, avg = len(bodies), sum(sum(b.values()) for b in bodies.values()) / len(bodies)
    df = Counter(t for b in bodies.values() for t in b)
    want = {}
    for q in asked.select("query_id", T.tokens(F.col("query")).alias("t")).collect():
        for d, b in bodies.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.4 / (b[t] + 1.4 * (0.25 + 0.75 * sum(b.values()) / avg)) for t in set(q.t) if b[t])
            if s:
                want[q.query_id, d] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    allowed = chunks.filter("chunk_id = '2'").select("kb_id", "chunk_id")
    assert {r.chunk_id: r.score for r in R.bm25(index, asked, allowed).collect()}["2"] == pytest.approx(want["q2", "2"])


def test_relevance_and_coverage(chunks, asked, spark):
    index = R.build_index(chunks)
    got = {(r.query_id, r.chunk_id): r.relevance for r in R.relevance(index, asked, R.bm25(index, asked)).collect()}
    assert got["q1", "1"] > 0.8 and got["q2", "2"] == 1.0
    pairs = spark.createDataFrame([("q3", "kb", "1"), ("q4", "kb", "1")], "query_id string, kb_id string, chunk_id string")
    assert {r.query_id: r.relevance for r in R.relevance(index, asked, pairs).collect()} == {"q3": 0.0, "q4": 0.0}
    assert one(spark, R.coverage(F.lit("ERP 권한"), F.lit("erp only"), F.lit(None).cast("string"))) == 0.5 and one(spark, R.coverage(F.lit("!"), F.lit("x"))) == 0.0


def test_fusion_and_limits(spark, chunks, asked):
    a = spark.createDataFrame([("q1", "kb", "1", 1), ("q1", "kb", "2", 2)], "query_id string, kb_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q1", "kb", "2", 1), ("q1", "kb", "3", 2)], a.schema)
    fused = R.fuse([a, b])
    assert {r.chunk_id: round(r.fused, 9) for r in fused.collect()} == {"1": round(1 / 61, 9), "2": round(1 / 61 + 1 / 62, 9), "3": round(1 / 62, 9)}
    swapped = {r.chunk_id: r.fused for r in R.fuse([b, a]).collect()}
    assert swapped == {r.chunk_id: r.fused for r in fused.collect()}
    rel = fused.select("query_id", "kb_id", "chunk_id", F.when(F.col("chunk_id") == "2", 0.1).otherwise(0.9).alias("relevance"))
    order = lambda **o: [r.chunk_id for r in R.finish(fused, rel, chunks, asked, **{"top_k": 5, **o}).orderBy("position").collect()]
    assert order() == ["2", "1", "3"] and order(only_relevant=True) == ["1", "3"] and order(top_k=1) == ["2"]
    same = chunks.withColumn("source_id", F.lit("s"))
    assert [r.chunk_id for r in R.finish(fused, rel, same, asked, top_k=5, per_source_limit=1).collect()] == ["2"]


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[7] = 0
    x[9] = x[8]  # a tie
    df = spark.createDataFrame([("k" if i % 3 else "l", f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "kb_id string, chunk_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([("a", "k", x[8].tolist()), ("b", "l", x[30].tolist()), ("c", "none", x[3].tolist())], "query_id string, kb_id string, embedding array<float>")
    got = R.vector_search(df, q, 6).orderBy("query_id", "rank").collect()
    x = x.astype(np.float32).astype(float)
    for name, kb, row in (("a", 1, 8), ("b", 0, 30)):
        ids = [i for i in range(300) if bool(i % 3) == bool(kb)]
        sim = {i: float(x[i] @ x[row] / ((np.linalg.norm(x[i]) or 1) * np.linalg.norm(x[row]))) for i in ids}
        want = sorted(ids, key=lambda i: (-round(sim[i], 12), f"{i:03d}"))[:6]
        mine = [r for r in got if r.query_id == name]
        assert [int(r.chunk_id) for r in mine][2:] == want[2:] and {int(r.chunk_id) for r in mine} == set(want)
        assert all(abs(r.similarity - sim[int(r.chunk_id)]) < 1e-6 for r in mine)
    assert not [r for r in got if r.query_id == "c"] and R.vector_search(df, q.limit(0), 3).count() == 0
    assert R.vector_search(df, q, 3, df.filter("chunk_id = '010'").select("kb_id", "chunk_id")).count() == 1


def test_hash_vectors_native_and_python_agree(spark):
    texts = ["홈페이지 담당자 나 ERP erp 2026", "", None, "a", "나"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sparse = {}
    for r in sparse_features(df, "i", "t").collect():
        sparse.setdefault(r.i, {})[r.idx] = r.val
    e = HashingEmbedder()
    for i, t in enumerate(texts):
        v = e.vector(t)
        if i in sparse:
            assert all(abs(v[k] - x) < 1e-6 for k, x in sparse[i].items()) and len(sparse[i]) == int((v != 0).sum())
        else:
            assert v[0] == 1 and abs(v).sum() == 1
    h = zlib.crc32(b"w:a")
    assert e.vector("a")[h % 1024] == (1.0 if h >> 31 else -1.0)
    assert [round(x, 6) for x in df.select(embed(F.col("t")).alias("v")).first().v] == [round(float(x), 6) for x in e.vector(texts[0])]
    assert get_embedder("default").name == "hash-ngram-v1"
    with pytest.raises(ValueError):
        get_embedder("other")


def test_where(spark):
    df = spark.createDataFrame([("1", "a", 1, {"k": '"x"', "n": "1"}), ("2", None, 2, {"k": "x"}), ("3", "b", None, {})], "id string, s string, n int, extra map<string,string>")
    hit = lambda w: [r.id for r in df.filter(compile_where(df, w)).orderBy("id").collect()]
    assert hit({"s": "a"}) == ["1"] and hit({"s": {"$ne": "a"}}) == ["2", "3"] and hit({"s": {"$in": ["a", "b"]}}) == ["1", "3"] and hit({"s": {"$nin": ["a"]}}) == ["2", "3"]
    assert hit({"$or": [{"s": "a"}, {"n": 2}]}) == ["1", "2"] and hit({"$and": [{"s": "a"}, {"n": {"$ne": 1}}]}) == [] and hit({"s": "a", "n": 1}) == ["1"]
    assert hit({"missing": {"$ne": "z"}}) == ["1", "2", "3"] and hit({"missing": "z"}) == [] and hit({"n": "1"}) == [] and hit({"k": "x"}) == ["1", "2"] and hit({"n": {"$in": [1, 2], "$ne": 2}}) == ["1"] and hit(None) == ["1", "2", "3"]
    for bad in ({"s": {"$gt": 1}}, {"$not": {}}):
        with pytest.raises(ValueError):
            compile_where(df, bad)
    assert combined(None) is None and combined({"a": 1}) == {"a": 1} and combined(None, ["pdf"], ["s"]) == {"$and": [{"source_type": {"$in": ["pdf"]}}, {"source_id": {"$in": ["s"]}}]}


def test_synonyms(spark, tmp_path):
    s = Synonyms([["대금", "비용"], ["비용", "요금"], ["하나"], ["A", " a ", "b"]])
    assert s.groups == [["대금", "비용", "요금"], ["a", "b"]]
    for text in ("월 대금 지급", "무관", "A만", "", None):
        assert one(spark, s.expansion(F.lit(text))) == s.expand(text)
    assert set(s.expand("월 대금 지급").split()) == {"비용", "요금"} and s.expand("무관") == ""
    before = s.version
    s.remove_term("b")
    s.add_group(["x", "y"])
    assert s.groups == [["대금", "비용", "요금"], ["x", "y"]] and s.version == before + 2 and bool(s) and not Synonyms()
    path = tmp_path / "d" / "s.json"
    kept = Synonyms(s.groups, path)
    kept.save()
    again = Synonyms.load(path)
    assert again.groups == s.groups and again.signature == s.signature and not Synonyms.load(tmp_path / "none.json")
    import os

    path.write_text("{bad")
    os.utime(path, (1, 1))
    again.refresh()
    assert again.groups == s.groups
    with pytest.raises(ValueError):
        Synonyms.load(path)
    path.write_text('[["p", "q"]]')
    os.utime(path, (2, 2))
    again.refresh()
    assert again.groups == [["p", "q"]] and len(Synonyms(DEFAULT_GROUPS).groups) == 9
    with pytest.raises(ValueError):
        Synonyms().save()
