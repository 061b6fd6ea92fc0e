import json

from seogo.kb import KnowledgeBase
from seogo.settings import Settings
from seogo.sources.datasource import register


def test_links_as_a_data_source(spark, tmp_path):
    pages = [{"url": f"https://h.example/{i}", "body": f"<title>쪽 {i}</title><body><p>글 {i}</p><table><tr><th>a<th>b<tr><td>1<td>2</table>", "headers": {"content-type": "text/html"}} for i in range(20)]
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in pages), encoding="utf-8")
    register(spark)
    urls = "\n".join(p["url"] for p in pages) + "\nhttps://h.example/0\nhttps://other.example/x\nftp://h.example/y"
    df = spark.read.format("seogo_links").option("urls", urls).option("replay", str(path)).option("perPartition", "6").option("allowed_hosts", "h.example").load()
    rows = df.collect()
    good = [r for r in rows if r.error is None]
    assert len(good) == 20 and len(rows) == 22 and {r.source_type for r in good} == {"web"} and df.rdd.getNumPartitions() == 4
    assert [b.text for b in next(r for r in good if r.source_name == "쪽 7").blocks] == ["글 7", "| a | b |\n|---|---|\n| 1 | 2 |"]
    kb = KnowledgeBase(spark, "links", Settings.in_session())
    assert kb.ingest(df).filter("error is null and chunk_count = 1").count() == 20 and kb.search("쪽 7", 1)[0]["citation"].startswith("웹: 쪽")
    assert spark.read.format("seogo_links").load().count() == 0
