"""Queries of ingestion, text and administration operators with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..kb import in_order, totals
from ..kb import list_sources as sources_of
from ..operators.chunking import OVERLAP, SIZE, chunk_blocks, chunk_parts, tails, with_metadata
from ..runtime import read_table, spread
from ..sources.files import paragraphs, parse_files, text_parts
from ..store import BROADCAST_KEYS, ChunkStore


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as stored: of rows that came again the one ingested last. Only ids are shuffled, and the few rows that came again."""
    rows = read_table(spark, sf_dir, "chunks")
    again = rows.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")
    again = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    others = [c for c in rows.columns if c not in ("chunk_id", "ingested_at", "extra")]
    kept = rows.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by(F.struct("ingested_at", *others, "extra"), F.struct(F.coalesce("ingested_at", F.lit("")), F.xxhash64(*others))).alias("r"))
    return rows.join(again, "chunk_id", "left_anti").unionByName(kept.select("chunk_id", "r.*"))


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_of(current_chunks(spark, sf_dir)).select("kb_id", "source_id", "chunk_count", "source_name", "source_type")


def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_of(current_chunks(spark, sf_dir))


def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(current_chunks(spark, sf_dir)).join(read_table(spark, sf_dir, "kb_meta").select("kb_id", "embedder"), "kb_id", "left")


def get_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 chunks over all sources in their order (the limit is the feature)."""
    return in_order(current_chunks(spark, sf_dir), 100).select("source_id", "chunk_index", "chunk_id")


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "chunks").select("source_id", "chunk_id", "text").distinct()
    return rows.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).cast("bigint").alias("char_count"))


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted kinds and page range of every part's blocks, as chunks carry them."""
    rows = read_table(spark, sf_dir, "blocks")
    pages = F.array_agg("page")
    out = rows.groupBy("source_id", "part_ordinal").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("page").alias("page"), F.max("page").alias("last"), F.size(F.array_distinct(F.filter(pages, lambda p: p.isNotNull()))).cast("bigint").alias("page_count"))
    return out.select("source_id", "part_ordinal", "kinds", F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), F.coalesce(F.when(F.col("last") != F.col("page"), F.col("last")), F.lit(0)).cast("bigint").alias("page_end"), "page_count")


def _stored_documents(spark: SparkSession, sf_dir: str, kb_id: str) -> tuple[ChunkStore, DataFrame]:
    """A store of this session in which documents are the chunks of their source."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("source", F.lit("-")).alias("source_id"), "source_type", "title", "text")
    store = ChunkStore(spark, None, "none")
    store.drop(kb_id)
    store.replace_sources(kb_id, docs, docs)
    return store, docs


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ingest through the store: rows of one type replace what is stored of the same sources."""
    store, docs = _stored_documents(spark, sf_dir, "replace")
    incoming = docs.filter("source_type = 'pdf'").withColumn("title", F.concat_ws(" ", F.lit("v2"), "title"))
    store.replace_sources("replace", incoming, incoming)
    return store.get("replace").select(F.col("chunk_id").cast("bigint").alias("doc_id"), "title")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion by metadata leaves in the store."""
    store, _ = _stored_documents(spark, sf_dir, "delete")
    store.delete("delete", {"source_type": {"$in": ["web", "note"]}})
    return store.get("delete").select(F.col("chunk_id").cast("bigint").alias("doc_id"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts into the store, earlier and later rows: of each id the later one stays."""
    rows = read_table(spark, sf_dir, "chunks").select(*(c for c in read_table(spark, sf_dir, "chunks").columns if c != "kb_id"))
    first = rows.groupBy("chunk_id").agg(F.min(F.coalesce("ingested_at", F.lit(""))).alias("first"))
    dated = rows.join(first, "chunk_id")
    store = ChunkStore(spark, None, "none")
    store.drop("upsert")
    store.upsert("upsert", dated.filter("coalesce(ingested_at, '') = first").drop("first"))
    store.upsert("upsert", dated.filter("coalesce(ingested_at, '') <> first").drop("first"))
    return store.get("upsert").select("chunk_id", "ingested_at")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").select("chunk_id", T.clean_text(F.col("text")).alias("cleaned")).distinct()


def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read_table(spark, sf_dir, "chunks").select("chunk_id", T.contextual_text(c("title"), c("file_name"), c("section"), c("subject"), c("text")).alias("contextual")).distinct()


def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").select("chunk_id", T.citation(F.col).alias("citation")).distinct()


def garbled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "blocks").select("block_id", T.looks_garbled(F.col("text")).alias("garbled")).distinct()


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels named by block texts, taken as style names."""
    return read_table(spark, sf_dir, "blocks").select("block_id", T.heading_level(F.col("text")).alias("level")).distinct()


def text_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def overlap_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last sentences of up to 150 characters of every document, as the next chunk would repeat them."""
    return read_table(spark, sf_dir, "documents").select("doc_id", tails(F.col("text")).alias("tail"))


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of every region as one table each."""
    rows = read_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit(None).cast("string"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"], F.lit(""))))
    return rows.select(F.col("n_regionkey").cast("bigint").alias("n_regionkey"), T.markdown_table(grid).alias("markdown"))


def csv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files of 4,000 parts each, written as bytes and parsed: blocks of 40 rows under a repeated header."""
    line = F.concat(F.col("p_partkey"), F.lit(',"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = read_table(spark, sf_dir, "part").select(F.floor((F.col("p_partkey") - 1) / 4000).alias("file"), F.struct("p_partkey", line.alias("line")).alias("x"))
    text = F.concat(F.lit("p_partkey,p_name\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"))
    files = rows.groupBy("file").agg(text.alias("t")).select(F.format_string("part-%s.csv", "file").alias("path"), F.octet_length("t").cast("bigint").alias("length"), F.encode("t", "UTF-8").alias("content"))
    blocks = parse_files(files).select(F.explode("blocks.text").alias("markdown"))
    first = F.regexp_extract("markdown", r"\n\| (\d+) \|", 1).cast("bigint")
    return blocks.select(F.floor((first - 1) / 40).alias("batch"), "markdown")


def link_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").filter("url is not null").select("url", T.link_type(F.col("url")).alias("link_type"), T.url_allowed(F.col("url"), ["saebom.example", "gaon.example"]).alias("allowed")).distinct()


def inherited_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below another part with the subject and sender that their chunks get."""
    parts = read_table(spark, sf_dir, "parts").dropDuplicates(["source_id", "part_ordinal"])
    none = F.lit(None)
    pieces = parts.filter("parent_ordinal is not null").select("source_id", "part_ordinal", F.lit(0).alias("piece_no"), F.col("part_ordinal").cast("string").alias("text"), F.lit(1).alias("char_count"), F.lit("").alias("kinds"), none.cast("string").alias("section"), none.cast("int").alias("page"), none.cast("int").alias("page_end"), none.cast("string").alias("sheet"))
    return with_metadata(pieces, parts).select("source_id", F.col("text").cast("int").alias("part_ordinal"), "subject", "sender")


def chunk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document with a text: chunks beyond the size and the overlap that may stand before a block, numbers that
    are missing, sentences found in no chunk."""
    parts = text_parts(spread(read_table(spark, sf_dir, "documents")), source_id="doc_id", text="text", source_name="title", source_type="source_type")
    chunks = with_metadata(chunk_parts(parts), parts).groupBy(F.col("source_id").cast("bigint").alias("doc_id")).agg(F.count_if(F.col("char_count") > SIZE + OVERLAP + 2).alias("oversized"), (F.max("chunk_index") + 1 - F.count("*")).cast("bigint").alias("gaps"), F.array_agg("text").alias("chunks"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.flatten(F.transform(paragraphs(F.col("text")), T.sentences)).alias("s"))
    lost = F.size(F.filter("s", lambda s: (F.length(s) <= SIZE) & ~F.exists("chunks", lambda c: F.contains(c, s)))).cast("bigint")
    return docs.join(chunks, "doc_id").select("doc_id", "oversized", "gaps", lost.alias("lost"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text_parts(spread(read_table(spark, sf_dir, "documents")), source_id="doc_id", text="text", source_name="title", source_type="source_type")
    return with_metadata(chunk_parts(parts), parts).select("chunk_id", "chunk_index", "char_count", "kinds", "text")


def chunk_mail_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed parts cut into chunks; of parts that came again the one ingested last."""
    rows = read_table(spark, sf_dir, "parts")
    parts = rows.groupBy("source_id", "part_ordinal").agg(F.max_by(F.struct("parent_ordinal", "source_name", "source_type", "metadata"), F.coalesce("ingested_at", F.lit(""))).alias("r")).select("source_id", "part_ordinal", "r.*")
    return with_metadata(chunk_blocks(read_table(spark, sf_dir, "blocks")), parts).select("chunk_id", "source_name", "file_type", "section", "kinds", "page", "subject", "sender", "text")


QUERIES = {
    f.__name__: f
    for f in (
        list_sources, source_overview, kb_stats, get_chunks, ingest_totals, chunk_kinds, replace_source, delete_source, upsert_chunks, clean_text, contextual_text, citation, garbled_pages,
        heading_levels, text_to_blocks, sentence_split, overlap_tail, markdown_table, csv_batches, link_type, inherited_metadata, chunk_check, chunk_documents, chunk_mail_and_files,
    )
}

# ---------------------------------------------------------------------------------- SQL

_WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_CTRL = "[\\x{1}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}\\x{FEFF}\\x{200B}]"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tidy(t: str) -> str:
    """Cleaning of composed text with line feeds."""
    lines = f"array_to_string(list_transform(string_split(regexp_replace({t}, '{_CTRL}', '', 'g'), chr(10)), lambda l: {_strip(chr(32) + 'regexp_replace(l, ' + chr(39) + '[ ' + chr(92) + 't' + chr(92) + 'x{A0}' + chr(92) + 'x{3000}]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), chr(10))"
    return _strip(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _newlines(t: str) -> str:
    return f"replace(replace(nfc_normalize(coalesce({t}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


_SENTENCES = f"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([.!?。…]){_WS}+', '\\1' || chr(1), 'g'), '다\\.', '다.' || chr(1), 'g'), '\\x{{1}}+|\\n+'), lambda s: {_strip('s')}), lambda s: s <> '')"""
_P = "nullif({}, '')"

_SOURCES = """WITH now AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(ingested_at, '') DESC) AS r FROM chunks) WHERE r = 1),
firsts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY kb_id, source_id) AS chunk_count, row_number() OVER (PARTITION BY kb_id, source_id ORDER BY chunk_index, source_name NULLS FIRST, source_type NULLS FIRST) AS nth FROM now) WHERE nth = 1)
"""

SQL: dict[str, str] = {
    "source_overview": _SOURCES + "SELECT kb_id, source_id, source_name, source_type, chunk_count, url, title, author, sender, sender_name, sent_at, subject, ingested_at, space, file_type FROM firsts",
    "list_sources": _SOURCES + "SELECT kb_id, source_id, chunk_count, source_name, source_type FROM firsts",
    "kb_stats": "SELECT c.*, embedder FROM (SELECT kb_id, count(DISTINCT chunk_id) AS chunk_count, count(DISTINCT source_id) AS source_count FROM chunks GROUP BY ALL) c LEFT JOIN kb_meta USING (kb_id)",
    "get_chunks": "SELECT DISTINCT source_id, chunk_index, chunk_id FROM chunks ORDER BY source_id, chunk_index, chunk_id LIMIT 100",
    "chunk_check": "SELECT doc_id, 0::BIGINT AS oversized, 0::BIGINT AS gaps, 0::BIGINT AS lost FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')",
    "ingest_totals": "SELECT source_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS char_count FROM (SELECT DISTINCT source_id, chunk_id, text FROM chunks) GROUP BY ALL",
    "chunk_kinds": """SELECT source_id, part_ordinal, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, CAST(coalesce(min(page), 0) AS BIGINT) AS page,
  CAST(coalesce(CASE WHEN max(page) <> min(page) THEN max(page) END, 0) AS BIGINT) AS page_end, count(DISTINCT page) AS page_count FROM blocks GROUP BY ALL""",
    "replace_source": """WITH inc AS (SELECT doc_id, source, concat_ws(' ', 'v2', title) AS title FROM documents WHERE source_type = 'pdf')
SELECT doc_id, title FROM documents d WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.source IS NOT DISTINCT FROM d.source) UNION ALL SELECT doc_id, title FROM inc""",
    "delete_source": "SELECT doc_id FROM documents WHERE NOT coalesce(source_type IN ('web', 'note'), FALSE)",
    "upsert_chunks": "SELECT chunk_id, max(ingested_at) AS ingested_at FROM chunks GROUP BY ALL",
    "clean_text": f"SELECT DISTINCT chunk_id, {_tidy(_newlines('text'))} AS cleaned FROM chunks",
    "contextual_text": """SELECT DISTINCT chunk_id, CASE WHEN head <> '' THEN head || chr(10) || text ELSE text END AS contextual FROM (
  SELECT chunk_id, text, concat_ws(' / ', coalesce(nullif(title, ''), nullif(file_name, '')), nullif(section, ''), nullif(subject, '')) AS head FROM chunks)""",
    "citation": """WITH c AS (SELECT *, coalesce(nullif(file_type, ''), nullif(source_type, ''), '') AS kind, coalesce(nullif(file_name, ''), nullif(source_name, ''), '자료') AS name,
  concat_ws(', ', coalesce(nullif(sender_name, ''), nullif(sender, '')), nullif(substring(sent_at, 1, 10), '')) AS detail FROM chunks)
SELECT DISTINCT chunk_id, CASE WHEN kind IN ('eml', 'msg') THEN '메일 ''' || coalesce(nullif(subject, ''), name) || '''' || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END
  WHEN kind IN ('note', 'chat') THEN name || coalesce(' (' || nullif(substring(created_at, 1, 10), '') || ')', '')
  ELSE concat_ws(' ', CASE kind WHEN 'confluence' THEN '컨플루언스:' WHEN 'nanumi' THEN '나누미:' WHEN 'web' THEN '웹:' END,
    CASE WHEN nullif(parent_name, '') <> name THEN parent_name || ' › ' || name ELSE name END,
    CASE WHEN page > 0 AND kind <> 'xlsx' THEN CASE WHEN kind = 'pptx' THEN '슬라이드 ' ELSE 'p.' END || page || CASE WHEN page_end > page THEN '-' || page_end ELSE '' END END,
    '[' || nullif(sheet, '') || ']') END AS citation FROM c""",
    "garbled_pages": """SELECT DISTINCT block_id, coalesce(len(regexp_extract_all(text, '\\(cid:')) >= 3 OR len(regexp_extract_all(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]')) / greatest(length(text), 1) > 0.05, FALSE) AS garbled FROM blocks""",
    "heading_levels": f"""WITH b AS (SELECT block_id, lower({_strip("coalesce(text, '')")}) AS n FROM blocks)
SELECT DISTINCT block_id, CAST(CASE WHEN n IN ('title', '제목') THEN 1 WHEN regexp_matches(n, '^(?:heading|제목|개요|outline){_WS}*\\d') THEN greatest(1, least(6, CAST(regexp_extract(n, '^(?:heading|제목|개요|outline){_WS}*(\\d)', 1) AS INT))) ELSE 0 END AS INT) AS level FROM b""",
    "text_to_blocks": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(chr(10) || replace(nfc_normalize(coalesce(text, '')), chr(13) || chr(10), chr(10)), '\\n[ \\t\\x{{A0}}\\x{{3000}}]*(?:\\n[ \\t\\x{{A0}}\\x{{3000}}]*)+'), lambda x: {_tidy("replace(x, chr(13), chr(10))")}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)""",
    "sentence_split": f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents))",
    "overlap_tail": f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS l FROM documents),
e AS (SELECT doc_id, l, i, list_sum(list_transform(l[i:], lambda x: length(x))) + len(l) - i AS used FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s))
SELECT s.doc_id, coalesce(array_to_string(s.l[k.i:], ' '), '') AS tail FROM s LEFT JOIN (SELECT doc_id, min(i) AS i FROM e WHERE used <= 150 GROUP BY ALL) k USING (doc_id)""",
    "markdown_table": """SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY ALL""",
    "csv_batches": """SELECT CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS batch, '| p_partkey | p_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY ALL""",
    "link_type": """WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^\\w+://([^/:?#]+)', 1)) AS host FROM chunks WHERE url IS NOT NULL)
SELECT url, CASE WHEN contains(host, 'atlassian.net') OR contains(host, 'confluence') OR regexp_matches(url, '/wiki/spaces/|/display/|viewpage\\.action') THEN 'confluence' WHEN contains(host, 'nanumi') THEN 'nanumi' ELSE 'web' END AS link_type,
  regexp_matches(lower(url), '^https?://') AND host <> '' AND (host IN ('saebom.example', 'gaon.example') OR host LIKE '%.saebom.example' OR host LIKE '%.gaon.example') AS allowed FROM u""",
    "inherited_metadata": """WITH p AS (SELECT DISTINCT source_id, part_ordinal, parent_ordinal, nullif(metadata['subject'], '') AS subject, nullif(metadata['sender'], '') AS sender FROM parts)
SELECT DISTINCT c.source_id, c.part_ordinal, coalesce(c.subject, a.subject) AS subject, coalesce(c.sender, a.sender) AS sender FROM p c LEFT JOIN p a ON a.source_id = c.source_id AND a.part_ordinal = c.parent_ordinal WHERE c.parent_ordinal IS NOT NULL""",
}
