"""Queries of the retrieval operators with their SQL counterparts.

``documents`` is one knowledge base and ``eval_items.question`` the query set; ``chunks`` holds many knowledge
bases and ``embeddings`` plain vectors. Scores are rounded to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.embedding import HashingEmbedder, embed, sparse_vectors
from ..functions.text import content_units, tokens
from ..operators import retrieval as R
from ..operators.evaluation import accepted_share, compare_embedders, fitted_threshold, hit_rates
from ..operators.filters import compile_where
from ..operators.synonyms import DEFAULT_GROUPS, Synonyms
from ..runtime import kept, read_table, spread, written

TOP, POOL = 10, 20


def as_chunks(documents: DataFrame) -> DataFrame:
    """Documents as chunks of one knowledge base: the id as text, title and source as metadata."""
    return documents.select(F.lit("default").alias("kb_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", "title", F.col("source").alias("source_id"), "source_type", "lang", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("file_name"))


def questions(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("query_id"), F.lit("default").alias("kb_id"), F.col("question").alias("query"))


def _index(spark: SparkSession, sf_dir: str, synonyms: Synonyms | None = None) -> tuple[DataFrame, DataFrame, R.Index]:
    """Chunks, questions and the index, whose tables are made once a session and data folder."""
    docs = as_chunks(read_table(spark, sf_dir, "documents"))
    built = R.build_index(docs, synonyms)
    mark = "-synonyms" if synonyms else ""
    ready = R.Index(**{name: kept(docs, name + mark, lambda name=name: getattr(built, name)) for name in R.Index.KEPT})
    # frequencies are small and read by every query
    ready.__dict__.update({name: kept(docs, name + mark, lambda name=name: getattr(R.Index(postings=ready.postings, units=ready.units), name)) for name in ("token_df", "unit_df")})
    return docs, questions(read_table(spark, sf_dir, "eval_items")), ready


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index made anew: postings with lengths."""
    return R.build_index(as_chunks(read_table(spark, sf_dir, "documents"))).postings.select("chunk_id", "token", "tf", "length")


def _six(c: str):  # noqa: ANN202
    return F.round(c, 6).alias(c)


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index = _index(spark, sf_dir)
    return index.lengths.join(index.corpus, "kb_id").select("chunk_id", "length", _six("avgdl"))


def df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index = _index(spark, sf_dir)
    return index.token_df.join(index.corpus, "kb_id").select("token", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def content_unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index = _index(spark, sf_dir)
    return index.unit_df.select("unit", "df")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, index = _index(spark, sf_dir)
    scored = R.bm25(index, asked).withColumn("score", F.round("score", 6))
    return R.ranked(scored, "score", TOP).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def bm25_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked, index = _index(spark, sf_dir)
    allowed = docs.filter(compile_where(docs, {"$or": [{"source_type": {"$in": ["pdf", "docx"]}}, {"lang": {"$ne": "ko"}}]})).select("kb_id", "chunk_id")
    scored = R.bm25(index, asked, allowed).withColumn("score", F.round("score", 6))
    return R.ranked(scored, "score", TOP).select("query_id", "chunk_id", "score")


def synonym_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, index = _index(spark, sf_dir, Synonyms(DEFAULT_GROUPS))
    scored = R.bm25(index, asked).withColumn("score", F.round("score", 6))
    return R.ranked(scored, "score", TOP).select("query_id", "chunk_id", "score")


def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", Synonyms(DEFAULT_GROUPS).expansion(F.col("text")).alias("expansion"))


def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, index = _index(spark, sf_dir)
    best = R.ranked(R.bm25(index, asked).withColumn("score", F.round("score", 6)), "score", TOP)
    return R.relevance(index, asked, best).select("query_id", "chunk_id", _six("relevance"))


def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked, index = _index(spark, sf_dir)
    best = R.ranked(R.bm25(index, asked).withColumn("score", F.round("score", 6)), "score", TOP)
    rows = best.join(docs, ["kb_id", "chunk_id"]).join(asked, ["query_id", "kb_id"])
    return rows.select("query_id", "chunk_id", F.round(R.coverage(F.col("query"), F.col("text"), F.col("section"), F.col("file_name")), 6).alias("coverage"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.lit("default").alias("kb_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.lit("default").alias("kb_id"), "embedding")
    return vectors, asked


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return R.vector_search(vectors, asked, TOP).select("query_id", "chunk_id", F.round("similarity", 5).alias("similarity"))


def vector_topk_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    allowed = vectors.filter(compile_where(vectors, {"label": {"$nin": [0, 1]}})).select("kb_id", "chunk_id")
    return R.vector_search(vectors, asked, TOP, allowed).select("query_id", "chunk_id", F.round("similarity", 5).alias("similarity"))


def similarity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the one before it: the lookup form, pairs given by id."""
    rows = read_table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, R.Index, DataFrame]:
    """Two rankings of the same candidates: by BM25 and by relevance, as stand-ins of the search legs."""
    docs, asked, index = _index(spark, sf_dir)
    by_score = written(R.ranked(R.bm25(index, asked).withColumn("score", F.round("score", 6)), "score", 4 * TOP), "by-score")
    rel = R.relevance(index, asked, by_score).withColumn("relevance", F.round("relevance", 6))
    by_rel = R.ranked(rel, "relevance", 2 * TOP)
    fused = written(R.fuse([by_score, by_rel]).withColumn("fused", F.round("fused", 9)), "fused")
    return docs, asked, index, fused


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, fused = _legs(spark, sf_dir)
    return fused.select("query_id", "chunk_id", F.round("fused", 6).alias("fused"))


def _fused_results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:  # noqa: ANN003
    docs, asked, index, fused = _legs(spark, sf_dir)
    rel = R.relevance(index, asked, fused).withColumn("relevance", F.round("relevance", 6))
    out = R.finish(fused, rel, docs, asked, top_k=5, **options)
    return out.select("query_id", F.col("position").cast("bigint").alias("position"), "chunk_id", "relevance", "relevant")


def fused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_results(spark, sf_dir)


def fused_only_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_results(spark, sf_dir, only_relevant=True)


def fused_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_results(spark, sf_dir, per_source_limit=1)


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, R.Index, DataFrame]:
    """The legs of the search, fused: hashed vectors (kept as a table, as a knowledge base keeps them) and BM25."""
    docs, asked, index = _index(spark, sf_dir)
    head = F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.col("text"))
    vectors = kept(docs, "vectors", lambda: spread(docs.select("kb_id", "chunk_id", head.alias("head"))).select("kb_id", "chunk_id", embed(F.col("head")).alias("embedding")))
    near = R.vector_search(vectors, asked.select("query_id", "kb_id", embed(F.col("query")).alias("embedding")), POOL, digits=5)
    words = R.ranked(R.bm25(index, asked).withColumn("score", F.round("score", 6)), "score", POOL)
    return docs, asked, index, written(R.fuse([near, words]).withColumn("fused", F.round("fused", 9)), "fused")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: hashed vectors and BM25, fused, with relevance."""
    docs, asked, index, fused = _hybrid(spark, sf_dir)
    out = R.finish(fused, R.relevance(index, asked, fused), docs, asked, top_k=5)
    return out.select("query_id", F.col("position").cast("bigint").alias("position"), "chunk_id", _six("fused"), _six("relevance"), "relevant")


def eval_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of the whole search by set of questions."""
    docs, asked, index, fused = _hybrid(spark, sf_dir)
    found = R.finish(fused, R.relevance(index, asked, fused), docs, asked, top_k=TOP).select("query_id", F.col("position").alias("rank"), "text")
    items = read_table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "item_set", "expected_regex")
    return hit_rates(found, items).select("item_set", "questions", _six("hit_1"), _six("hit_3"), _six("mrr"))


#: Widths of hashed vectors that are compared; models are compared the same way where their library is installed.
COMPARED = {"hash-1024": HashingEmbedder(1024), "hash-256": HashingEmbedder(256)}


def eval_embedders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of the vector leg alone, by embedder and set of questions."""
    docs, asked = as_chunks(read_table(spark, sf_dir, "documents")), questions(read_table(spark, sf_dir, "eval_items"))
    items = read_table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "item_set", "expected_regex")
    return compare_embedders(docs, asked, items, COMPARED, TOP).select("embedder", "item_set", "questions", _six("hit_1"), _six("hit_3"), _six("mrr"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_vectors(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "idx", _six("val"))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(BM25 results with their texts, the best relevance of every question)"""
    docs, asked, index = _index(spark, sf_dir)
    best = R.ranked(R.bm25(index, asked).withColumn("score", F.round("score", 6)), "score", TOP)
    top = R.relevance(index, asked, best).groupBy("query_id").agg(F.round(F.max("relevance"), 6).alias("best"))
    items = read_table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "item_set", F.col("expected_regex").isNotNull().alias("answerable"))
    return best.join(docs.select("chunk_id", "text"), "chunk_id"), items.join(top, "query_id", "left")


def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per set: questions, found among the first 1 and 3, mean reciprocal rank, by the answer pattern."""
    results, _ = _judged(spark, sf_dir)
    items = read_table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "item_set", "expected_regex")
    return hit_rates(results, items).select("item_set", "questions", _six("hit_1"), _six("hit_3"), _six("mrr"))


THRESHOLDS = [t / 10 for t in range(2, 8)]


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For thresholds of relevance: the share of questions with and without an answer that are accepted."""
    return accepted_share(_judged(spark, sf_dir)[1], THRESHOLDS).select("threshold", "answerable", "questions", _six("accepted"))


def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold fitted on the sets dev and heldout, judged on test."""
    return fitted_threshold(_judged(spark, sf_dir)[1], THRESHOLDS).select("threshold", _six("fitted"), _six("held_out"))


def where_and_or_ne_nin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    where = {"$and": [{"$or": [{"source_type": "web"}, {"lang": {"$nin": ["ko", "en"]}}]}, {"source": {"$ne": "board-main"}, "n_chars": {"$ne": 0}}]}
    return docs.filter(compile_where(docs, where)).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, doc_length, df_idf, content_unit_stats, bm25_topk, bm25_where, synonym_bm25, synonym_expand, relevance_topk, coverage_topk, vector_topk, vector_topk_where,
        similarity_lookup, rrf_fuse, fused_results, fused_only_relevant, fused_per_source, hybrid_search, eval_hybrid, eval_embedders, hash_embed, index_build, eval_hits, threshold_sweep, threshold_fit, where_and_or_ne_nin,
    )
}

# ---------------------------------------------------------------------------------- SQL

_ENDINGS = "인가요|입니까|이에요|입니다|하는지|한가요|되나요|있나요|했나요|하나요|에서는|나요|인가|했나|하나|받나|나면|에게|에서|까지|부터|으로|에는|에도|이란|인지|이며"
_QUESTION = "'어떻게','언제','누구','누가','얼마','어디','어디에','무엇','무슨','몇','어떤','방법','절차','알려줘','알려','주세요','하','되','있','없','안','누'"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize(coalesce({text}, ''))), '[가-힣]+|[a-zA-Z][a-zA-Z0-9_]*|\\p{{Nd}}+')"


def _pairs(w: str) -> str:
    return f"list_transform(range(1, length({w})), lambda i: substring({w}, i, 2))"


def sql_tokens(text: str) -> str:
    return f"""flatten(list_transform({_words(text)}, lambda w: CASE WHEN regexp_matches(w, '^[가-힣]') THEN
      CASE WHEN length(w) = 1 THEN [w] ELSE list_concat([w], {_pairs('w')}) END
      WHEN length(w) > 1 OR regexp_matches(w, '^\\p{{Nd}}$') THEN [w] ELSE []::VARCHAR[] END))"""


def sql_units(text: str) -> str:
    bare = f"""CASE WHEN regexp_matches(w, '^.+?({_ENDINGS})$') THEN left(w, length(w) - length(regexp_extract(w, '^.+?({_ENDINGS})$', 1)))
      WHEN length(w) >= 3 AND contains('은는이가을를에의로도와과만', right(w, 1)) THEN left(w, length(w) - 1) ELSE w END"""
    return f"""list_distinct(flatten(list_transform(list_transform(list_filter({_words(text)}, lambda w: regexp_matches(w, '^[가-힣]') OR length(w) > 1 OR regexp_matches(w, '^\\p{{Nd}}$')),
      lambda w: CASE WHEN regexp_matches(w, '^[가-힣]') THEN {bare} ELSE w END),
      lambda w: CASE WHEN NOT regexp_matches(w, '^[가-힣]') THEN [w] WHEN w = '' OR w IN ({_QUESTION}) THEN []::VARCHAR[] WHEN length(w) = 1 THEN [w] ELSE {_pairs('w')} END)))"""


_LOW = "lower(nfc_normalize(b))"


def _expansion(text: str) -> str:
    low = f"lower(nfc_normalize(coalesce({text}, '')))"
    groups = [
        f"CASE WHEN {' OR '.join(f'contains({low}, {t!r})' for t in g)} THEN list_filter({g!r}, lambda t: NOT contains({low}, t)) ELSE []::VARCHAR[] END"
        for g in map(sorted, DEFAULT_GROUPS)
    ]
    return f"array_to_string(flatten([{', '.join(groups)}]), ' ')"


def _base(body: str = "'   ' || coalesce(title, '') || ' ' || coalesce(text, '')", expand: bool = False) -> str:
    inner = f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {body} AS b FROM documents"
    if expand:
        inner = f"SELECT chunk_id, b || ' ' || {_expansion('b')} AS b FROM ({inner})"
    return f"""body AS ({inner}),
toks AS (SELECT chunk_id, unnest({sql_tokens('b')}) AS token FROM body),
postings AS (SELECT chunk_id, token, count(*) AS tf FROM toks GROUP BY ALL),
lengths AS (SELECT b.chunk_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS length FROM body b LEFT JOIN postings p USING (chunk_id) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lengths),
dfs AS (SELECT token, count(*) AS df FROM postings GROUP BY ALL),
units AS (SELECT chunk_id, unnest({sql_units('b')}) AS unit FROM body),
unit_dfs AS (SELECT unit, count(*) AS df FROM units GROUP BY ALL),
asked AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest({sql_tokens('question')}) AS token FROM eval_items),
scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * length / avgdl))), 6) AS score
  FROM asked JOIN dfs USING (token) JOIN postings USING (token) JOIN lengths USING (chunk_id), corpus GROUP BY ALL)"""


_RANKED = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {k})"
_RELEVANCE = f"""qu AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest({sql_units('question')}) AS unit FROM eval_items),
qw AS (SELECT query_id, qu.unit, ln(1 + n / (coalesce(df, 0) + 0.5)) AS w FROM qu LEFT JOIN unit_dfs USING (unit), corpus),
totals AS (SELECT query_id, sum(w) AS total FROM qw GROUP BY ALL)"""


def _relevance_of(name: str, source: str) -> str:
    return f"""{name} AS (SELECT c.query_id, c.chunk_id, round(coalesce(any_value(h.had) / any_value(total), 0.0), 6) AS relevance
  FROM (SELECT DISTINCT query_id, chunk_id FROM {source}) c LEFT JOIN totals USING (query_id)
  LEFT JOIN (SELECT query_id, chunk_id, sum(w) AS had FROM qw JOIN units USING (unit) GROUP BY ALL) h USING (query_id, chunk_id) GROUP BY ALL)"""


_FUSED = f"""WITH {_base()}, {_RANKED.format(k=40)}, {_RELEVANCE}, {_relevance_of('rel0', 'best')},
second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS rank FROM rel0) WHERE rank <= 20),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(r1) AS r1, min(r2) AS r2 FROM (
  SELECT query_id, chunk_id, rank, rank AS r1, NULL AS r2 FROM best UNION ALL SELECT query_id, chunk_id, rank, NULL, rank FROM second) GROUP BY ALL)"""


def _results(condition: str = "TRUE", per_source: bool = False) -> str:
    order = "fused DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST, chunk_id"
    source = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY {order}) AS nth FROM kept) WHERE nth <= 1" if per_source else "SELECT * FROM kept"
    return f"""{_FUSED}, {_relevance_of('rel', 'fused')},
kept AS (SELECT f.*, relevance, relevance >= 0.4 AS relevant, source FROM fused f JOIN rel USING (query_id, chunk_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.chunk_id WHERE {condition}),
limited AS ({source})
SELECT query_id, position, chunk_id, relevance, relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM limited) WHERE position <= 5"""


_COSINE = "list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _nearest(condition: str) -> str:
    return f"""SELECT query_id, chunk_id, round(s, 5) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(a.vec_id AS VARCHAR) AS chunk_id, {_COSINE} AS s FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND {condition})) WHERE r <= 10"""


# CRC-32 of text as bytes; features of hashed vectors, per text (k, t), with their norms. Texts without any are the first axis.
_CRC = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _hashed(name: str, source: str) -> str:
    grams = lambda n: f"list_transform(range(1, length(w) + 4 - {n}), lambda i: 'g:' || substring('<' || w || '>', i, {n}))"
    digit = lambda at: f"(instr('0123456789ABCDEF', substring(h, {at}, 1)) - 1)"
    return f"""{name}_w AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest({_words('t')}) AS w FROM ({source})) GROUP BY ALL),
{name}_f AS (SELECT k, f, sum(n * CASE WHEN regexp_matches(w, '^[가-힣]') THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END) AS w FROM (
  SELECT k, n, w, unnest(CASE WHEN regexp_matches(w, '^[가-힣]') THEN flatten([['w:' || w], {grams(2)}, {grams(3)}]) ELSE ['w:' || w] END) AS f FROM {name}_w) GROUP BY ALL),
{name}_h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM (
  SELECT f, list_transform(range(length(h) // 2), lambda i: ({digit('2 * i + 1')} * 16 + {digit('2 * i + 2')})::BIGINT) AS b FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM {name}_f)), tab),
{name}_e AS (SELECT k, (h % 1024)::INT AS idx, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END * (1 + ln(w))) AS v FROM {name}_f JOIN {name}_h USING (f) GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM {name}_e GROUP BY ALL),
{name} AS (SELECT k, idx, v / norm AS val FROM {name}_e JOIN {name}_n USING (k) WHERE abs(v) > 1e-9
  UNION ALL SELECT k, 0, 1.0::DOUBLE FROM ({source}) s LEFT JOIN {name}_n USING (k) WHERE coalesce(norm, 0) < 1e-9)"""


_HYBRID = f"""WITH {_base()}, {_RANKED.format(k=20)}, {_RELEVANCE}, {_CRC},
{_hashed('dv', "SELECT CAST(doc_id AS VARCHAR) AS k, concat_ws(chr(10), nullif(title, ''), text) AS t FROM documents")},
{_hashed('qv', "SELECT CAST(item_id AS VARCHAR) AS k, question AS t FROM eval_items")},
sims AS (SELECT q.k AS query_id, d.k AS chunk_id, coalesce(round(any_value(s), 5), 0) AS s FROM (SELECT DISTINCT k FROM qv) q CROSS JOIN (SELECT DISTINCT k FROM dv) d
  LEFT JOIN (SELECT qv.k AS a, dv.k AS b, sum(qv.val * dv.val) AS s FROM qv JOIN dv USING (idx) GROUP BY ALL) x ON x.a = q.k AND x.b = d.k GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM sims) WHERE rank <= 20),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(r1) AS r1, min(r2) AS r2 FROM (
  SELECT query_id, chunk_id, rank, rank AS r1, NULL AS r2 FROM near UNION ALL SELECT query_id, chunk_id, rank, NULL, rank FROM best) GROUP BY ALL),
{_relevance_of('rel', 'fused')},
placed AS (SELECT f.*, relevance, relevance >= 0.4 AS relevant, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST, f.chunk_id) AS position FROM fused f JOIN rel USING (query_id, chunk_id))"""

SQL: dict[str, str] = {
    "hash_embed": f"WITH {_CRC}, {_hashed('dv', 'SELECT doc_id AS k, text AS t FROM documents')} SELECT k AS doc_id, idx, round(val, 6) AS val FROM dv",
    "hybrid_search": f"{_HYBRID} SELECT query_id, position, chunk_id, round(fused, 6) AS fused, relevance, relevant FROM placed WHERE position <= 5",
    "eval_hybrid": f"""{_HYBRID}, items AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_set, expected_regex FROM eval_items WHERE expected_regex IS NOT NULL),
hits AS (SELECT query_id, min(position) AS first FROM placed JOIN items USING (query_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunk_id WHERE position <= 10 AND regexp_matches(d.text, expected_regex) GROUP BY ALL)
SELECT item_set, count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM items LEFT JOIN hits USING (query_id) GROUP BY ALL""",
    "index_build": f"WITH {_base()} SELECT chunk_id, token, tf, length FROM postings JOIN lengths USING (chunk_id)",
    "tokenize_counts": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "doc_length": f"WITH {_base()} SELECT chunk_id, length, round(avgdl, 6) AS avgdl FROM lengths, corpus",
    "df_idf": f"WITH {_base()} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, corpus",
    "content_unit_stats": f"WITH {_base()} SELECT unit, df FROM unit_dfs",
    "bm25_topk": f"WITH {_base()}, {_RANKED.format(k=10)} SELECT query_id, chunk_id, score, rank FROM best",
    "bm25_where": f"""WITH {_base()}, allowed AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE coalesce(source_type IN ('pdf', 'docx'), FALSE) OR lang IS DISTINCT FROM 'ko')
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored SEMI JOIN allowed USING (chunk_id)) WHERE rank <= 10""",
    "synonym_bm25": f"WITH {_base(expand=True)}, {_RANKED.format(k=10)} SELECT query_id, chunk_id, score FROM best",
    "synonym_expand": f"SELECT doc_id, {_expansion('text')} AS expansion FROM documents",
    "relevance_topk": f"WITH {_base()}, {_RANKED.format(k=10)}, {_RELEVANCE}, {_relevance_of('rel', 'best')} SELECT query_id, chunk_id, relevance FROM rel",
    "coverage_topk": f"""WITH {_base()}, {_RANKED.format(k=10)}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct({sql_tokens('question')}) AS qt FROM eval_items)
SELECT query_id, chunk_id, round(len(list_intersect(qt, {sql_tokens("coalesce(d.text, '')")})) / len(qt), 6) AS coverage FROM best JOIN q USING (query_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunk_id""",
    "vector_topk": _nearest("TRUE"),
    "vector_topk_where": _nearest("a.label NOT IN (0, 1)"),
    "similarity_lookup": f"SELECT a.vec_id, round({_COSINE}, 5) AS similarity FROM embeddings a JOIN embeddings q ON q.vec_id + 1 = a.vec_id",
    "rrf_fuse": f"{_FUSED} SELECT query_id, chunk_id, round(fused, 6) AS fused FROM fused",
    "fused_results": _results(),
    "fused_only_relevant": _results("relevance >= 0.4"),
    "fused_per_source": _results(per_source=True),
    "eval_hits": f"""WITH {_base()}, {_RANKED.format(k=10)}, items AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_set, expected_regex FROM eval_items WHERE expected_regex IS NOT NULL),
hits AS (SELECT query_id, min(rank) AS first FROM best JOIN items USING (query_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunk_id WHERE regexp_matches(d.text, expected_regex) GROUP BY ALL)
SELECT item_set, count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM items LEFT JOIN hits USING (query_id) GROUP BY ALL""",
    "threshold_sweep": f"""WITH {_base()}, {_RANKED.format(k=10)}, {_RELEVANCE}, {_relevance_of('rel', 'best')}, top AS (SELECT query_id, max(relevance) AS best FROM rel GROUP BY ALL),
each AS (SELECT i.expected_regex IS NOT NULL AS answerable, top.best, t / 10.0::DOUBLE AS threshold FROM eval_items i LEFT JOIN top ON top.query_id = CAST(i.item_id AS VARCHAR), range(2, 8) r(t))
SELECT threshold, answerable, count(*) AS questions, round(avg(CASE WHEN best >= threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS accepted FROM each GROUP BY ALL""",
    "threshold_fit": f"""WITH {_base()}, {_RANKED.format(k=10)}, {_RELEVANCE}, {_relevance_of('rel', 'best')}, top AS (SELECT query_id, max(relevance) AS best FROM rel GROUP BY ALL),
each AS (SELECT item_set, t / 10.0::DOUBLE AS threshold, CASE WHEN (i.expected_regex IS NOT NULL) = coalesce(top.best >= t / 10.0::DOUBLE, FALSE) THEN 1.0::DOUBLE ELSE 0 END AS ok FROM eval_items i LEFT JOIN top ON top.query_id = CAST(i.item_id AS VARCHAR), range(2, 8) r(t))
SELECT threshold, round(avg(ok) FILTER (item_set <> 'test'), 6) AS fitted, round(avg(ok) FILTER (item_set = 'test'), 6) AS held_out FROM each GROUP BY threshold ORDER BY avg(ok) FILTER (item_set <> 'test') DESC, threshold LIMIT 1""",
    "where_and_or_ne_nin": """SELECT doc_id FROM documents WHERE (coalesce(source_type = 'web', FALSE) OR NOT coalesce(lang IN ('ko', 'en'), FALSE))
  AND source IS DISTINCT FROM 'board-main' AND n_chars IS DISTINCT FROM 0""",
}
