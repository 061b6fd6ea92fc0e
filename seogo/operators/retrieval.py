"""Inverted index, BM25, vector search, rank fusion and relevance, for many queries at once.

All statistics are per knowledge base (``kb_id``) and cover it whole; filters apply to candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_units, tokens
from ..runtime import spread, written
from .synonyms import Synonyms

K1, B, RRF_K = 1.4, 0.75, 60
CONTEXT = ("file_name", "section", "subject", "title")
#: Query vectors multiplied at once, and how many such blocks one scan of the vectors serves: 16,384 queries, 64 MB of
#: a broadcast at 1,024 dimensions. Larger query sets take several scans.
QUERY_BLOCK, BLOCKS = 1024, 16
#: Weighted query terms up to this number are broadcast.
BROADCAST_TERMS = 200_000


def index_body(chunks: DataFrame, synonyms: Synonyms | None = None) -> Column:
    """What is indexed of a chunk: its context fields, its text and synonyms of both."""
    blank = F.lit("")
    fields = [F.coalesce(F.col(c).cast("string"), blank) if c in chunks.columns else blank for c in CONTEXT]
    body = F.concat_ws(" ", *fields, F.coalesce(F.col("text"), blank))
    return F.concat_ws(" ", body, synonyms.expansion(body)) if synonyms else body


class Index:
    """Tables of an inverted index; ``kb_id`` and ``chunk_id`` name a chunk.

    ``postings`` (kb_id, chunk_id, token, tf, length), ``lengths`` (kb_id, chunk_id, length) and ``units`` (kb_id,
    chunk_id, unit) belong to chunks and can be kept; frequencies and averages are derived from them. Texts
    are taken apart once per kind (tokens, units), when a table of that kind is first asked for. ``tables`` are ready-made.
    """

    KEPT = ("postings", "lengths", "units")

    def __init__(self, body: DataFrame | None = None, **tables: DataFrame) -> None:
        self._body = body
        self.__dict__.update(tables)

    def _apart(self, how, label: str) -> DataFrame:  # noqa: ANN001
        return written(spread(self._body).select("kb_id", "chunk_id", how(F.col("body")).alias("items")), label)

    @cached_property
    def _tokens(self) -> DataFrame:
        return self._apart(tokens, "tokens")

    @cached_property
    def postings(self) -> DataFrame:
        return postings_of(self._tokens, "kb_id", "chunk_id")

    @cached_property
    def lengths(self) -> DataFrame:
        return self._tokens.select("kb_id", "chunk_id", F.size("items").cast("bigint").alias("length"))

    @cached_property
    def token_df(self) -> DataFrame:
        """kb_id, token, df"""
        return self.postings.groupBy("kb_id", "token").agg(F.count("*").alias("df"))

    @cached_property
    def corpus(self) -> DataFrame:
        """kb_id, n, avgdl"""
        return self.lengths.groupBy("kb_id").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))

    @cached_property
    def units(self) -> DataFrame:
        return self._apart(content_units, "units").select("kb_id", "chunk_id", F.explode("items").alias("unit"))

    @cached_property
    def unit_df(self) -> DataFrame:
        """kb_id, unit, df"""
        return self.units.groupBy("kb_id", "unit").agg(F.count("*").alias("df"))


def postings_of(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, tf, length) of rows with the array ``items``."""
    tokens_ = items.select(*keys, F.size("items").cast("bigint").alias("length"), F.explode("items").alias("token"))
    return tokens_.groupBy(*keys, "token", "length").agg(F.count("*").alias("tf"))


def build_index(chunks: DataFrame, synonyms: Synonyms | None = None) -> Index:
    """The index of chunks with columns chunk_id, text and, where present, kb_id and context fields."""
    kb = F.col("kb_id") if "kb_id" in chunks.columns else F.lit("default")
    return Index(chunks.select(kb.alias("kb_id"), "chunk_id", index_body(chunks, synonyms).alias("body")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _terms(rows: DataFrame) -> DataFrame:
    """Weighted terms of a query set, broadcast if they were counted to be few; then no posting is shuffled and no
    frequent token is a hot key. More are joined by shuffling, where skewed tokens are split at run time."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def bm25(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, score) of every chunk that has a token of the query.

    ``queries`` has query_id, kb_id, query. ``allowed`` (kb_id, chunk_id) restricts candidates, not the
    statistics.
    """
    asked = queries.select("query_id", "kb_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    # only tokens that are asked for; as semi joins the optimizer moves them below the aggregations
    terms = asked.select("kb_id", "token").distinct()
    weighted = asked.join(index.token_df.join(terms, ["kb_id", "token"], "left_semi"), ["kb_id", "token"]).join(index.corpus, "kb_id")
    weighted = written(weighted.select("query_id", "kb_id", "token", "avgdl", idf(F.col("n"), F.col("df")).alias("idf")), "terms")
    hits = index.postings.join(_terms(weighted), ["kb_id", "token"])
    if allowed is not None:
        hits = hits.join(allowed, ["kb_id", "chunk_id"], "left_semi")
    length = F.col("length") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    return hits.groupBy("query_id", "kb_id", "chunk_id").agg(F.sum(part).alias("score"))


def ranked(scored: DataFrame, score: str, upto: int, name: str = "rank") -> DataFrame:
    """The best ``upto`` per query with their rank from 1; ties go to the smaller chunk id."""
    order = W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("chunk_id"))
    return scored.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= upto)


def _nearest_of(asked, k: int, digits: int | None):  # noqa: ANN001, ANN202
    """Of each batch of vectors, the ``k`` nearest to every query of the broadcast blocks (ids, kbs, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for ids, kbs, matrix in asked.value:
            of_kb: dict = {}
            for q, kb in enumerate(kbs):
                of_kb.setdefault(kb, []).append(q)
            blocks.append((ids, _unit(matrix.astype(np.float64)), of_kb))
        for batch in batches:
            v = batch.column(2)
            if not len(v):
                continue
            x = _unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1))
            kb_of, names = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            rows_of = {kb: np.flatnonzero(kb_of == kb) for kb in dict.fromkeys(kb_of.tolist())}
            for ids, unit, of_kb in blocks:
                out = []
                for kb, numbers in of_kb.items():
                    rows = rows_of.get(kb)
                    if rows is None:
                        continue
                    sims = unit[numbers] @ x[rows].T
                    for q, s in zip(numbers, sims if digits is None else np.round(sims, digits), strict=True):
                        top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                        # everything that ties with the last one stays for the exact ranking
                        top = np.flatnonzero(s >= s[top].min()) if len(top) else top
                        out += [(ids[q], kb, names[rows[i]], float(s[i])) for i in top]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.float64())], names=["query_id", "kb_id", "chunk_id", "similarity"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, similarity, rank): the ``k`` nearest by cosine, exact.

    ``vectors`` has kb_id, chunk_id, embedding; ``queries`` has query_id, kb_id, embedding (ids are
    strings). One scan of the vectors serves ``BLOCKS`` blocks of ``QUERY_BLOCK`` queries, which are broadcast; each
    task multiplies a block with a batch of its rows and keeps the best ``k``, so only few rows are shuffled. A zero
    vector is at similarity 0 to everything. With ``digits`` similarities are rounded before they are ranked, so that
    copies tie and ranks do not depend on the order of summation.
    """
    spark = vectors.sparkSession
    rows = vectors.select("kb_id", "chunk_id", "embedding")
    if allowed is not None:
        rows = rows.join(allowed, ["kb_id", "chunk_id"], "left_semi")
    asked = written(queries.select("query_id", "kb_id", "embedding"), "asked")  # the embedder runs once
    most = QUERY_BLOCK * BLOCKS
    scans = max(1, -(-asked.count() // most))
    out = None
    for scan in range(scans):
        got = (asked if scans == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == scan)).collect()  # about QUERY_BLOCK * BLOCKS rows
        if not got:
            continue
        blocks = [(*zip(*((r.query_id, r.kb_id) for r in b), strict=True), np.array([r.embedding for r in b], np.float32)) for b in batched(got, QUERY_BLOCK)]
        found = rows.mapInArrow(_nearest_of(spark.sparkContext.broadcast(blocks), k, digits), "query_id string, kb_id string, chunk_id string, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id string, kb_id string, chunk_id string, similarity double, rank int")
    return ranked(out, "similarity", k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; a zero vector counts as length 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size > 0, size).otherwise(1.0)


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, kb_id, chunk_id, fused, rank_1, rank_2, ...): reciprocal rank fusion of rankings."""
    parts = None
    for i, r in enumerate(rankings):
        weight = (weights or [1.0] * len(rankings))[i]
        legs = [F.when(F.lit(i == j), F.col("rank")).alias(f"rank_{j + 1}") for j in range(len(rankings))]
        part = r.select("query_id", "kb_id", "chunk_id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("w"), *legs)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "kb_id", "chunk_id").agg(F.sum("w").alias("fused"), *(F.min(f"rank_{j + 1}").alias(f"rank_{j + 1}") for j in range(len(rankings))))


def relevance(index: Index, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, kb_id, chunk_id, relevance): the weighted share of a query's units that a chunk has."""
    asked = queries.select("query_id", "kb_id", F.explode(content_units(F.col("query"))).alias("unit"))
    terms = asked.select("kb_id", "unit").distinct()
    weighted = asked.join(index.corpus.select("kb_id", "n"), "kb_id").join(index.unit_df.join(terms, ["kb_id", "unit"], "left_semi"), ["kb_id", "unit"], "left")
    weighted = written(weighted.select("query_id", "kb_id", "unit", F.log(1 + F.col("n") / (F.coalesce(F.col("df"), F.lit(0)) + 0.5)).alias("w")), "units")
    total = weighted.groupBy("query_id", "kb_id").agg(F.sum("w").alias("total"))
    wanted = candidates.select("query_id", "kb_id", "chunk_id").distinct()
    # units of candidates only, then of those the ones that the chunk's query asks for
    known = index.units.join(_terms(weighted.select("kb_id", "unit").distinct()), ["kb_id", "unit"], "left_semi")
    met = known.join(wanted, ["kb_id", "chunk_id"]).join(weighted, ["query_id", "kb_id", "unit"])
    had = met.dropDuplicates(["query_id", "kb_id", "chunk_id", "unit"]).groupBy("query_id", "kb_id", "chunk_id").agg(F.sum("w").alias("had"))
    out = wanted.join(total, ["query_id", "kb_id"], "left").join(had, ["query_id", "kb_id", "chunk_id"], "left")
    return out.select("query_id", "kb_id", "chunk_id", F.coalesce(F.col("had") / F.col("total"), F.lit(0.0)).alias("relevance"))


def coverage(query: Column, *texts: Column) -> Column:
    """The share of the query's distinct tokens that the texts have."""
    asked = F.array_distinct(tokens(query))
    have = tokens(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked)).otherwise(0.0)


def finish(fused: DataFrame, relevances: DataFrame, chunks: DataFrame, queries: DataFrame, *, top_k: int, min_relevance: float = 0.4, only_relevant: bool = False, per_source_limit: int | None = None) -> DataFrame:
    """Ranked results: relevance filter, then at most so many per source, then the best ``top_k``.

    The order is the fused score; ties follow the first leg's rank, then the second's, then the id.
    """
    first = [F.col(c).asc_nulls_last() for c in fused.columns if c.startswith("rank_")]
    order = [F.col("fused").desc(), *first, F.col("chunk_id")]
    rows = fused.join(relevances, ["query_id", "kb_id", "chunk_id"]).withColumn("relevant", F.col("relevance") >= min_relevance)
    if only_relevant:
        rows = rows.filter("relevant")
    have = [c for c in chunks.columns if c not in fused.columns or c in ("kb_id", "chunk_id")]
    rows = rows.join(chunks.select(*have), ["kb_id", "chunk_id"])
    if per_source_limit:
        rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("query_id", "source_id").orderBy(*order))).filter(F.col("_nth") <= per_source_limit).drop("_nth")
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("position") <= top_k)
    return rows.join(queries.select("query_id", "query"), "query_id")
