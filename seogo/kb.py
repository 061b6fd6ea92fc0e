"""Knowledge bases: ingest in bulk, search in bulk, administer."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import Embedder, embed, get_embedder
from .functions.text import citation, content_units, contextual_text, tokens
from .operators import retrieval as R
from .operators.chunking import chunk_parts, with_metadata
from .operators.filters import combined, compile_where
from .runtime import written
from .settings import Settings
from .sources.files import read_files, source_id_of
from .sources.links import Transport, fetch_link, Fetcher
from .sources.model import PART_SCHEMA, Part, ParseError
from .sources.plain import text_blocks
from .store import ChunkStore

# Metadata shown for a source, which callers read by these names.
SOURCE_KEYS = ["url", "title", "author", "sender", "sender_name", "sent_at", "subject", "ingested_at", "space", "file_type"]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


class KnowledgeBase:
    """One knowledge base of a store. The bulk methods are ``ingest`` and ``search_batch``; the others wrap them."""

    def __init__(self, spark: SparkSession, kb_id: str = "default", settings: Settings | None = None, embedder: Embedder | None = None) -> None:
        self.spark, self.kb_id, self.settings = spark, kb_id, settings or Settings()
        self.embedder = embedder or get_embedder(self.settings.embedding)
        self.store = ChunkStore(spark, self.settings.data_dir, self.embedder.name)
        self.synonyms = self.settings.synonym_groups()
        self._index: tuple[tuple, R.Index] | None = None

    # ------------------------------------------------------------------ ingest

    def ingest(self, parts: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
        """Chunk, embed and store part rows (``sources.model.PART_SCHEMA``); sources that are known are replaced.

        Returns one row per source: source_id, source_name, source_type, chunk_count, char_count,
        attachment_count, warnings, error.
        """
        parts = written(parts, "parts")
        good = parts.filter("error is null")
        extras = {"ingested_at": _now(), **(metadata or {})}
        chunks = with_metadata(chunk_parts(good, self.settings.chunk_size, self.settings.chunk_overlap, self.settings.whole_chunks), good, extras)
        chunks = chunks.withColumn("ingested_at", F.lit(extras["ingested_at"])).withColumn("extra", F.map_filter("extra", lambda k, v: k != "ingested_at"))
        head = contextual_text(F.col("title"), F.col("file_name"), F.col("section"), F.col("subject"), F.col("text"))
        chunks = written(chunks.withColumn("embedding", embed(head, self.embedder)), "chunks")
        self.store.replace_sources(self.kb_id, chunks, good)
        counts = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.sum("char_count").alias("char_count"))
        near = parts.filter("depth <= 1").groupBy("source_id").agg(F.flatten(F.collect_list("warnings")).alias("w"), F.sum((F.col("depth") == 1).cast("int")).alias("attachment_count"))
        root = parts.filter("part_ordinal = 0").select("source_id", "source_name", "source_type", "error")
        out = root.join(near, "source_id", "left").join(counts, "source_id", "left").na.fill(0, ["chunk_count", "char_count", "attachment_count"])
        empty = F.when((F.col("chunk_count") == 0) & F.col("error").isNull(), F.array(F.lit("no text was found"))).otherwise(F.array().cast("array<string>"))
        return out.select("source_id", "source_name", "source_type", "chunk_count", "char_count", "attachment_count", F.concat(F.coalesce("w", F.array().cast("array<string>")), empty).alias("warnings"), "error")

    def _one(self, part: Part, source_id: str | None, metadata: dict | None) -> dict[str, Any]:
        rows = part.rows(source_id or uuid.uuid4().hex[:12])
        out = self.ingest(self.spark.createDataFrame(rows, PART_SCHEMA), metadata).first().asDict()
        return out | {"metadata": rows[0]["metadata"]}

    def add_files(self, path: str | list[str], metadata: dict | None = None, image_reader=None) -> DataFrame:  # noqa: ANN001
        return self.ingest(read_files(self.spark, path, most_mb=self.settings.max_file_mb, image_reader=image_reader), metadata)

    def add_file(self, path: str, *, source_id: str | None = None, display_name: str | None = None, metadata: dict | None = None) -> dict[str, Any]:
        """One local file; errors are raised."""
        from pathlib import Path

        from .sources.registry import parse

        p = Path(path)
        if not p.is_file():
            raise ParseError(f"file not found: {path}")
        if p.stat().st_size > self.settings.max_file_mb * 1024 * 1024:
            raise ParseError(f"the file is larger than {self.settings.max_file_mb} MB")
        return self._one(parse(display_name or p.name, p.read_bytes()), source_id or source_id_of(str(p.resolve())), metadata)

    def add_url(self, url: str, *, source_id: str | None = None, link_type: str | None = None, metadata: dict | None = None, transport: Transport | None = None, check_dns: bool = True) -> dict[str, Any]:
        part = fetch_link(url, self.settings, link_type=link_type, fetcher=Fetcher(self.settings, transport, check_dns))
        return self._one(part, source_id or source_id_of(url), {"url": url, **(metadata or {})})

    def add_text(self, text: str, *, source_name: str, source_type: str = "note", source_id: str | None = None, metadata: dict | None = None) -> dict[str, Any]:
        part = Part(source_name, source_type, text_blocks(text), {"created_at": _now(), **(metadata or {})})
        return self._one(part, source_id, None)

    # ------------------------------------------------------------------ search

    def index(self) -> R.Index:
        """The inverted index of the current version. Its tables lie beside the layers of the store, each made once per
        layer and synonym dictionary, so that a change is indexed in proportion to its size."""
        self.synonyms.refresh()
        key = (self.store.version(self.kb_id), self.synonyms.signature)
        if self._index is None or self._index[0] != key:
            mark = hashlib.sha256(repr(self.synonyms.signature).encode()).hexdigest()[:8]

            def table(name: str):  # noqa: ANN202
                return self.store.united(self.kb_id, lambda layer: self.store.side_table(self.kb_id, layer, f"{name}-{mark}", lambda rows: self._apart(rows, name)))

            kept = {name: table(name) for name in R.Index.KEPT}
            if kept["lengths"] is None:
                built = R.build_index(self._chunks(), self.synonyms)
            else:
                built = R.Index(**{name: rows.withColumn("kb_id", F.lit(self.kb_id)) for name, rows in kept.items()})
            self._index = (key, built)
        return self._index[1]

    def _apart(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows of one index table that chunks of a layer give."""
        body = rows.select("source_id", "chunk_id", R.index_body(rows, self.synonyms).alias("body"))
        if name == "units":
            return body.select("source_id", "chunk_id", F.explode(content_units(F.col("body"))).alias("unit"))
        items = body.select("source_id", "chunk_id", tokens(F.col("body")).alias("items"))
        if name == "lengths":
            return items.select("source_id", "chunk_id", F.size("items").cast("bigint").alias("length"))
        return R.postings_of(items, "source_id", "chunk_id")

    def _chunks(self) -> DataFrame:
        return self.store.get(self.kb_id).withColumn("kb_id", F.lit(self.kb_id))

    def search_batch(self, queries: DataFrame, top_k: int = 5, *, source_types: list[str] | None = None, source_ids: list[str] | None = None, where: dict | None = None, per_source_limit: int | None = None, only_relevant: bool = False) -> DataFrame:
        """Results of many queries (query_id, query): chunk columns with position, scores, relevance, citation.

        Blank queries have no results. Statistics cover the whole knowledge base, filters the candidates.
        """
        self.store.check(self.kb_id)
        chunks, index = self._chunks(), self.index()
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.lit(self.kb_id).alias("kb_id"), F.trim("query").alias("query")).filter("query <> ''")
        where = combined(where, source_types, source_ids)
        allowed = chunks.filter(compile_where(chunks, where)).select("kb_id", "chunk_id") if where else None
        pool = max(4 * top_k, 20)
        near = R.vector_search(chunks, asked.select("query_id", "kb_id", embed(F.col("query"), self.embedder).alias("embedding")), pool, allowed)
        fused = written(R.fuse([near, R.ranked(R.bm25(index, asked, allowed), "score", pool)]), "fused")
        rows = R.finish(fused, R.relevance(index, asked, fused), chunks, asked, top_k=max(top_k, 0), min_relevance=self.settings.min_relevance, only_relevant=only_relevant, per_source_limit=per_source_limit)
        vectors = asked.select("query_id", embed(F.col("query"), self.embedder).alias("_q"))
        rows = rows.join(vectors, "query_id").withColumn("vector_score", R.cosine(F.col("embedding"), F.col("_q")))
        rows = rows.withColumn("keyword_score", R.coverage(F.col("query"), F.col("text"), F.col("section"), F.col("file_name")))
        four = lambda c: F.round(c, 4)
        score = four(0.5 * F.greatest("vector_score", F.lit(0.0)) + 0.5 * F.col("keyword_score"))
        rows = rows.withColumns({"score": score, "citation": citation(F.col)}).withColumns({c: four(F.col(c)) for c in ("vector_score", "keyword_score", "relevance")})
        return rows.drop("_q", "embedding", "fused", "rank_1", "rank_2", "kb_id")

    def search(self, query: str, top_k: int = 5, **options) -> list[dict[str, Any]]:  # noqa: ANN003
        """Results of one query in order; a blank query or ``top_k`` of 0 has none."""
        if not (query or "").strip() or top_k <= 0 or self.store.version(self.kb_id) is None:
            return []
        rows = self.search_batch(self.spark.createDataFrame([("q", query)], "query_id string, query string"), top_k, **options)
        return [r.asDict() for r in rows.orderBy("position").collect()]

    # ------------------------------------------------------------------ administration

    def list_sources(self) -> DataFrame:
        return list_sources(self._chunks())

    def get_chunks(self, source_id: str | None = None, limit: int | None = None) -> DataFrame:
        """Chunks in their order, as text for overviews."""
        rows = self.store.get(self.kb_id, {"source_id": source_id} if source_id else None)
        return in_order(rows, limit)

    def delete_source(self, source_id: str) -> int:
        return self.store.delete(self.kb_id, {"source_id": source_id})

    def clear(self) -> None:
        self.store.drop(self.kb_id)

    def stats(self) -> dict[str, Any]:
        row = totals(self._chunks()).first()
        counts = {"chunk_count": row.chunk_count, "source_count": row.source_count} if row else {"chunk_count": 0, "source_count": 0}
        return {"kb_id": self.kb_id, **counts, "embedder": self.embedder.name}


def totals(chunks: DataFrame) -> DataFrame:
    """(kb_id, chunk_count, source_count)"""
    # counted per source first, so that a knowledge base with most of the sources is no hot group
    per = chunks.groupBy("kb_id", "source_id").agg(F.count("*").alias("n"))
    return per.groupBy("kb_id").agg(F.sum("n").alias("chunk_count"), F.count("source_id").alias("source_count"))


def in_order(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks by source and number, the first ``limit`` of them."""
    rows = chunks.orderBy("source_id", "chunk_index", "chunk_id")
    return rows.limit(limit) if limit else rows


def list_sources(chunks: DataFrame) -> DataFrame:
    """One row per source with its first chunk's metadata, by time of ingestion."""
    shown = F.struct("chunk_index", "source_name", "source_type", *(c for c in SOURCE_KEYS if c in chunks.columns))
    keys = ["kb_id", "source_id"] if "kb_id" in chunks.columns else ["source_id"]
    rows = chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.min(shown).alias("m"))
    return rows.select(*keys, "m.source_name", "m.source_type", "chunk_count", *(f"m.{c}" for c in SOURCE_KEYS if c in chunks.columns)).orderBy("ingested_at", "source_id")


_OPEN: dict[tuple[str, str | None, str], KnowledgeBase] = {}


def get_knowledge_base(spark: SparkSession, kb_id: str = "default", settings: Settings | None = None) -> KnowledgeBase:
    """The same object for the same id; given settings make a new one."""
    if settings is not None:
        return KnowledgeBase(spark, kb_id, settings)
    key = (spark.sparkContext.applicationId, Settings().data_dir, kb_id)
    if key not in _OPEN:
        _OPEN[key] = KnowledgeBase(spark, kb_id)
    return _OPEN[key]


def search_documents(spark: SparkSession, query: str, top_k: int = 5, kb_id: str = "default", **options) -> list[dict[str, Any]]:  # noqa: ANN003
    return get_knowledge_base(spark, kb_id).search(query, top_k, **options)


def ingest_file(spark: SparkSession, path: str, kb_id: str = "default", **options) -> dict[str, Any]:  # noqa: ANN003
    return get_knowledge_base(spark, kb_id).add_file(path, **options)


def ingest_url(spark: SparkSession, url: str, kb_id: str = "default", **options) -> dict[str, Any]:  # noqa: ANN003
    return get_knowledge_base(spark, kb_id).add_url(url, **options)
