"""Measuring retrieval on questions with known answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, embed
from ..runtime import spread
from .retrieval import vector_search


def hit_rates(ranked: DataFrame, questions: DataFrame, *, text: str = "text", by: str = "item_set") -> DataFrame:
    """Per value of ``by``: questions, shares with the answer among the first 1 and 3, mean reciprocal rank.

    ``ranked`` has query_id, rank and the text of a result; ``questions`` has query_id, expected_regex (null: no
    answer exists, the question does not count) and ``by``.
    """
    asked = questions.filter("expected_regex is not null").select("query_id", by, "expected_regex")
    hits = ranked.join(asked, "query_id").filter(F.expr(f"`{text}` rlike expected_regex")).groupBy("query_id").agg(F.min("rank").alias("first"))
    each = asked.join(hits, "query_id", "left")
    share = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return each.groupBy(by).agg(F.count("*").alias("questions"), share(1).alias("hit_1"), share(3).alias("hit_3"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def compare_embedders(chunks: DataFrame, queries: DataFrame, questions: DataFrame, embedders: dict[str, Embedder], upto: int) -> DataFrame:
    """Hit rates of exact vector search alone, per embedder: ``chunks`` has kb_id, chunk_id, text, ``queries`` has
    query_id, kb_id, query, and ``questions`` is as in ``hit_rates``."""
    out = []
    for name, embedder in embedders.items():
        vectors = spread(chunks.select("kb_id", "chunk_id", "text")).select("kb_id", "chunk_id", embed(F.col("text"), embedder).alias("embedding"))
        near = vector_search(vectors, queries.select("query_id", "kb_id", embed(F.col("query"), embedder).alias("embedding")), upto)
        found = near.join(chunks.select("kb_id", "chunk_id", "text"), ["kb_id", "chunk_id"])
        out.append(hit_rates(found, questions).withColumn("embedder", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def with_thresholds(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each question once per threshold with whether its best relevance reaches it (``best``; null: never)."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    return best.select("*", at).withColumn("accepted", F.coalesce(F.col("best") >= F.col("threshold"), F.lit(False)))


def accepted_share(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold and answerable: questions and the share that is accepted. Found is the share of those with
    an answer, rejected one minus the share of those without."""
    rows = with_thresholds(best, thresholds)
    return rows.groupBy("threshold", "answerable").agg(F.count("*").alias("questions"), F.avg(F.col("accepted").cast("double")).alias("accepted"))


def fitted_threshold(best: DataFrame, thresholds: list[float], held_out: str = "test", by: str = "item_set") -> DataFrame:
    """One row: the threshold that judges most questions of the other sets rightly (the lowest of equals), and
    the share it judges rightly on the set ``held_out``."""
    rows = with_thresholds(best, thresholds).withColumn("right", (F.col("accepted") == F.col("answerable")).cast("double"))
    per = rows.groupBy("threshold").agg(F.avg(F.when(F.col(by) != held_out, F.col("right"))).alias("fitted"), F.avg(F.when(F.col(by) == held_out, F.col("right"))).alias("held_out"))
    order = F.struct(F.col("fitted"), -F.col("threshold"))
    return per.agg(F.max_by("threshold", order).alias("threshold"), F.max_by("fitted", order).alias("fitted"), F.max_by("held_out", order).alias("held_out"))
