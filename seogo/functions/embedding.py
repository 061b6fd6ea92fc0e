"""Embedders: hashed character n-grams (no model needed), and a plug-in for local models."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import words

DIM = 1024
_WORD = re.compile(r"[가-힣]+|[a-zA-Z][a-zA-Z0-9_]*|\d+")


class Embedder(Protocol):
    """What a knowledge base needs of an embedder; it must be picklable."""

    name: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def _grams(word: str) -> Iterator[tuple[str, float]]:
    yield "w:" + word, 1.0
    marked = f"<{word}>"
    for n in (2, 3):
        for i in range(len(marked) - n + 1):
            if gram := marked[i : i + n].strip("<>"):
                yield "g:" + marked[i : i + n], 1.0 if gram else 0.0


@lru_cache(maxsize=1 << 16)
def _word_features(word: str) -> tuple[tuple[str, float], ...]:
    return tuple(_grams(word)) if "가" <= word[0] <= "힣" else (("w:" + word, 1.5),)


@lru_cache(maxsize=1 << 18)
def _slot(feature: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(feature.encode("utf-8"))
    return h % dim, 1.0 if h >> 31 else -1.0


class HashingEmbedder:
    """Unit vectors of hashed words and syllable n-grams; a text without any is the first axis."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.name = dim, "hash-ngram-v1"

    def exact(self, text: str | None) -> np.ndarray:
        """The vector in double precision."""
        weights: Counter = Counter()
        for word in _WORD.findall(unicodedata.normalize("NFC", text or "").lower()):
            for feature, weight in _word_features(word):
                weights[feature] += weight
        v = np.zeros(self.dim)
        for feature, weight in weights.items():
            at, sign = _slot(feature, self.dim)
            v[at] += sign * (1.0 + math.log(weight))
        v[np.abs(v) < 1e-9] = 0  # what cancels out may leave a last digit
        norm = float(np.linalg.norm(v))
        if norm:
            return v / norm
        v[0] = 1.0
        return v

    def vector(self, text: str | None) -> np.ndarray:
        return self.exact(text).astype(np.float32)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.vector(t).tolist() for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self.vector(text).tolist()


class LocalModelEmbedder:
    """A sentence-transformers model, loaded once per worker; e5 models get their prefixes."""

    def __init__(self, model: str) -> None:
        self.model, self.name, self._prefixed = model, "st:" + model, "e5" in model.lower()

    def _encode(self, texts: list[str]) -> list[list[float]]:
        return _loaded(self.model).encode(texts, normalize_embeddings=True, show_progress_bar=False).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._encode(["passage: " + t for t in texts] if self._prefixed else texts)

    def embed_query(self, text: str) -> list[float]:
        return self._encode([("query: " if self._prefixed else "") + text])[0]


@lru_cache(maxsize=2)
def _loaded(model: str):  # noqa: ANN202
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError("sentence-transformers is not installed; use the hash embedder") from e
    return SentenceTransformer(model)


def get_embedder(spec: str | None = "hash") -> Embedder:
    """``hash`` (also ``default`` or empty) or ``st:<model>``."""
    spec = (spec or "hash").strip()
    if spec in ("", "hash", "default"):
        return HashingEmbedder()
    if spec.startswith("st:"):
        return LocalModelEmbedder(spec[3:])
    raise ValueError(f"unknown embedder: {spec} (hash or st:<model>)")


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of texts as array<float>, by Arrow batches."""
    used = embedder or HashingEmbedder()

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(used.embed_documents(s.fillna("").tolist()))

    return run(text)


def sparse_vectors(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, val): the non-zero entries of the hashed vectors, by Arrow batches; nothing is shuffled."""
    used = HashingEmbedder(dim)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, idx int, val double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [used.exact(t) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(v) for v in vectors]
            owner = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]))
            none = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.concatenate([*at, *none]).astype(np.int32)), pa.array(np.concatenate([v[x] for v, x in zip(vectors, at, strict=True)] + none))], names=[key, "idx", "val"])

    return df.select(key, text).mapInArrow(run, schema)


def sparse_features(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, val): the non-zero entries of the hashed vectors, in built-in expressions only."""
    word = F.col("_w")
    hangul = F.substring(word, 1, 1).between("가", "힣")
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.concat(F.lit("g:"), F.substring(marked, i, n)))

    # a one-syllable word has no gram that is only marks; longer ones neither
    features = F.when(hangul, F.transform(F.concat(F.array(F.concat(F.lit("w:"), word)), grams(2), grams(3)), lambda f: F.struct(f.alias("f"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(F.concat(F.lit("w:"), word).alias("f"), F.lit(1.5).alias("w"))))
    counted = df.select(key, F.explode(words(F.col(text))).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    weights = counted.select(key, "_n", F.explode(features).alias("x")).groupBy(key, F.col("x.f").alias("f")).agg(F.sum(F.col("_n") * F.col("x.w")).alias("w"))
    h = F.crc32(F.col("f").cast("binary"))
    entries = weights.select(key, (h % dim).cast("int").alias("idx"), (F.when(h >= 2**31, 1.0).otherwise(-1.0) * (1 + F.log("w"))).alias("v"))
    summed = entries.groupBy(key, "idx").agg(F.sum("v").alias("v"))
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    # what cancels out may leave a last digit
    return summed.join(norms, key).filter("abs(v) > 1e-9").select(key, "idx", (F.col("v") / F.col("norm")).alias("val"))
