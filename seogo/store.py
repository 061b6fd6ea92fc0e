"""Chunk tables on disk: one folder per knowledge base, layers inside it, a pointer to the current ones.

A change writes one layer, in proportion to what it brings: the new rows, and the keys (sources or chunks) of what
they replace or what is deleted. Then the pointer moves, so readers see either the old or the new state, and
nothing is overwritten while it is read. Reading unites the layers and leaves out rows whose key a later layer names.
Every ``LAYERS`` changes the layers are rewritten as one. A lost job leaves the pointer where it was. One writer
at a time per knowledge base: of two at once the later pointer wins.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.filters import compile_where
from .runtime import shared_folder, written

CHUNK_SCHEMA = (
    "chunk_id string, text string, source_id string, source_name string, source_type string, file_name string, file_type string, parent_name string, chunk_index int, char_count int, "
    "kinds string, section string, page int, page_end int, sheet string, title string, author string, created_at string, modified_at string, sender string, sender_name string, "
    "recipients string, cc string, sent_at string, subject string, url string, space string, language string, path_in_archive string, last_modified_by string, ingested_at string, "
    "extra map<string,string>, embedding array<float>"
)
#: Layers from which on a change rewrites them as one.
LAYERS = 16
#: Compactions whose layers are kept, for readers that started before.
KEPT = 2
#: Replaced keys up to this number are broadcast when layers are united; more are joined by shuffling.
BROADCAST_KEYS = 100_000


class EmbedderMismatch(ValueError):
    """A knowledge base was made with another embedder."""


def collection_name(kb_id: str) -> str:
    """A safe folder name. Ids that differ only in unsafe characters share it, so a hash is not added here but
    where folders are made."""
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", kb_id).strip("._-")
    return f"kb_{safe or 'default'}"[:500]


class ChunkStore:
    """Chunk tables of knowledge bases under a folder (any Hadoop path). A null root means the session's shared
    folder, and the tables end with the session."""

    def __init__(self, spark: SparkSession, root: str | None, embedder: str) -> None:
        self.spark, self.embedder = spark, embedder
        if root is None:
            root = f"{shared_folder(spark)}/seogo-session-{spark.sparkContext.applicationId}"
            fs, path = self._fs(root)
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        self.root = root.rstrip("/")

    # ------------------------------------------------------------------ paths

    def _folder(self, kb_id: str) -> str:
        return f"{self.root}/{collection_name(kb_id)}-{uuid.uuid5(uuid.NAMESPACE_OID, kb_id).hex[:8]}"

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, kb_id: str) -> dict | None:
        fs, path = self._fs(f"{self._folder(kb_id)}/current.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _append(self, kb_id: str, rows: DataFrame | None, gone: DataFrame | None, key: str | None) -> None:
        """Write a layer of ``rows`` that replaces what earlier layers hold of the keys ``gone``."""
        layer = {"rows": None, "gone": None, "key": key, "keys": 0}
        if gone is not None:
            layer["gone"] = f"gone-{uuid.uuid4().hex}"
            gone.select(key).distinct().write.parquet(f"{self._folder(kb_id)}/{layer['gone']}")
            layer["keys"] = self.spark.read.parquet(f"{self._folder(kb_id)}/{layer['gone']}").count()
        if rows is not None:
            layer["rows"] = f"v-{uuid.uuid4().hex}"
            self._typed(rows).write.parquet(f"{self._folder(kb_id)}/{layer['rows']}")
        before = self._pointer(kb_id) or {"layers": [], "old": []}
        self._point(kb_id, [*before["layers"], layer], before["old"])
        if len(before["layers"]) + 1 >= LAYERS:
            self.compact(kb_id)

    def compact(self, kb_id: str) -> None:
        """Rewrite all layers as one, so that later reads have nothing to leave out."""
        before = self._pointer(kb_id)
        if before is None or len(before["layers"]) < 2:
            return
        whole = f"v-{uuid.uuid4().hex}"
        self._typed(self.get(kb_id)).write.parquet(f"{self._folder(kb_id)}/{whole}")
        replaced = [x for layer in before["layers"] for x in (layer["rows"], layer["gone"]) if x]
        old = [*before["old"], replaced]
        self._point(kb_id, [{"rows": whole, "gone": None, "key": None, "keys": 0}], old[-KEPT:])
        for name in (x for group in old[:-KEPT] for x in group):
            fs, path = self._fs(f"{self._folder(kb_id)}/{name}")
            fs.delete(path, True)

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in self._schema().fields))

    def _point(self, kb_id: str, layers: list[dict], old: list[list[str]]) -> None:
        pointer = {"kb_id": kb_id, "embedder": self.embedder, "version": uuid.uuid4().hex, "layers": layers, "old": old}
        fs, path = self._fs(f"{self._folder(kb_id)}/current.json")
        _, fresh = self._fs(f"{self._folder(kb_id)}/current-{uuid.uuid4().hex}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointer).encode("utf-8")))
        out.close()
        self._move_over(fresh, path)

    def _move_over(self, fresh, path) -> None:  # noqa: ANN001
        """Replace the pointer in one step, so that readers never miss it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        uri = path.getFileSystem(conf).makeQualified(path).toUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(fresh, path, options)

    def _schema(self):  # noqa: ANN202
        from pyspark.sql.types import _parse_datatype_string

        return _parse_datatype_string(CHUNK_SCHEMA)

    # ------------------------------------------------------------------ reading

    def check(self, kb_id: str) -> None:
        """Raise if the knowledge base was made with another embedder."""
        at = self._pointer(kb_id)
        if at and at["embedder"] != self.embedder:
            raise EmbedderMismatch(f"knowledge base {kb_id!r} was made with {at['embedder']!r}, not {self.embedder!r}")

    def get(self, kb_id: str, where: dict[str, Any] | None = None) -> DataFrame:
        """All chunks that match; an unknown knowledge base is empty."""
        rows = self.united(kb_id, lambda name: self.spark.read.schema(self._schema()).parquet(f"{self._folder(kb_id)}/{name}"))
        if rows is None:
            rows = self.spark.createDataFrame([], CHUNK_SCHEMA)
        return rows.filter(compile_where(rows, where)) if where else rows

    def united(self, kb_id: str, table: Callable[[str], DataFrame]) -> DataFrame | None:
        """What ``table`` (of a layer's name) gives for all layers, less the rows that later layers replace. The tables
        have the columns source_id and chunk_id. Null if there are no rows."""
        at = self._pointer(kb_id)
        layers = at["layers"] if at else []
        parts = [table(layer["rows"]).withColumn("_layer", F.lit(n)) for n, layer in enumerate(layers) if layer["rows"]]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        first = next(n for n, layer in enumerate(layers) if layer["rows"])
        for key in ("source_id", "chunk_id"):
            hit = [(n, layer) for n, layer in enumerate(layers) if layer["gone"] and layer["key"] == key and n > first]
            if not hit:
                continue
            gone = reduce(DataFrame.unionByName, (self.spark.read.schema(f"{key} string").parquet(f"{self._folder(kb_id)}/{layer['gone']}").withColumn("_gone", F.lit(n)) for n, layer in hit))
            gone = gone.groupBy(key).agg(F.max("_gone").alias("_gone"))
            few = sum(layer["keys"] for _, layer in hit) <= BROADCAST_KEYS
            rows = rows.join(F.broadcast(gone) if few else gone, key, "left").filter("_gone is null or _gone <= _layer").drop("_gone")
        return rows.drop("_layer")

    def layers(self, kb_id: str) -> list[str]:
        """Names of the layers that hold rows."""
        at = self._pointer(kb_id)
        return [layer["rows"] for layer in at["layers"] if layer["rows"]] if at else []

    def side_table(self, kb_id: str, layer: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A table derived from one layer's rows, written beside the layer when it is first asked for."""
        path = f"{self._folder(kb_id)}/{layer}.{name}"
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make(self.spark.read.schema(self._schema()).parquet(f"{self._folder(kb_id)}/{layer}")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def version(self, kb_id: str) -> str | None:
        at = self._pointer(kb_id)
        return at["version"] if at else None

    def count(self, kb_id: str) -> int:
        return self.get(kb_id).count()

    # ------------------------------------------------------------------ changes

    def upsert(self, kb_id: str, rows: DataFrame) -> None:
        """Add chunks; those with a known chunk_id are replaced. The last of repeated ids is not defined."""
        self.check(kb_id)
        rows = written(complete(rows).dropDuplicates(["chunk_id"]), "upsert")  # one choice among repeated ids
        self._append(kb_id, rows, rows, "chunk_id")

    def replace_sources(self, kb_id: str, rows: DataFrame, sources: DataFrame) -> None:
        """Take out all chunks of ``sources`` (source_id) and add ``rows``, as one visible change."""
        self.check(kb_id)
        self._append(kb_id, complete(rows), sources, "source_id")

    def delete(self, kb_id: str, where: dict[str, Any]) -> int:
        """Remove what matches; returns how many chunks that were."""
        hit = written(self.get(kb_id, where).select("source_id", "chunk_id"), "delete")
        removed = hit.count()
        if removed:
            # what names whole sources is remembered by source
            key = "source_id" if set(where) == {"source_id"} else "chunk_id"
            self._append(kb_id, None, hit, key)
        return removed

    def drop(self, kb_id: str) -> None:
        fs, path = self._fs(self._folder(kb_id))
        fs.delete(path, True)


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``CHUNK_SCHEMA`` that they lack, as nulls."""
    named = (c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", CHUNK_SCHEMA))
    return rows.withColumns({c: F.lit(None) for c in named if c not in rows.columns})
