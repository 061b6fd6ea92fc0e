"""Running a Python function over Arrow batches of selected columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply ``make()`` (once per task) to lists of column values, batch by batch.

    The inner function takes one list per column of ``df`` and returns one list per column of
    ``schema``; lengths may differ from the input's. Rows stream through: a task holds one Arrow
    batch at a time.
    """
    arrow_schema = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            out = fn(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, arrow_schema, strict=True)], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def _schema(text: str) -> StructType:
    got = _parse_datatype_string(text)
    assert isinstance(got, StructType)
    return got


def texts_of(blocks: DataFrame | None, chunks: DataFrame | None) -> DataFrame:
    """(item_kind, item_id, text) of blocks and chunks; rows that come twice are left to the caller."""
    parts = []
    if blocks is not None:
        parts.append(blocks.select(F.lit("block").alias("item_kind"), F.col("block_id").cast("string").alias("item_id"), "text"))
    if chunks is not None:
        parts.append(chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
