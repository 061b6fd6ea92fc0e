"""Reading files of any supported format into part rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .image import ImageReader, set_image_reader
from .model import PART_SCHEMA, ParseError
from .registry import parse

_EMPTY = {"part_ordinal": 0, "parent_ordinal": None, "depth": 0, "source_type": None, "metadata": {}, "warnings": [], "blocks": []}
_COLUMNS = ["source_id", "part_ordinal", "parent_ordinal", "depth", "source_name", "source_type", "metadata", "warnings", "blocks", "error"]


def source_id_of(path: str) -> str:
    """A stable id of a path: reading the same file again replaces it."""
    return hashlib.sha256(path.encode("utf-8")).hexdigest()[:12]


def _parser(reader: ImageReader | None, most_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if reader is not None:
            set_image_reader(reader)
        for batch in batches:
            for path, size, data in zip(batch["path"], batch["length"], batch["content"], strict=True):
                name, source = PurePosixPath(unquote(path)).name, source_id_of(path)
                try:
                    if data is None:
                        raise ParseError(f"the file is larger than {most_bytes // 1024 // 1024} MB ({size} bytes)")
                    rows = parse(name, bytes(data)).rows(source)
                except ParseError as e:
                    rows = [{**_EMPTY, "source_id": source, "source_name": name, "error": str(e)}]
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def read_files(spark: SparkSession, path: str | list[str], *, pattern: str | None = None, most_mb: int = 50, image_reader: ImageReader | None = None) -> DataFrame:
    """Parts (``model.PART_SCHEMA``) of files at paths or globs; unreadable files come as rows with ``error``.

    Files beyond ``most_mb`` are not loaded. ``pattern`` filters names before anything is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return parse_files(reader.load(path), most_mb=most_mb, image_reader=image_reader)


def parse_files(files: DataFrame, *, most_mb: int = 50, image_reader: ImageReader | None = None) -> DataFrame:
    """Parts of rows with path, length and content, as the ``binaryFile`` source has them (also streaming)."""
    most = most_mb * 1024 * 1024
    rows = files.select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))
    return rows.mapInPandas(_parser(image_reader, most), PART_SCHEMA)


def text_parts(df: DataFrame, *, source_id: str, text: str, source_name: str, source_type: str = "note", metadata: dict | None = None) -> DataFrame:
    """Parts of texts in a column: paragraphs between blank lines, in built-in expressions."""
    blocks = F.transform(paragraphs(F.col(text)), lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("text"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("page"), F.create_map().cast("map<string,string>").alias("meta")))
    meta = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)).cast("map<string,string>")
    named = F.col(source_name) if source_name in df.columns else F.lit(source_name)
    typed = F.col(source_type) if source_type in df.columns else F.lit(source_type)
    return df.select(
        F.col(source_id).cast("string").alias("source_id"), F.lit(0).alias("part_ordinal"), F.lit(None).cast("int").alias("parent_ordinal"), F.lit(0).alias("depth"), named.alias("source_name"),
        typed.alias("source_type"), meta.alias("metadata"), F.array().cast("array<string>").alias("warnings"), blocks.alias("blocks"), F.lit(None).cast("string").alias("error"),
    )


def paragraphs(text):  # noqa: ANN001, ANN201
    """Cleaned paragraphs of a text between lines that are blank."""
    from ..functions.text import SPACES, CONTROLS, nfc, strip

    t = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), r"\r\n", "\n")
    pieces = F.split(t, r"(?U)(?:^|\n)[^\S\n]*(?=\n|$)")

    def tidy(p):  # noqa: ANN001, ANN202
        p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "\r", "\n"), CONTROLS, ""), SPACES, " ")
        return strip(F.regexp_replace(F.regexp_replace(p, r"(?U)[^\S\n]+(?=\n|$)|(?<=\n)[^\S\n]+|^[^\S\n]+", ""), r"\n{3,}", "\n\n"))

    return F.filter(F.transform(pieces, tidy), lambda p: p != "")
