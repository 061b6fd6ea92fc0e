"""Continuous ingestion: files that land in a folder are parsed and replace their earlier versions."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..kb import KnowledgeBase
from ..sources.files import parse_files

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(kb: KnowledgeBase, folder: str, checkpoint: str, *, pattern: str = "*", per_batch: int = 1000, available_now: bool = False) -> StreamingQuery:
    """Start a stream over ``folder``. A batch that is run again after a failure replaces the same sources, so
    each file counts once. ``available_now`` stops when everything present is read."""
    files = kb.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)

    def one(batch, _: int) -> None:  # noqa: ANN001
        kb.ingest(parse_files(batch, most_mb=kb.settings.max_file_mb))

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
