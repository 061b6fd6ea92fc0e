"""Session helpers: shared folder for cut lineage, table reading, small guards."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a table is a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own; on a cluster a missing
    setting is an error, because a machine-local folder would not outlive an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="seogo-")
    return _OWN_FOLDER[app]


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted when the driver ends, or by ``forget_written``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seogo-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)  # the tables end with the driver
    return spark.read.schema(df.schema).parquet(path)


def kept(sources: DataFrame, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from stored files, made once a session and kept as long as these files stay as they are.

    Its name holds a fingerprint of the folders that ``sources`` reads, so changed files mean another table.
    ``forget_written`` leaves it; it is deleted when the driver ends.
    """
    spark = sources.sparkSession
    path = f"{shared_folder(spark)}/seogo-kept-{spark.sparkContext.applicationId}-{label}-{_fingerprint(sources)}"
    fs, p = _file_system(spark, path)
    if not fs.exists(_file_system(spark, f"{path}/_SUCCESS")[1]):
        make().write.mode("overwrite").parquet(path)
        fs.deleteOnExit(p)
    return spark.read.parquet(path)


def _fingerprint(df: DataFrame) -> str:
    """A hash over the paths, sizes and times of the files under the folders that a frame reads; one listing a folder."""
    spark = df.sparkSession
    seen = []
    for parent in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        fs, p = _file_system(spark, parent)
        seen += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


def forget_written(spark: SparkSession) -> int:
    """Delete the tables this application has written with ``written``; returns how many. Frames made from
    them cannot be read any more, so call it between jobs. A shared folder keeps them otherwise."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
    return len(paths)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores, for stages that compute much per row.

    A small table is often one file split and would keep one core busy. Tables with enough splits, as
    every large one has, come back as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
