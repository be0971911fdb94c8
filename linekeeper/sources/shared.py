"""The folder that the driver and all executors see, where plans keep what they write and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders named so far within ``passing``.
_NAMED: ContextVar[list[str] | None] = ContextVar("named", default=None)
#: Whether shuffle files go when the query that made them has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; where that is not set, a local session gets a folder of its own, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="linekeeper-"))
        root = spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/plans/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if (named := _NAMED.get()) is not None:
        named.append(folder)
    return folder


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Work whose folders and shuffle files go with it: folders that plans name within are deleted at its end, so what is to stay is named before."""
    from pyarrow import fs

    outer, before = _NAMED.set(named := []), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
        _NAMED.reset(outer)
        for folder in named:
            disk, path = open_folder(folder)
            if disk.get_file_info(path).type != fs.FileType.NotFound:
                disk.delete_dir(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and readers prune columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, each: int = 4) -> DataFrame:
    """Rows dealt out by key to ``each`` tasks a core, where their bytes in a shuffle say little of their work or size: a number that is given keeps adaptive execution from joining tasks by bytes."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, *keys)


def open_folder(uri: str):
    """(file system, path) of a folder or file; any scheme that pyarrow opens on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
