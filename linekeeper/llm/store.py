"""Shared-folder tables, cluster-safe files and id pre-filters that the other modules use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where nothing is set, a local session (tests, a laptop) gets a folder of its own; on a
    cluster that is an error, as executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="linekeeper-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/linekeeper/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> bool:
    """Delete what this application has stored; results that aren't written elsewhere can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/linekeeper/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to a Python worker together while a table is made: texts are long.
BATCH_ROWS = 2_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors, but keeps the
    table columnar and compressed, so that later readers prune columns.
    """
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = new_folder(spark, name), spark.conf.get(rows)
    spark.conf.set(rows, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path)


def stand_aside(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """(``docs``, its columns that begin with ``__`` or are among ``results`` under names that nothing else has; {each column: its name there}).

    Inner columns begin with ``__``; what the input has under such names is kept out of their way and gets its name back with ``come_back``.
    """
    names, taken = {c: c for c in docs.columns}, {c.lower() for c in docs.columns}
    for c in docs.columns:
        if c.startswith("__") or c in results:
            new = f"own_of_{c.strip('_')}"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            names[c] = new
    return docs.withColumnsRenamed({c: new for c, new in names.items() if c != new}), names


def come_back(names: dict[str, str], *without: str) -> list[Column]:
    """The columns of ``stand_aside`` under their own names, but for those of ``without``."""
    return [F.col(new).alias(c) for c, new in names.items() if c not in without]


def row_uid(*cols: str):
    """64-bit key of a row: rows that agree in these columns share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


#: Bits of the id pre-filter: 2 MB, whatever the data.
FILTER_BITS = 1 << 24
#: Bits by which an id is shifted for its second place.
SECOND = 27


def id_filter(ids: DataFrame, uid: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of two bits an id over ``uid`` (long), gathered as at most ``bits / 64`` longs; ``bits`` is a power of two."""
    slots = F.explode(F.array(F.col(uid).bitwiseAND(F.lit(bits - 1)), F.shiftright(uid, SECOND).bitwiseAND(F.lit(bits - 1))))
    rows = (
        ids.select(slots.alias("s"))
        .select(F.shiftright("s", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return words


def has_ids(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of ``ids`` (64-bit) the filter has."""
    most = np.int64(len(words) * 64 - 1)
    out = np.ones(len(ids), bool)
    for slot in (ids & most, (ids >> np.int64(SECOND)) & most):
        out &= ((words[slot >> 6] >> (slot & 63)) & 1).astype(bool)
    return out


def _hits(batch: pa.RecordBatch, uid: str, words: np.ndarray) -> np.ndarray:
    return has_ids(batch.column(uid).to_numpy(zero_copy_only=False).astype(np.int64), words)


def keep_candidates(docs: DataFrame, uid: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``uid`` (long) occurs in ``ids`` (a stored table).

    The Bloom filter (fixed size) drops most other rows before the shuffle; where it is
    full it lets all through, and the semi join alone decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids, uid))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hits(batch, uid, sent.value)))

    return docs.mapInArrow(drop, docs.schema).join(ids.select(uid), uid, "left_semi")


def rows_in_filter(df: DataFrame, uid: str, words: np.ndarray) -> DataFrame:
    """Rows whose ``uid`` (long) the filter has: all that were put in, and some more."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hits(batch, uid, sent.value)))

    return df.mapInArrow(run, df.schema)


def drop_rows(docs: DataFrame, uid: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``uid`` (long) does not occur in ``ids`` (a stored table); only those that the filter has are shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids, uid))

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_hits(batch, uid, sent.value) == wanted))

        return docs.mapInArrow(run, docs.schema)

    return part(False).unionByName(part(True).join(ids.select(uid), uid, "left_anti"))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return pc.cast(batch.column(name), pa.binary()).to_pylist()


def open_folder(uri: str):
    """(file system, path) of a folder; any scheme that pyarrow opens on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write one file whole under its final, deterministic name.

    It is written aside and moved, so a lost or repeated task leaves either no file or
    the same bytes.
    """
    disk, path = open_folder(folder)
    disk.create_dir(path, recursive=True)
    aside = f"{path}/.{name}.{uuid.uuid4().hex[:8]}"
    with disk.open_output_stream(aside) as out:
        out.write(data)
    disk.move(aside, f"{path}/{name}")
    return f"{folder}/{name}"
