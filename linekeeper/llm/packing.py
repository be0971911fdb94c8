"""Best-fit packing of documents into fixed-length sequences, planned on the length histogram.

The plan is made over counts: for each length, longest first, the fullest sequences that
still take it are filled, whole runs of equal sequences at a time.  It has a size that
depends on the capacity only.  Documents then take the planned slots by their rank among
the pieces of their length: a task numbers its own pieces of each length as it cuts them,
and the counts of the tasks before it are added, so no task ever ranks a whole length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.llm.store import materialize, tidy
from linekeeper.llm.tokens import crc, default_path, encoded

CAPACITY = 4096


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """Slots for ``counts`` pieces of each length, and the number of sequences.

    Row (length, rank, n, sequence, per, offset): the n pieces of that length from ``rank``
    on go, ``per`` to a sequence, into sequences from ``sequence`` on, first at ``offset``.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []
    rows, opened = [], 0

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = room // length
            whole = min(n, left // per)
            if whole:
                rows.append((length, rank, whole * per, first, per, capacity - room))
                give(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            rest = n - whole
            if rest and 0 < left < per:
                rows.append((length, rank, left, first + whole, per, capacity - room))
                give(room - left * length, first + whole, 1)
                rank, left, whole, rest = rank + left, 0, whole + 1, rest - 1
            give(room, first + whole, rest)
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "per", "offset"], dtype="int64"), opened


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its number ``r`` among those of its length in ``task``; only documents over the capacity are cut."""
    path = tokenizer or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for ids, tokens in encoded(batches, path, id_col, text_col):
            row, piece, start, length, crcs, number = [], [], [], [], [], []
            for i, data in enumerate(tokens):
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crcs.append(crc(part))
                    number.append(seen[length[-1]])
                    seen[length[-1]] += 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crcs)], pa.array([task] * len(row), pa.int32()), pa.array(number, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "r"],
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, r long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of the rows of cut_pieces (a stored table: it is read three times, and its numbers stay)."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # one row for each length: at most ``capacity`` of them
    counts = {int(k): int(n) for k, n in per_task.groupBy("length").agg(F.sum("n")).collect()}
    plan, _ = plan_best_fit(counts, capacity)
    # a length's counts: one row for each task
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("r"))
    plan = plan.sort_values(["length", "rank"], ignore_index=True)
    sent = spark.sparkContext.broadcast({c: plan[c].to_numpy() for c in plan.columns})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        # lengths and their plan rows are sorted: a row's slot is the last plan row at or before (length, rank)
        first = np.searchsorted(p["length"], np.arange(capacity + 2))
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "r"))
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                own = n == length
                lo, hi = first[length], first[length + 1]
                at[own] = lo + np.searchsorted(p["rank"][lo:hi], r[own], side="right") - 1
            k = r - p["rank"][at]
            got = [p["sequence"][at] + k // p["per"][at], p["offset"][at] + k % p["per"][at] * n]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in got]], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(tidy(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: a row for each piece with its place.

    Null text counts as empty: one piece that holds the end id alone.  Repeated rows and
    ids get places of their own, null ids too; texts of any length are cut whole; an empty
    table gives no rows; other columns are ignored.
    """
    return pack_pieces(materialize(cut_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
