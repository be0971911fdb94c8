"""Trie of conversations that share their first turns, from a sorted stream.

A conversation is a path of turn digests.  Paths are dealt out by range, so that what a
node holds lies together, and every task sorts its range externally: sorted runs in the
shared folder keep, for each path, the turns that it shares with the one before (LCP) and
the rest alone; a loser tree merges them and compares only turns behind those that are
known to be shared.  Nodes along the current path are open, on a stack; whatever the next
path does not share is finished.

Nodes on the first and the last path of a task may go on in its neighbours.  Their parts
are added by key, and what two neighbours both counted, the turns that their touching paths
share, is taken off once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import materialize, new_folder, open_folder, tidy

#: Characters of a turn's digest in a path.
WIDTH = 24
#: Bytes of paths (and 64 a row) that are sorted at once.
RUN_BYTES = 32 << 20
#: Runs that are merged at once, and rows of a run that are read at once.
FAN_IN, READ_ROWS = 64, 1000
#: Finished children that wait for their parent's smallest member.
WAITING = 10_000
#: Ids of one piece of a list of ends.
ENDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest of role and text, words of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.base64(F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    kept = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(rows: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, path, words): conversation c begins with the first h turns of c - c % ``group``, then its own behind its first h; h = crc32(c) % ``most``."""
    turns = materialize(turn_lists(rows), "turn-lists")
    base = turns.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    own = turns.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    joined = own.join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    path = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return paths_of(joined.select("conv_id", path.alias("turns")))


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words) of (conv_id, turns): digests in a row, and the words of each turn."""
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


# -- Sorted runs with LCPs -----------------------------------------------------


def shared_turns(a: str, b: str, start: int = 0) -> int:
    """Turns that two paths share, ``start`` of them known to be shared."""
    n, most = start, min(len(a), len(b)) // WIDTH
    while n < most and a[n * WIDTH : (n + 1) * WIDTH] == b[n * WIDTH : (n + 1) * WIDTH]:
        n += 1
    return n


def with_lcps(rows: list[tuple]) -> Iterator[tuple]:
    """(path, conv_id, words, turns shared with the row before) of sorted rows."""
    before = ""
    for path, conv, words in rows:
        yield path, conv, words, shared_turns(before, path)
        before = path


def write_run(folder: str, rows: Iterator[tuple]) -> str:
    """A run: of each row only the turns behind the shared ones are kept."""
    disk, at = open_folder(folder)
    disk.create_dir(at, recursive=True)
    name = f"{at}/{uuid.uuid4().hex}.run"
    kind = pa.schema([("lcp", pa.int64()), ("tail", pa.string()), ("words", pa.list_(pa.int64())), ("conv", pa.int64())])
    with disk.open_output_stream(name) as out, pa.ipc.new_stream(out, kind) as sink:
        held = []

        def flush() -> None:
            if held:
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind))
                held.clear()

        for path, conv, words, lcp in rows:
            held.append((lcp, path[lcp * WIDTH :], words[lcp:], conv))
            if len(held) == READ_ROWS:
                flush()
        flush()
    return name


def read_run(folder: str, name: str) -> Iterator[tuple]:
    disk, _ = open_folder(folder)
    path, words = "", []
    with disk.open_input_stream(name) as raw, pa.ipc.open_stream(raw) as source:
        for batch in source:
            for lcp, tail, own, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path, words = path[: lcp * WIDTH] + tail, words[:lcp] + own
                yield path, conv, words, lcp


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One sorted stream with LCPs of sorted streams with LCPs, through a tree of losers.

    The head of each run knows how many turns it shares with the row that went out last.
    Of two heads the one that shares more comes first, and what the other shares with it is
    known too; turns are compared only where both share as many, and behind these.
    """
    heads: list[tuple | None] = [next(r, None) for r in runs]
    n = len(runs)
    lcp = [0] * n
    losers = [-1] * n

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = shared_turns(x[0], y[0], lcp[a])
        tail_x, tail_y = x[0][k * WIDTH : (k + 1) * WIDTH], y[0][k * WIDTH : (k + 1) * WIDTH]
        win, lose = (a, b) if (tail_x, x[1], a) <= (tail_y, y[1], b) else (b, a)
        lcp[lose] = k
        return win, lose

    # played from the leaves (n to 2n - 1) up to node 1; node k keeps its loser
    winners = [-1] * n + list(range(n))
    for k in range(n - 1, 0, -1):
        winners[k], losers[k] = first(winners[2 * k], winners[2 * k + 1])
    top = winners[1] if n > 1 else 0
    while heads[top] is not None:
        path, conv, words, _ = heads[top]
        yield path, conv, words, lcp[top]
        heads[top] = next(runs[top], None)
        lcp[top] = heads[top][3] if heads[top] is not None else 0
        k = (top + n) >> 1
        while k >= 1:
            top, losers[k] = first(top, losers[k])
            k >>= 1


def sorted_stream(batches: Iterator[pa.RecordBatch], folder: str, run_bytes: int = RUN_BYTES) -> Iterator[tuple]:
    """(path, conv_id, words, LCP) of all rows in the order of (path, conv_id), in bounded memory."""
    held, size, names = [], 0, []

    def run() -> Iterator[tuple]:
        held.sort(key=lambda r: (r[0], r[1]))
        return with_lcps(held)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "words")), strict=True):
            held.append(row)
            size += len(row[0]) + 64
            if size > run_bytes:
                names.append(write_run(folder, run()))
                held, size = [], 0
    if not names:
        yield from run()
        return
    if held:
        names.append(write_run(folder, run()))
        held = []
    disk, _ = open_folder(folder)
    try:
        while len(names) > FAN_IN:
            part, names = names[:FAN_IN], names[FAN_IN:]
            names.append(write_run(folder, merged([read_run(folder, x) for x in part])))
            for x in part:
                disk.delete_file(x)
        yield from merged([read_run(folder, x) for x in names])
    finally:
        for x in names:
            disk.delete_file(x)


# -- Open nodes ----------------------------------------------------------------


def child_key(key: bytes, digest: str) -> bytes:
    return hashlib.blake2b(key + digest.encode(), digest_size=16).digest()


ROOT = hashlib.blake2b(b"", digest_size=16).digest()
FIELDS = (
    "kind string, task int, seq int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, wanted boolean, ids binary, path string, words array<long>"
)
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


class Node:
    __slots__ = ("key", "parent_key", "depth", "words", "n", "least", "children", "leaves", "saved", "ends", "waiting", "edge", "wanted")

    def __init__(self, key: bytes, parent_key: bytes | None, depth: int, words: int, edge: bool) -> None:
        self.key, self.parent_key, self.depth, self.words, self.edge = key, parent_key, depth, words, edge
        self.n, self.least, self.children, self.leaves, self.saved, self.wanted = 0, None, 0, 0, 0, False
        self.ends: list[int] = []
        self.waiting: list[dict] = []


def ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class OpenPath:
    """Nodes of one task: finished ones go out as rows, those that neighbours may hold too as parts."""

    def __init__(self, task: int) -> None:
        self.task, self.rows, self.stack = task, [], []
        self.first = self.last = None

    def take(self, path: str, conv: int, words: list[int], lcp: int) -> None:
        edge = self.last is None
        if edge:
            self.first = (path, words)
            self.stack.append(Node(ROOT, None, 0, 0, True))
        while len(self.stack) - 1 > lcp:
            self._close(self.stack.pop())
        for d in range(len(self.stack) - 1, len(path) // WIDTH):
            above = self.stack[-1]
            self.stack.append(Node(child_key(above.key, path[d * WIDTH : (d + 1) * WIDTH]), above.key, d + 1, words[d], edge))
        top = self.stack[-1]
        top.ends.append(conv)
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        self.last = (path, words)

    def _close(self, node: Node) -> None:
        """Finish a node that is off the stack: its sums go to the node above, its row out or to wait there."""
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        row = {
            "kind": "part" if node.edge else "node", "task": self.task, "key": node.key, "parent_key": node.parent_key, "depth": node.depth, "conv_id": node.least,
            "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "wanted": node.wanted,
        }
        end = node.depth * WIDTH
        if node.edge and node.ends and end in (len(self.first[0]), len(self.last[0])):
            self._pieces(node)
        else:
            row["ends_sha256"] = ends_digest(node.ends) if node.ends or not node.edge else None
        for child in node.waiting:
            child["parent_conv_id"] = None if node.edge else node.least
        self.rows += node.waiting
        if node.parent_key is not None:
            above = self.stack[-1]
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            if not node.edge:
                above.waiting.append(row)
                if len(above.waiting) > WAITING:  # these find their parent by its key
                    self.rows += above.waiting
                    above.waiting, above.wanted = [], True
                return
        self.rows.append(row)

    def _pieces(self, node: Node) -> None:
        for k in range(0, len(node.ends), ENDS):
            self.rows.append({"kind": "ends", "task": self.task, "seq": k // ENDS, "key": node.key, "ids": np.array(node.ends[k : k + ENDS], "<i8").tobytes()})

    def close(self) -> None:
        """End of the task: what is open may go on in the next one."""
        for node in self.stack:
            node.edge = True
        while self.stack:
            self._close(self.stack.pop())
        if self.last is not None:
            for kind, (path, words) in (("first", self.first), ("last", self.last)):
                self.rows.append({"kind": kind, "task": self.task, "path": path, "words": words})


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _rows_out(rows: list[dict]) -> pa.RecordBatch:
    kinds = [KINDS[x.split()[1]] for x in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(NAMES, kinds, strict=True)], names=NAMES)


def corrections(path: str, words: list[int], after: str) -> list[tuple[bytes, int, int, int]]:
    """(key, children, leaves, saved tokens) to add to the nodes that a task's last path shares with the next task's first."""
    n = shared_turns(path, after)
    # the next path goes on where this one ends: its last node was no leaf, or is one of both
    leaf = -1 if n == len(path) // WIDTH else 0
    key, left, out = ROOT, sum(words[:n]), []
    out.append((key, -1 if n else 0, leaf, left))
    for d in range(1, n + 1):
        key = child_key(key, path[(d - 1) * WIDTH : d * WIDTH])
        out.append((key, -1 if d < n else 0, leaf, left))
        left -= words[d - 1]
    return out


def _touching(edges: DataFrame) -> DataFrame:
    """Corrections between each task and the next that has rows; the driver sees the tasks' numbers alone."""
    tasks = sorted(r.task for r in edges.filter("kind = 'first'").select("task").collect())
    spark = edges.sparkSession
    after = spark.createDataFrame(list(zip(tasks, tasks[1:], strict=False)), "task int, next int")
    last = edges.filter("kind = 'last'").select("task", "path", "words")
    first = edges.filter("kind = 'first'").select(F.col("task").alias("next"), F.col("path").alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, words, other in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "after")), strict=True):
                cols = zip(*corrections(path, words, other), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.binary(), *[pa.int64()] * 3), strict=True)], names=["key", "n_children", "n_leaves", "saved_tokens"])

    return last.join(after, "task").join(first, "next").mapInArrow(run, "key binary, n_children long, n_leaves long, saved_tokens long")


def _digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256) of lists of ends that come in pieces: read in order, never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "all_ends"])

        for batch in batches:
            for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                text = ",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode()
                if own != key:
                    if key is not None:
                        yield out()
                    key, state = own, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if key is not None:
            yield out()

    return pieces.select("key", "task", "seq", "ids").repartition("key").sortWithinPartitions("key", "task", "seq").mapInArrow(run, "key binary, all_ends string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(paths: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row for each node of the trie of ``paths`` (conv_id, path, words as ``paths_of`` makes them).

    Without paths there are no nodes; a conversation without turns ends at the root.  One
    path (32 bytes a turn) is held whole, as are the ids that end at one node of a task's
    range; a node whose ends lie in many tasks has them read in pieces.  Where many
    conversations are equal, their ids divide them among tasks.
    """
    spark = paths.sparkSession
    folder = new_folder(spark, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OpenPath(TaskContext.get().partitionId())
        for row in sorted_stream(batches, folder, run_bytes):
            own.take(*row)
            if len(own.rows) > 2000:
                yield _rows_out(own.rows)
                own.rows = []
        own.close()
        for k in range(0, len(own.rows), 2000):
            yield _rows_out(own.rows[k : k + 2000])

    made = materialize(paths.repartitionByRange("path", "conv_id").mapInArrow(tidy(run), FIELDS), "trie")
    nodes = made.filter("kind = 'node'")
    parts = made.filter("kind = 'part'")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    all_parts = parts.select("key", "parent_key", "depth", "conv_id", "ends_sha256", *sums).unionByName(_touching(made.filter("kind in ('first', 'last')")), allowMissingColumns=True)
    whole = all_parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("own_ends"), *[F.sum(c).alias(c) for c in sums])
    whole = whole.join(_digests(made.filter("kind = 'ends'")), "key", "left")
    whole = materialize(whole.withColumn("ends_sha256", F.coalesce("all_ends", "own_ends", F.sha2(F.lit("").cast("binary"), 256))), "spines")
    parents = whole.select("key", "conv_id").unionByName(nodes.filter("wanted").select("key", "conv_id")).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.filter(F.col("parent_conv_id").isNotNull()).select(*RESULT)
    mine = [c for c in RESULT if c != "parent_conv_id"]
    open_ = nodes.filter(F.col("parent_conv_id").isNull()).select("parent_key", *mine).unionByName(whole.filter("depth > 0").select("parent_key", *mine))
    root = whole.filter("depth = 0").select(*mine, F.lit(None).cast("long").alias("parent_conv_id"))
    return known.unionByName(open_.join(parents, "parent_key").select(*RESULT)).unionByName(root.select(*RESULT))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Turns without conv_id belong to no conversation; turns that share a number come in the order of a digest of role and text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(materialize(rebuilt(rows), "paths"))
