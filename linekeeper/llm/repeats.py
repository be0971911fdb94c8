"""Removal of repeated passages by suffix automata of reference shards.

Every window of consecutive words whose sequence also starts earlier is removed.

* A window is known by its anchor, the k-gram of least hash within it (winnowing).  The
  consecutive windows of one anchor form a segment, a stretch of text a little longer than
  a window.  Equal windows have equal anchors, so only segments whose anchor occurs again
  can hold a repeat; all others are skipped.
* Where all segments of an anchor are equal, each matches the earliest whole: no automaton
  is needed to find all its windows there.
* The reference is one copy, the earliest, of every different segment of the other anchors.
  It is dealt to shards by anchor; each shard gives compact suffix automata of a bounded
  size, whose states know where their words first occurred.  They lie in the shared folder,
  for any number of tasks to read.
* Documents' segments of these anchors all stream through their shard's automata.  The matching
  statistic at a word is the length of the longest stretch ending there that the reference
  holds; where it reaches the window's length, the state tells where the window first
  occurred, and it is a repeat if that is another place.  The maximal runs of such windows
  are removed.

A k-gram that very many places have is the anchor of a window only if all of the window's
k-grams are such: the edges of a common passage, which differ from document to document,
then have rare anchors and are skipped, and the passage itself is one segment.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import binary_column, drop_rows, has_ids, id_filter, keep_candidates, materialize, new_folder, open_folder, put_file, row_uid, rows_in_filter, tidy
from linekeeper.llm.words import hash_words, runs, split_words, windows

#: Words of a window and of the k-grams that anchor it.
WINDOW, GRAM = 20, 8
#: Words of the reference in one automaton.
SHARD_WORDS = 100_000
#: Words that a task streams, about.
TASK_WORDS = 3_000_000
#: Places from which on a k-gram counts as common; of larger tables one place in a million.
COMMON = 1 << 17
#: Bits of the filter over anchors that occur again (4 MB).
ANCHOR_BITS = 1 << 25


def segments(hashes: np.ndarray, window: int, gram: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the runs of windows that share an anchor; ``common``: filter of k-grams that come last."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = windows(hashes, gram)
    span = window - gram + 1
    rank = grams >> np.uint64(1)
    if common is not None:
        rank |= has_ids(grams.view(np.int64), common).astype(np.uint64) << np.uint64(63)
    place = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    return grams[place[first]], first, last


class SuffixAutomaton:
    """Online automaton of a set of sequences; a state knows where its longest words first ended."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.end = [-1]
        #: where each sequence begins
        self.starts: list[int] = []
        self.size = 0

    def _split(self, p: int, q: int, value: object) -> int:
        """The state of p's words with ``value``, which q holds together with longer ones."""
        nexts, link = self.next, self.link
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.end.append(self.end[q])
        link[q] = clone
        while p != -1 and nexts[p].get(value) == q:
            nexts[p][value] = clone
            p = link[p]
        return clone

    def add(self, values: list) -> None:
        """Append a sequence; nothing matches across its ends."""
        nexts, link, length, last = self.next, self.link, self.length, 0
        self.starts.append(self.size)
        for at, value in enumerate(values, self.size):
            q = nexts[last].get(value)
            if q is not None:
                last = q if length[last] + 1 == length[q] else self._split(last, q, value)
                continue
            cur = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            self.end.append(at)
            p = last
            while p != -1 and value not in nexts[p]:
                nexts[p][value] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][value]
                link[cur] = q if length[p] + 1 == length[q] else self._split(p, q, value)
            last = cur
        self.size += len(values)

    def packed(self, vocabulary: list[bytes], places: list[tuple[int, int]]) -> bytes:
        """Arrays of the automaton over word numbers, with the (uid, first window) of each sequence."""
        import zstandard

        step = lambda x: np.diff(np.array(x, np.int32), prepend=np.int32(0))  # mostly ones, which pack well
        out = np.array(list(map(len, self.next)), np.int32)
        values = np.array([v for x in self.next for v in x], np.int32)
        to = np.array([t for x in self.next for t in x.values()], np.int32) - np.repeat(np.arange(len(out), dtype=np.int32), out)
        parts = (b" ".join(vocabulary), out, values, to, np.array(self.link, np.int32), step(self.length), step(self.end), step(self.starts))
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((*parts, np.array([u for u, _ in places], np.int64), np.array([f for _, f in places], np.int32)), protocol=5))


class Reference:
    """A packed automaton, opened to be streamed through."""

    def __init__(self, raw: bytes) -> None:
        import zstandard

        words, out, values, to, link, length, end, starts, uids, firsts = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
        vocabulary = words.split(b" ")
        states = np.repeat(np.arange(len(out), dtype=np.int64), out)
        keys, to = states * len(vocabulary) + values, states + to
        self.number = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
        self.words = len(vocabulary)
        self.next = dict(zip(keys.tolist(), to.tolist(), strict=True))
        self.link = link.tolist()
        self.length, self.end, self.starts = (np.cumsum(x).tolist() for x in (length, end, starts))
        self.uids, self.firsts = uids.tolist(), firsts.tolist()

    def first_places(self, words: list[bytes], window: int) -> dict[int, tuple[int, int]]:
        """{start of a window within ``words``: (uid, window) where it first occurs}, by matching statistics."""
        nexts, link, length, n = self.next, self.link, self.length, self.words
        out, state, size = {}, 0, 0
        for i, v in enumerate(map(self.number.get, words)):
            if v is None:
                state = size = 0
                continue
            to = nexts.get(state * n + v)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts.get(state * n + v)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    size = length[state]
                k = bisect_right(self.starts, self.end[state]) - 1
                out[i - window + 1] = (self.uids[k], self.firsts[k] + self.end[state] - self.starts[k] - window + 1)
        return out


def _texts(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, hashes of its words, UTF-8 text); bytes.split() gives the words."""
    texts = batch.column(text_col)
    raw = binary_column(batch, text_col)
    for a, b in runs(texts):
        words, ends = split_words(texts.slice(a, b - a))
        hashes = hash_words(words)
        for i in range(b - a):
            yield a + i, hashes[ends[i] : ends[i + 1]], raw[a + i] or b""


SEGMENTS = "anchors array<long>, firsts array<int>, sizes array<int>"


def _segment_lists(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.ListArray]:
    """The columns of SEGMENTS, from the segments of each text."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _, _ in made])]).astype(np.int32))
    columns = [[a.view(np.int64) for a, _, _ in made], [f.astype(np.int32) for _, f, _ in made], [(z - f + 1).astype(np.int32) for _, f, z in made]]
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else np.zeros(0, k))) for c, k in zip(columns, (np.int64, np.int32, np.int32), strict=True)]


def describe(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, n_words, sha (of the words joined by spaces) and the anchors, first windows and numbers of windows of its segments (stored)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, made = [], [], []
            for _, hashes, text in _texts(batch, text_col):
                n.append(len(hashes))
                sha.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                made.append(segments(hashes, window, gram))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column(id_col), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *_segment_lists(made)],
                ["uid", "doc_id", "n_words", "sha", "anchors", "firsts", "sizes"],
            )

    rows = docs.select(row_uid(id_col, text_col).alias("uid"), id_col, text_col)
    return materialize(rows.mapInArrow(tidy(run), f"uid long, doc_id {kind}, n_words long, sha string, {SEGMENTS}"), "segments")


def _holding(own: DataFrame, common: np.ndarray) -> DataFrame:
    """uids of the documents with an anchor in the filter."""
    sent = own.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column("anchors")
            hit = has_ids(anchors.flatten().to_numpy(zero_copy_only=False), sent.value)
            total = np.concatenate([[0], np.cumsum(hit)])
            ends = np.concatenate([[0], np.cumsum(anchors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid").filter(pa.array(total[ends[1:]] > total[ends[:-1]]))], ["uid"])

    return own.select("uid", "anchors").mapInArrow(tidy(run), "uid long").distinct()


def common_grams(rows: DataFrame, own: DataFrame, anchors: DataFrame, least: int, window: int, gram: int, text_col: str) -> np.ndarray | None:
    """Filter (of fixed size) of the k-grams that windows with a common anchor hold ``least`` times or more; None if no anchor is common.

    Least grows with the table, so that at most a million anchors are common.
    """
    hot = anchors.filter(F.col("n") >= least)
    if hot.isEmpty():
        return None
    first = id_filter(hot.select("anchor"), "anchor")
    texts = keep_candidates(rows, "uid", materialize(_holding(own, first), "common-holders"))
    sent = rows.sparkSession.sparkContext.broadcast(first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for _, hashes, _ in _texts(batch, text_col):
                a, lo, hi = segments(hashes, window, gram)
                hit = has_ids(a.view(np.int64), sent.value)
                step = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(step, lo[hit], 1)
                np.add.at(step, np.minimum(hi[hit] + window - gram + 1, len(hashes)), -1)
                grams = windows(hashes, gram)
                held.append(grams[np.cumsum(step)[: len(grams)] > 0])
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["gram", "n"])

    grams = texts.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return id_filter(grams, "gram")


def _anchors_anew(rows: DataFrame, own: DataFrame, common: np.ndarray, window: int, gram: int, text_col: str) -> DataFrame:
    """``own`` with the anchors of the documents that have a common one taken anew, common k-grams last (stored).

    The others' anchors are not common, hence stay the same under that order.
    """
    held = materialize(_holding(own, common), "common-documents")
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [segments(hashes, window, gram, sent.value) for _, hashes, _ in _texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *_segment_lists(made)], ["uid", "anchors", "firsts", "sizes"])

    new = keep_candidates(rows, "uid", held).mapInArrow(tidy(run), f"uid long, {SEGMENTS}").dropDuplicates(["uid"])
    kept = drop_rows(own, "uid", held)
    return materialize(kept.unionByName(keep_candidates(own.drop("anchors", "firsts", "sizes"), "uid", held).join(new, "uid")), "segments-anew")


def _shared(reps: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """uid, doc_id and ``held`` (anchor, first window, windows) of documents' segments whose anchor is among ``anchors`` (stored).

    Up to ``most`` anchors the filter alone decides, which lets a few others through; they
    hold no repeat and cost their space only.  With more the segments meet the anchors.
    """
    sent = reps.sparkSession.sparkContext.broadcast(id_filter(anchors, "anchor", ANCHOR_BITS))
    kind = reps.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("anchors", "firsts", "sizes")]
            hit = has_ids(lists[0].flatten().to_numpy(zero_copy_only=False), sent.value)
            ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            kept = np.concatenate([[0], np.cumsum(hit)])[ends].astype(np.int32)
            flat = pa.StructArray.from_arrays([x.flatten().filter(pa.array(hit)) for x in lists], ["anchor", "first", "size"])
            out = pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(kept), flat)], ["uid", "doc_id", "held"])
            yield out.filter(pa.array(kept[1:] > kept[:-1]))

    found = reps.select("uid", "doc_id", "anchors", "firsts", "sizes").mapInArrow(tidy(run), f"uid long, doc_id {kind}, held array<struct<anchor: long, first: int, size: int>>")
    if anchors.count() > most:
        places = found.select("uid", "doc_id", F.explode("held").alias("h")).select("uid", "doc_id", "h.*").join(anchors.select("anchor"), "anchor", "left_semi")
        found = places.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("anchor", "first", "size")).alias("held"))
    return materialize(found, "shared")


def _cut(docs: DataFrame, shared: DataFrame, window: int, text_col: str) -> DataFrame:
    """A row for each shared segment: uid, doc_id, anchor, first window, n words, key of its words, words joined by spaces."""
    kind = shared.schema["doc_id"].dataType.simpleString()
    rows = keep_candidates(docs, "uid", shared.select("uid")).join(shared, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("held")
            for i, text in enumerate(binary_column(batch, text_col)):
                own = wanted[i].values
                first, size = own.field("first"), pc.add(own.field("size"), pa.scalar(window - 1, pa.int32()))
                raw = text.split()
                texts = [b" ".join(raw[a : a + n]) for a, n in zip(first.to_pylist(), size.to_pylist(), strict=True)]
                one = pa.array(np.full(len(texts), i, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").take(one),
                        batch.column("doc_id").take(one),
                        own.field("anchor"),
                        first,
                        size,
                        pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                        pa.array(texts, pa.binary()),
                    ],
                    ["uid", "doc_id", "anchor", "first", "n", "key", "words"],
                )

    return rows.mapInArrow(tidy(run), f"uid long, doc_id {kind}, anchor long, first int, n int, key long, words binary")


def build_reference(heads: DataFrame, folder: str, parts: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write the automata of the segments (shard, doc_id, uid, first, words), earliest first; returns (shard, file), stored.

    A shard's files are numbered in the order of its segments; each has ``shard_words`` words or little more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, shard, made = TaskContext.get().partitionId(), 0, None, []
        automaton, number, places = SuffixAutomaton(), {}, []

        def close() -> None:
            nonlocal automaton, number, places, k
            if places:
                made.append((shard, put_file(f"{folder}/{shard:012d}", f"{task:08d}-{k:06d}", automaton.packed(list(number), places))))
                automaton, number, places, k = SuffixAutomaton(), {}, [], k + 1

        for batch in batches:
            for s, u, f, w in zip(*(batch.column(c).to_pylist() for c in ("shard", "uid", "first", "words")), strict=True):
                if s != shard or automaton.size >= shard_words:
                    close()
                    shard = s
                automaton.add([number.setdefault(x, len(number)) for x in w.split(b" ")])
                places.append((u, f))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], ["shard", "file"])

    ordered = heads.repartitionByRange(parts, "shard", "doc_id", "uid", "first").sortWithinPartitions("shard", "doc_id", "uid", "first")
    return materialize(ordered.select("shard", "uid", "first", "words").mapInArrow(tidy(run), "shard long, file string"), "automata")


def open_references(folder: str, shard: int) -> Iterator[Reference]:
    """A shard's automata, one at a time, in the order of their segments."""
    from pyarrow import fs

    disk, path = open_folder(f"{folder}/{shard:012d}")
    for file in sorted(x.path for x in disk.get_file_info(fs.FileSelector(path)) if not x.base_name.startswith(".")):
        with disk.open_input_stream(file) as f:
            yield Reference(f.read())


def place_runs(found: dict[int, tuple[int, int]]) -> list[list[int]]:
    """Windows with the places where they first occur, as runs [from, to, uid, window there] that go on there too."""
    out: list[list[int]] = []
    for at, (u, f) in sorted(found.items()):
        if out and out[-1][1] == at - 1 and out[-1][2] == u and f - at == out[-1][3] - out[-1][0]:
            out[-1][1] = at
        else:
            out.append([at, at, u, f])
    return out


def stream(rows: DataFrame, folder: str, parts: int, window: int) -> DataFrame:
    """(uid, a, b): runs of windows, from a to b, that first occur elsewhere; ``rows``: shard, uid, first, words of every segment.

    Tasks get ranges of (shard, uid, first), so a hot shard is dealt to several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            seen: dict[bytes, dict] = {words: {} for _, _, words in held}  # equal texts stream once a task
            for reference in open_references(folder, shard):
                for words, found in seen.items():
                    for at, place in reference.first_places(words.split(b" "), window).items():
                        found.setdefault(at, place)  # files are in the order of places: the first to hold a window decides
            spans = {words: place_runs(found) for words, found in seen.items()}
            rows = [(u, f + a, f + b) for u, f, words in held for a, b, *place in spans[words] if place != [u, f + a]]
            uids, first, last = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["uid", "a", "b"])

        for batch in batches:
            for s, u, f, w in zip(*(batch.column(c).to_pylist() for c in ("shard", "uid", "first", "words")), strict=True):
                if s != shard:
                    if held:
                        yield done()
                    shard, held = s, []
                held.append((u, f, w))
        if held:
            yield done()

    ordered = rows.select("shard", "uid", "first", "words").repartitionByRange(parts, "shard", "uid", "first").sortWithinPartitions("shard", "uid", "first")
    return ordered.mapInArrow(tidy(run), "uid long, a int, b int")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    shard_words: int = SHARD_WORDS,
    common_places: int = COMMON,
    filter_anchors: int = ANCHOR_BITS // 16,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row.

    Null texts have no words.  Rows that repeat id and text are one document and get equal
    results; rows with one id and other texts are separate, in the order of a hash; null
    ids come first; texts of any length are judged whole; other columns are ignored; an
    empty table gives no rows.
    """
    own = describe(docs, window, gram, id_col, text_col)
    nothing = hashlib.sha256(b"").hexdigest()
    # equal word sequences: the later ones hold nothing that doesn't start earlier; stored, so that a hot one's partition can be split
    order = F.struct(F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    firsts = materialize(own.groupBy("sha").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).select("sha", F.col("f.u").alias("f")), "firsts")
    told = materialize(own.select("uid", "doc_id", "n_words", "sha").join(firsts, "sha").withColumn("is_first", F.col("uid") == F.col("f")).drop("f"), "told")
    rows = docs.select(row_uid(id_col, text_col).alias("uid"), F.col(text_col))
    reps = drop_rows(own, "uid", told.filter("not is_first").select("uid")).filter(f"n_words >= {window}")
    reps = materialize(reps.drop("n_words", "sha"), "first-copies")

    def often(reps: DataFrame) -> DataFrame:
        anchors = reps.select(F.explode_outer("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        return materialize(anchors.filter("n > 1 and anchor is not null"), "often")

    anchors = often(reps)
    total = anchors.agg(F.sum("n")).first()[0] or 0
    common = common_grams(rows, reps, anchors, max(common_places, total >> 20), window, gram, text_col)
    if common is not None:
        reps = _anchors_anew(rows, reps, common, window, gram, text_col)
        anchors = often(reps)
    shared = _shared(reps, anchors, filter_anchors)
    cut = materialize(_cut(rows, shared, window, text_col), "cut")
    place = F.struct("doc_id", "uid", "first")
    merged = materialize(cut.groupBy("anchor", "key").agg(F.min(place).alias("f"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "merged")
    several = materialize(merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"), "several")
    # all of an anchor's segments are equal: each but the earliest is a run of repeats; of two stored sides, so that a hot one can be split
    alone = materialize(merged.filter("copies > 1").join(several, "anchor", "left_anti").select("anchor", "key", "f"), "alone")
    copies = cut.select("uid", "doc_id", "first", "n", "anchor", "key").join(alone, ["anchor", "key"]).filter(place != F.col("f"))
    copies = copies.select("uid", F.col("first").alias("a"), (F.col("first") + F.col("n") - window).alias("b"))
    # the others, and some more that the filter lets through
    mask = id_filter(several, "anchor")
    wanted = rows_in_filter(merged.select("anchor", "f.uid", "f.first", "n"), "anchor", mask)
    wanted = materialize(wanted.select(F.xxhash64("uid", "first").alias("segment"), "n"), "heads")
    streamed = rows_in_filter(cut.select("anchor", "doc_id", "uid", "first", "n", "words"), "anchor", mask)
    shards = max(1, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // shard_words))
    parts = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // TASK_WORDS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    folder = new_folder(docs.sparkSession, "reference")
    heads = keep_candidates(streamed.select(F.xxhash64("uid", "first").alias("segment"), shard, "doc_id", "uid", "first", "words"), "segment", wanted.select("segment"))
    build_reference(heads, folder, min(parts, shards), shard_words)
    found = stream(streamed.select(shard, "uid", "first", "words"), folder, parts, window).unionByName(copies)
    starts = found.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    starts = materialize(starts, "starts")
    changed = keep_candidates(rows, "uid", starts.select("uid")).join(starts, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, left = [], [], []
            for i, text in enumerate(binary_column(batch, text_col)):
                words = (text or b"").split()
                spans = batch.column("runs")[i].values
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, spans.field("a").to_numpy(), 1)
                np.add.at(step, spans.field("b").to_numpy() + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join(compress(words, (~gone).tolist()))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["uid", "removed", "kept", "kept_text"])

    cut_docs = changed.mapInArrow(tidy(run), "uid long, removed long, kept string, kept_text string").dropDuplicates(["uid"])
    copy = ~F.col("is_first") & (F.col("n_words") >= window)
    out = told.join(cut_docs, "uid", "left").select(
        "uid",
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def op6_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
