"""Alignment of two tokenizers' tokens by byte, and how often their ids are linked.

Either tokenizer's token ends are sums of its tokens' bytes.  Bytes where tokens of both
end cut a text into groups, and every token of one in a group is linked with every one of
the other.  All of it is done for a run of texts at a time: sums, common ends, labels by
search, links by repetition, in blocks.

How many documents hold a pair of ids linked is counted in each task, then by pair and
salt, then by pair.  The most frequent pairs, a fixed number at most, are sent to all tasks
with their counts; a document's other pairs meet theirs in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.prefix_bpe import IRREGULAR, Kept
from linekeeper.llm.store import materialize, tidy
from linekeeper.llm.words import runs

#: Links that are written out together.
BLOCK_LINKS = 1 << 22
#: Pairs that a task counts before it passes its counts on.
BLOCK_PAIRS = 1 << 21
#: Shares of a pair's counts in the first of the two shuffles.
SALTS = 16
#: Pairs that are sent to all tasks, at most (4 MB).
SENT_PAIRS = 1 << 18
#: Words of either cache half.
CACHE = 400_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level tokens: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of texts that stand after a space, each id's bytes, and whether a text's ids are those of its words in a row, each after a space."""

    PROBES = ("one two", "It's 3.5, isn't it?", "a <s>b</s> |c", "Ünï cödé 日本 \U0001f600x", "x y\n\nz\tw", "</s> <|endoftext|> <unk>")

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]) -> None:
        self.encode_whole, self.bytes_of = encode, token_bytes
        self.lengths = np.array([len(x) for x in token_bytes], np.int64)
        self.by_word = all(encode([p])[0] == [i for x in encode(p.split(" ")) for i in x] for p in self.PROBES)


def byte_level_side(path: str) -> Side:
    """A byte-level tokenizer of the tokenizers library; it encodes a space and the text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = byte_letters()
    table = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Side(lambda texts: [x.ids for x in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], table)


def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a space before the text; empty texts have no ids there."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(own.id_to_piece(i)[1:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
    return Side(lambda texts: own.encode(texts, num_threads=1), table)


def spells(side: Side, text: bytes, ids: np.ndarray) -> bool:
    """Whether the tokens' bytes are a space and the text, which isn't empty."""
    return len(text) > 0 and int(side.lengths[ids].sum()) == len(text) + 1 and b"".join(map(side.bytes_of.__getitem__, ids.tolist())) == b" " + text


class Aligner:
    """Groups and links of a run of texts.

    Distinct words are encoded once by both and kept, where that gives a text's ids; texts
    in which white space follows a space are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = byte_level_side(path_a), piece_side(path_b)
        self.by_word, self.words = self.a.by_word and self.b.by_word, Kept(CACHE)
        self.n_b = len(self.b.bytes_of)
        self.pairs = len(self.a.bytes_of) * self.n_b
        self.kind = "<u4" if self.pairs <= 1 << 32 else "<u8"
        n = len(self.a.bytes_of)
        # an id of A in a group, at a group's begin, at a text's begin; an id of B in a group, at its begin
        self.marks = [b"%s%d" % (mark, i) for mark, count in ((b",", n), (b";", n), (b"", n), (b",", self.n_b), (b"|", self.n_b)) for i in range(count)]

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both tokenizers for each of distinct words, and whether both spell a space and it."""
        fresh = self.words.missing(words)
        for x in range(0, len(fresh), 5000):
            part = fresh[x : x + 5000]
            both = [side.encode_whole(part) for side in (self.a, self.b)]
            spelt = [[b"".join(map(side.bytes_of.__getitem__, i)) == b" " + w.encode() for i, w in zip(ids, part, strict=True)] for side, ids in zip((self.a, self.b), both, strict=True)]
            new = [(np.array(i, "<u4").tobytes(), np.array(j, "<u4").tobytes(), x and y) for i, j, x, y in zip(*both, *spelt, strict=True)]
            self.words.young.update(zip(part, new, strict=True))
        return list(map(self.words.young.__getitem__, words))

    def ids(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of both tokenizers for each text of a string array without nulls, none for an empty one; and whether all its words are known to be spelt."""
        odd = pc.or_(pc.match_substring_regex(texts, f"{IRREGULAR}|^[ ]|[ ]$|^$"), not self.by_word)
        if pc.any(odd).as_py():
            regular = texts.filter(pc.invert(odd))
            plain = iter(zip(*self.ids(regular), strict=True)) if len(regular) else iter(())
            alone = lambda t: (*(np.array(side.encode_whole([t])[0] if t else [], "<u4") for side in (self.a, self.b)), False)
            got = [alone(t.as_py()) if x.as_py() else next(plain) for t, x in zip(texts, odd, strict=True)]
            return tuple([x[k] for x in got] for k in (0, 1, 2))
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        values, at = self._words(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        unspelt = np.concatenate([[0], np.cumsum(~np.array([v[2] for v in values], bool)[at])])[words]
        return *(self._in_a_row([v[k] for v in values], at, words) for k in (0, 1)), (np.diff(unspelt) == 0).tolist()

    @staticmethod
    def _in_a_row(values: list[bytes], at: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts whose words begin and end at ``words``, each the value at ``at``."""
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts = np.cumsum(sizes) - sizes
        size = sizes[at]
        ends = np.cumsum(size)
        out = flat[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[words]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def align(self, texts: pa.Array) -> dict[str, list]:
        """Columns of one row for each text of an array without nulls."""
        raw = pc.cast(texts, pa.binary()).to_pylist()
        ids_a, ids_b, sure = self.ids(texts)
        good = [s or (spells(self.a, t, x) and spells(self.b, t, y)) for t, x, y, s in zip(raw, ids_a, ids_b, sure, strict=True)]
        none = np.zeros(0, "<u4")
        ids_a, ids_b = ([x if g else none for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        docs = len(raw)
        flat_a, flat_b = (np.concatenate([*ids, none]).astype(np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.a.lengths[flat_a]), np.cumsum(self.b.lengths[flat_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # groups before each text's end: a text ends where its last token does
        text_end = np.cumsum([len(t) + 1 if g else 0 for t, g in zip(raw, good, strict=True)])
        upto = np.searchsorted(cuts, text_end, side="right")
        groups = np.diff(upto, prepend=0)
        links = np.diff(np.concatenate([[0], np.cumsum(in_a * in_b)])[upto], prepend=0)
        pairs, times, of = self._links(flat_a, flat_b, group_a, in_a, in_b, np.repeat(np.arange(docs), n_a), docs)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "groups": self._spelled(flat_a, flat_b, group_a, group_b, in_a, in_b, n_a, n_b, good),
            "pairs": [shuffled(pairs[x:y].astype(self.kind)) for x, y in zip(of[:-1], of[1:], strict=True)], "times": [shuffled(times[x:y].astype("<u4")) for x, y in zip(of[:-1], of[1:], strict=True)],
        }

    def _spelled(self, flat_a, flat_b, group_a, group_b, in_a, in_b, n_a, n_b, good) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        size = len(self.a.bytes_of)
        first_a = np.diff(group_a, prepend=-1) > 0
        first_b = np.diff(group_b, prepend=-1) > 0
        kind = first_a.astype(np.int64)
        begins = (np.cumsum(n_a) - n_a)[n_a > 0]
        kind[begins] = 2
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        marks = np.empty(len(flat_a) + len(flat_b), np.int64)
        marks[np.arange(len(flat_a)) + before_b[group_a]] = flat_a + kind * size
        marks[np.arange(len(flat_b)) + before_a[group_b]] = 3 * size + flat_b + first_b * self.n_b
        ends = np.cumsum(n_a + n_b).tolist()
        table = self.marks.__getitem__
        return [b"".join(map(table, marks[a:b].tolist())) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _links(self, flat_a, flat_b, group_a, in_a, in_b, doc, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs of each text, how often it holds each, where each text's begin and the last ends)."""
        if docs * self.pairs >= 1 << 62:
            raise ValueError("too many texts in a run for vocabularies of this size")
        partners = in_b[group_a]
        first = (np.cumsum(in_b) - in_b)[group_a]
        so_far = np.cumsum(partners)
        keys, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while a < len(flat_a):
            b = max(a + 1, int(np.searchsorted(so_far, (so_far[a - 1] if a else 0) + BLOCK_LINKS, side="right")))
            n = partners[a:b]
            ends = np.cumsum(n)
            mine = np.repeat(np.arange(a, b), n)
            other = np.arange(ends[-1]) + np.repeat(first[a:b] - ends + n, n)
            key, count = np.unique(doc[mine] * self.pairs + flat_a[mine] * self.n_b + flat_b[other], return_counts=True)
            keys.append(key)
            counts.append(count)
            a = b
        key, count = summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 2 else (keys[-1], counts[-1])
        return key % self.pairs, count, np.searchsorted(key, np.arange(docs + 1) * self.pairs)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def shuffled(values: np.ndarray) -> bytes:
    """All first bytes of values, then all second ones and so on: compresses well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def restored(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T.copy().view(kind).ravel()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of tokenizers and Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", spelled: bool = False) -> DataFrame:
    """Stored table with a row for each of ``docs``: key (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (the distinct pairs of ids linked, how often); with ``spelled`` also the groups.

    Null and empty texts, and those that either tokenizer's tokens don't spell, have no
    tokens, no groups and no digest (''); texts of any length are aligned whole, links in
    blocks; repeated rows and ids have rows of their own; other columns are left out.
    """
    a, b = paths or default_paths()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    fields = ["key long", f"doc_id {kind}", *[f"{c} long" for c in numbers], "groups_sha256 string", "pairs binary", "times binary", *["groups string"] * spelled]
    names = [x.split()[0] for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for x, y in runs(texts):
                got = own.align(texts.slice(x, y - x))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                columns = [pa.array(np.arange(number, number + y - x)), batch.column("doc_id").slice(x, y - x), *[pa.array(got[c], pa.int64()) for c in numbers]]
                columns += [pa.array(digests), pa.array(got["pairs"], pa.binary()), pa.array(got["times"], pa.binary())]
                number += y - x
                yield pa.RecordBatch.from_arrays(columns + [pa.array([g.decode() for g in got["groups"]])] * spelled, names=names)

    return materialize(rows.mapInArrow(tidy(run), ", ".join(fields)), "aligned")


def _sizes(paths: tuple[str, str]) -> tuple[int, str]:
    """(ids of B, how pairs are written)."""
    own = aligner(*paths)
    return own.n_b, own.kind


def pair_counts(rows: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Stored table (pair, a, b, n, top) of what ``align_documents`` returned: how many documents hold the pair linked; top: no other pair of its id of A has more."""
    n_b, kind = _sizes(paths or default_paths())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, n, keys, counts = TaskContext.get().partitionId() % SALTS, [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(np.full(len(keys[part]), salt, np.int32)), pa.array(counts[part])], ["pair", "salt", "n"])

        def fold(keys, counts):
            more = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return summed(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))

        for batch in batches:
            for x in batch.column("pairs"):
                held.append(restored(x.as_py(), kind).astype(np.int64))
                n += len(held[-1])
                if n >= BLOCK_PAIRS:
                    (keys, counts), n = fold(keys, counts), 0
                    if len(keys) >= BLOCK_PAIRS:
                        yield from out(keys, counts)
                        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from out(*fold(keys, counts))

    counted = rows.select("pairs").mapInArrow(tidy(count), "pair long, salt int, n long")
    counted = counted.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(counted.select("pair", F.expr(f"cast(pair div {n_b} as int)").alias("a"), F.expr(f"cast(pair % {n_b} as int)").alias("b"), "n"), "pair-counts")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    return materialize(counted.join(F.broadcast(most), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("top")), "pairs")


def _sent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(the most frequent pairs, ``most`` at most; all others)."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, float("inf")
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    if least == float("inf"):
        return counts.limit(0), counts
    return counts.filter(step >= least), counts.filter(step < least)


def score_links(rows: DataFrame, counts: DataFrame, paths: tuple[str, str] | None = None, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Rows of ``align_documents`` with n_best (links whose pair is top) and count_sum (counts over all links), without pairs and times."""
    _, kind = _sizes(paths or default_paths())
    frequent, others = _sent(counts, sent_pairs)
    table = frequent.select("pair", "n", "top").toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "top")))

    def parts(batch: pa.RecordBatch):
        """(places in the table, whether found, pairs, times, row) of all pairs of a batch."""
        pairs = [restored(x, kind).astype(np.int64) for x in batch.column("pairs").to_pylist()]
        times = [restored(x, "<u4").astype(np.int64) for x in batch.column("times").to_pylist()]
        row = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        flat, often = np.concatenate([*pairs, np.zeros(0, np.int64)]), np.concatenate([*times, np.zeros(0, np.int64)])
        known = sent.value[0]
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        return at, (known[at] == flat if len(known) else np.zeros(len(flat), bool)), flat, often, row

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x, y in runs(batch.column("pairs")):
            yield batch.slice(x, y - x)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                _, found, flat, often, row = parts(part)
                keys = part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[~found]]), pa.array(flat[~found]), pa.array(often[~found])], ["key", "pair", "times"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                at, found, _, often, row = parts(part)
                n, top = sent.value[1], sent.value[2]
                at, often, row = at[found], often[found], row[found]
                total, best = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(total, row, often * n[at])
                np.add.at(best, row, often * top[at])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(best), pa.array(total)], names=[*kept, "own_best", "own_sum"])

    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    met = rows.select("key", "pairs", "times").mapInArrow(tidy(rest), "key long, pair long, times long").join(others.select("pair", "n", "top"), "pair")
    met = met.groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    done = rows.mapInArrow(tidy(own), f"{fields}, own_best long, own_sum long").join(met, "key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return done.select(*kept, plus("own_best", "more_best").alias("n_best"), plus("own_sum", "more_sum").alias("count_sum"))


def op12_cross_tokens(spark, sf_dir: str) -> DataFrame:
    rows = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score_links(rows, pair_counts(rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
