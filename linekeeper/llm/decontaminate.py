"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity with it, so a document is
searched as windows that fit the item: items are partitioned by size (powers of two), and
for the items of up to u shingles a document's windows are two neighbouring blocks of u
shingles.  An item whose shingles lie together is inside one window, and then has a
similarity of about threshold / 4 or more with it, since it has over u / 2 shingles.  With
PERMUTATIONS independent minima, one of which has to agree, it is missed about once in a
million.  Candidates are verified by the share of the item's shingles that the whole
document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import tidy
from linekeeper.llm.words import hash_words, mix, runs, shingles, split_words, windows

PERMUTATIONS = 64
#: Text bytes of the items that are sent to all tasks at once; more items are searched in blocks.
ITEM_BYTES = 8 << 20
#: Bits of the first look at a minimum.
LOOK_BITS = 16


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seeds = mix(seeds)
    return seeds[:PERMUTATIONS] | np.uint64(1), seeds[PERMUTATIONS:]


class ItemIndex:
    """MinHash signatures of items by size partition."""

    def __init__(self, ids: list, sets: list[np.ndarray]) -> None:
        kept = [(i, s) for i, s in zip(ids, sets, strict=True) if len(s)]
        self.ids = [i for i, _ in kept]
        self.sets = [s for _, s in kept]
        self.mul, self.add = _permutations()
        #: partition's upper size -> for each permutation: a table of first bits, sorted minima, their items
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for u in sorted({self.upper(len(s)) for s in self.sets}):
            own = np.array([k for k, s in enumerate(self.sets) if self.upper(len(s)) == u])
            rows = []
            for mul, add in zip(self.mul, self.add, strict=True):
                low = np.array([(self.sets[k] * mul + add).min() for k in own], np.uint64)
                order = np.argsort(low, kind="stable")
                look = np.zeros(1 << LOOK_BITS, bool)
                look[(low >> np.uint64(64 - LOOK_BITS)).astype(np.int64)] = True
                rows.append((look, low[order], own[order]))
            self.parts[u] = rows

    @staticmethod
    def upper(size: int) -> int:
        return 1 << (size - 1).bit_length()

    def candidates(self, hashes: np.ndarray, docs: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) with an agreeing minimum; ``hashes``: shingles of all documents in a row, ``docs``: which document's each is, ascending."""
        if not len(hashes) or not self.parts:
            return set()
        starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        sizes = np.diff(np.append(starts, len(docs)))
        levels, found = sorted(self.parts), set()
        # where blocks of each level begin, in terms of the level below
        shapes = []
        base = levels[0]
        within = np.arange(len(docs)) - np.repeat(starts, sizes)
        cut = np.flatnonzero(within % base == 0)
        owner, place, size = docs[cut], within[cut] // base, base
        for u in levels:
            step = []
            while size < u:
                even = np.flatnonzero(place % 2 == 0)
                step.append(even)
                owner, place, size = owner[even], place[even] // 2, size * 2
            pair = np.append(owner[1:] == owner[:-1], False)
            shapes.append((u, step, np.flatnonzero(pair), owner))
        for k, (mul, add) in enumerate(zip(self.mul, self.add, strict=True)):
            low = np.minimum.reduceat(hashes * mul + add, cut)
            for u, step, pair, owner in shapes:
                for even in step:
                    low = np.minimum.reduceat(low, even)
                both = low.copy()
                both[pair] = np.minimum(low[pair], low[pair + 1])
                look, values, items = self.parts[u][k]
                hit = np.flatnonzero(look[(both >> np.uint64(64 - LOOK_BITS)).astype(np.int64)])
                if len(hit):
                    a, b = np.searchsorted(values, both[hit], "left"), np.searchsorted(values, both[hit], "right")
                    for i, x, y in zip(hit[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                        found.update((int(owner[i]), int(items[j])) for j in range(x, y))
        return found


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of the documents that hold at least ``percent`` of an item's shingles.

    Shingles: ``size`` words, ASCII letters in one case.  Items with fewer words, null or
    empty texts have none and match nothing; equal items are reported each; repeated rows
    of documents each; null ids are kept; an empty table on either side gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_BYTES))
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block)
        table = own.select(item_id, item_text).toArrow()  # about ITEM_BYTES
        words, ends = split_words(table.column(item_text).combine_chunks().cast(pa.string()), True)
        hashes = hash_words(words)
        sets = [shingles(h, size) if len(h) >= size else h[:0] for h in (hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
        sent = spark.sparkContext.broadcast(ItemIndex(table.column(item_id).to_pylist(), sets))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            item_type = pa.array(index.ids).type if index.ids else pa.int64()
            for batch in batches:
                rows, found, n_item, shared = [], [], [], []
                texts = batch.column(text_col)
                for a, b in runs(texts):
                    words, ends = split_words(texts.slice(a, b - a), True)
                    hashes = hash_words(words)
                    grams = windows(hashes, size)
                    # a shingle is of a text if its last word is too
                    at = np.repeat(np.arange(b - a), np.diff(ends))
                    inside = at[: len(grams)] == at[size - 1 :] if len(grams) else np.zeros(0, bool)
                    grams, at = grams[inside], at[: len(grams)][inside]
                    for d, k in sorted(index.candidates(grams, at)):
                        lo, hi = np.searchsorted(at, d, "left"), np.searchsorted(at, d, "right")
                        n, common = len(index.sets[k]), int(np.isin(index.sets[k], grams[lo:hi]).sum())
                        if 100 * common >= percent * n:
                            rows.append(a + d)
                            found.append(index.ids[k])
                            n_item.append(n)
                            shared.append(common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(rows, pa.int32())), pa.array(found, item_type), pa.array(n_item, pa.int64()), pa.array(shared, pa.int64())],
                    ["doc_id", "item_id", "n_item", "n_shared"],
                )

        part = docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {kind}, item_id {item_kind}, n_item long, n_shared long")
        out = part if out is None else out.union(part)
    return out


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
