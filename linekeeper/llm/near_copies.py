"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts with equal shingle sets form a class, of which one takes part.  A class's shingles
are ordered rare first; two sets that reach the threshold share one of their first few.
The order: shingles that tasks meet again and again are counted by hash over all
documents, the TOP most frequent of them come last, by their counts; all others are rarer
than these and come first, by hash.  (Any common order gives right results; this one keeps
the most frequent shingles out of the prefixes with a table of fixed size.  Where a corpus
has far more frequent shingles than the table takes, those beyond it are ordered by hash
alone: prefixes hold more of them, and more pairs meet.)  Candidates meet on the prefix
shingles:

* first every class meets one pivot of each of its prefix shingles, and the links found
  join most of a group of near copies into one component;
* then, for shingles whose classes are still in several components, all pairs across
  components meet.  A pair within one component needs no check: it is linked anyhow.

So no link between components is lost, and a group of n near copies costs about n checks,
not all pairs.  Pairs pass the length and positional filters as they are formed, then the
suffix filter on bit signatures of the sets (128 bytes a class); only the texts of what is
left are read, and every pair is verified once, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.graph import components
from linekeeper.llm.store import keep_candidates, materialize, row_uid, tidy
from linekeeper.llm.words import hashed_texts, shingles

#: Frequent shingles that are told apart in the order.
TOP = 1 << 18
#: Shingles that a task counts together, and from how many equal ones on it reports one.
CHUNK, REPORT = 1 << 20, 2
#: Bits of a set's signature.
SIGNATURE_BITS = 1024
#: Classes that meet one pivot of a shingle; more are dealt to several, whose pivots meet in turn.
PIVOT_GROUP = 4000


def prefix_size(n: Column | np.ndarray | int, percent: int):
    """Shingles of a set of n, rare first, of which two sets that reach the threshold share one."""
    return n - (percent * n + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, size: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most frequent shingles, TOP at most.

    A shingle is counted where CHUNK shingles in a row hold it REPORT times or more, which
    bounds a task's memory and what is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(every)))
            often = times >= REPORT
            return pa.RecordBatch.from_arrays([pa.array(every[first[often]].view(np.int64)), pa.array(times[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for _, hashes in hashed_texts(batch, text_col, True):
                own = shingles(hashes, size)
                held.append(own)
                n += len(own)
                if n >= CHUNK:
                    yield report()
                    held, n = [], 0
        yield report()

    rows = docs.select(text_col).mapInArrow(tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "frequent")
    # the least count with which TOP shingles or fewer are left, from a histogram of some hundred rows
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r.level, r.n) for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in steps:
        if total + n > TOP:
            break
        total, least = total + n, k
    got = rows.filter(level >= (least if least is not None else 1 << 30)).toArrow().to_pandas().sort_values("shingle")
    hashes = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got["n"].to_numpy(np.int64)[order]


def known_counts(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of shingles, 0 of those that aren't among the frequent ones."""
    hashes, counts = frequent
    if not len(hashes):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
    return np.where(hashes[at] == values, counts[at], 0)


def rare_first(sets: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set (ascending) in the common order, by count and then by hash, and its counts."""
    n = known_counts(sets, frequent)
    order = np.argsort(n, kind="stable")
    return sets[order], n[order]


def signature(sets: np.ndarray) -> bytes:
    """A bit for each shingle; sets differ in as many shingles at least as signatures in bits."""
    bits = np.zeros(SIGNATURE_BITS, np.uint8)
    bits[(sets % np.uint64(SIGNATURE_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_link(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter for pairs of signatures (rows of bytes) of sets of n1 and n2 shingles: false where they can't reach the threshold."""
    apart = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
    return (100 + percent) * (n1 + n2 - apart) >= 2 * percent * (n1 + n2)


def describe(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, n, digest and signature of the set, its prefix and how many pivots each prefix shingle has (stored)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            n, digest, bits, prefix, pivots = [], [], [], [], []
            for _, hashes in hashed_texts(batch, text_col, True):
                s = shingles(hashes, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(signature(s))
                first, often = (x[: prefix_size(len(s), percent)] for x in rare_first(s, frequent))
                prefix.append(first.view(np.int64))
                pivots.append((1 + often // PIVOT_GROUP).astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            many = np.concatenate(pivots) if pivots else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"),
                    batch.column(id_col),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(bits, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(many)),
                ],
                ["uid", "doc_id", "n", "digest", "bits", "prefix", "pivots"],
            )

    rows = docs.select(row_uid(id_col, text_col).alias("uid"), id_col, text_col)
    return materialize(rows.mapInArrow(tidy(run), f"uid long, doc_id {kind}, n long, digest binary, bits binary, prefix array<long>, pivots array<int>"), "shingle-sets")


def _reach(a: str, b: str, percent: int) -> Column:
    """Length filter and positional filter for two sets (n, pos of the shared shingle)."""
    n1, n2, p1, p2 = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    need = F.ceil((n1 + n2) * percent / (100.0 + percent) - 1e-9)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the common values of two sorted sets, from the sizes of their halves."""
    if not depth or not len(a) or not len(b):
        return min(len(a), len(b))
    middle = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, middle))
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, by the suffix filter first and then the whole sets."""
    total = len(a) + len(b)
    if (100 + percent) * suffix_bound(a, b) < percent * total:
        return False
    short, long = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    common = int((long[at] == short).sum()) if len(long) else 0
    return (100 + percent) * common >= percent * total


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int, text_col: str, name: str) -> DataFrame:
    """The pairs (a, b) of uids whose texts reach the threshold (stored).

    Signatures first; texts of the candidates left alone are shuffled: b's text goes to a,
    whose set is made once.
    """
    bits = sets.select("uid", "n", "bits")
    side = lambda x: bits.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"bits_{x}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for x in "ab")
            n1, n2 = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(may_link(a, b, n1, n2, percent)))

    pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(narrow), "a long, b long").distinct(), f"{name}-pairs")
    ids = materialize(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct(), f"{name}-ids")
    texts = keep_candidates(docs, "uid", ids)
    left = pairs.join(texts.withColumnRenamed("uid", "b").withColumnRenamed(text_col, "text_b"), "b")
    both = left.join(texts.withColumnRenamed("uid", "a").withColumnRenamed(text_col, "text_a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a = batch.column("a").to_numpy()
            new = np.append(True, a[1:] != a[:-1])
            if last is not None and len(a) and a[0] == last:
                new[0] = False
            firsts = batch.filter(pa.array(new))
            own = (shingles(h, size) for _, h in hashed_texts(firsts, "text_a", True))
            keep = np.zeros(len(a), bool)
            for i, hashes in hashed_texts(batch, "text_b", True):
                if new[i]:
                    last, last_set = a[i], next(own)
                keep[i] = linked(last_set, shingles(hashes, size), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return materialize(both.mapInArrow(tidy(run), "a long, b long"), name)


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest id that links reach.  Null, empty and blank texts have no
    shingles and are their own component; equal texts are always linked; repeated rows get
    equal results; null ids take part and are never a component's id unless it has no
    other; texts of any length take part whole; other columns are ignored; an empty table
    gives no rows.
    """
    member = members(docs, size, percent, id_col, text_col)
    # stored, so that the join is of two plain shuffles, in which a large component's partition can be split
    least = materialize(member.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return member.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (row_uid of id and text) of the row with the smallest id of each component, a null id last; of rows that share the id, the one with the smallest uid; of rows without shingles all."""
    member = members(docs, size, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    first = member.filter("root is not null").groupBy("root").agg(F.min(order)["uid"].alias("uid")).select("uid")
    return first.union(member.filter("root is null").select("uid")).distinct()


def surplus_rows(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, gone) of the rows that don't simply stay, stored: gone is true but for the first of a component (by ``first_of_groups``), false for a uid that stays and that several rows have."""
    member = members(docs, size, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    first = materialize(member.filter("root is not null").groupBy("root").agg(F.min(order)["uid"].alias("first")), "first-rows")
    gone = materialize(member.filter("root is not null").join(first, "root").filter("uid <> first").select("uid").distinct(), "gone")
    often = member.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("uid").join(gone, "uid", "left_anti")
    return materialize(gone.select("uid", F.lit(True).alias("gone")).union(often.select("uid", F.lit(False))), "surplus")


def members(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, n and root of every row: rows of one component share the root; null without shingles.  Stored."""
    rows = docs.select(row_uid(id_col, text_col).alias("uid"), F.col(text_col))
    sets = describe(docs, size, percent, id_col, text_col)
    full = sets.filter("n > 0")
    # classes of equal sets; the least uid stands for a class
    classes = full.groupBy("digest").agg(F.min("uid").alias("node"))
    classes = materialize(classes, "classes")
    # a class's own set: the row of its least uid (a repeated row may come twice)
    own = full.join(classes, "digest").filter("uid = node").select("node", "n", F.arrays_zip("prefix", "pivots").alias("z"))
    tokens = own.select("node", "n", F.posexplode("z").alias("pos", "x")).select(
        F.col("x.prefix").alias("token"), F.col("x.pivots").alias("pivots"), F.pmod("node", "x.pivots").cast("int").alias("deal"), "node", "n", "pos"
    )
    # stored, and the pivots told by an aggregate: no task sorts all members of a shingle, and the join can split a hot one
    tokens = materialize(tokens, "prefixes")
    pivot = F.min(F.struct("pos", "node", "n")).alias("f")
    firsts = tokens.groupBy("token", "deal").agg(pivot, F.count(F.lit(1)).alias("c"), F.max("pivots").alias("v")).filter("c > 1 or v > 1")
    firsts = materialize(firsts.select("token", "deal", F.struct("f.node", "f.n", "f.pos").alias("p")), "pivots")
    met = tokens.join(firsts, ["token", "deal"]).select("token", "pivots", F.struct("node", "n", "pos").alias("m"), "p").filter("pivots > 1 or m.node <> p.node")
    met = materialize(met, "met")
    # the pivots of one shingle meet the first of them in turn; stored, so that a hot shingle's partition can be split
    many = met.filter("pivots > 1")
    tops = many.groupBy("token").agg(F.min(F.struct("p.pos", "p.node", "p.n")).alias("t")).select("token", F.struct("t.node", "t.n", "t.pos").alias("top"))
    dealt = many.join(materialize(tops, "tops"), "token").select("token", "m", "p", "top")
    bridges = dealt.select("token", F.col("p").alias("m"), F.col("top").alias("p"), "top").distinct()
    met = met.filter("pivots = 1").select("token", "m", "p", F.col("p").alias("top")).union(dealt).union(bridges)
    pairs = met.filter((F.col("m.node") != F.col("p.node")) & _reach("m", "p", percent)).select(F.col("p.node").alias("a"), F.col("m.node").alias("b")).distinct()
    pairs = materialize(pairs, "star-pairs")
    links = verify(pairs, sets, rows, size, percent, text_col, "star-links")
    roots = components(links, "star")
    # shingles whose members are in several components
    root = lambda x: F.coalesce(F.col(f"{x}_root"), F.col(f"{x}.node"))
    known = met.join(roots.select(F.col("node").alias("mn"), F.col("root").alias("m_root")), F.col("m.node") == F.col("mn"), "left").join(
        roots.select(F.col("node").alias("pn"), F.col("root").alias("top_root")), F.col("top.node") == F.col("pn"), "left"
    )
    known = materialize(known.select("token", F.struct("m.*", root("m").alias("root")).alias("m"), root("top").alias("top_root")), "rooted")
    outside = materialize(known.filter("m.root <> top_root").select("token", F.col("m").alias("o")).distinct(), "outside")
    # every other member; an only pivot has met all already
    inside = materialize(known.join(outside.select("token").distinct(), "token", "left_semi").select("token", "m").distinct(), "inside")
    rest = outside.join(inside, "token").filter((F.col("o.root") != F.col("m.root")) & _reach("o", "m", percent))
    rest = rest.select(F.least("o.node", "m.node").alias("a"), F.greatest("o.node", "m.node").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(done, ["a", "b"], "left_anti"), "rest-pairs")
    more = verify(rest, sets, rows, size, percent, text_col, "rest-links")
    roots = components(links.union(more), "all")
    member = sets.select("uid", "doc_id", "n", "digest").join(classes, "digest", "left").join(roots, "node", "left")
    return materialize(member.select("uid", "doc_id", "n", F.coalesce("root", "node").alias("root")), "members")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=4, percent=85)
