"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

Every draw is a weighted hash draw (rendezvous with exponential keys): a child with
weight w gets ``-ln(u) / w`` from a hash of (key, node, child), the least wins.  A row
moves only if the winner at some node changes, that is only into or out of subtrees
whose weights changed.  A new shard in a region of its own therefore takes rows into
itself and moves no other row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.llm.store import materialize

#: Sub-groups of a shard for numbering rows: no task numbers a whole shard.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    leaves: tuple[Leaf, ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
        """Shards of weight 1, ``per_rack`` a rack and ``racks`` a region."""
        return cls(tuple(Leaf(i // (per_rack * racks), i // per_rack % racks, i) for i in range(shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move only into it."""
        new = Leaf(max(x.region for x in self.leaves) + 1, 0, max(x.shard for x in self.leaves) + 1, weight)
        return replace(self, leaves=(*self.leaves, new))

    def children(self) -> dict:
        """{region: {rack: {shard: weight}}} with the leaves in order."""
        out: dict = {}
        for x in sorted(self.leaves, key=lambda x: (x.region, x.rack, x.shard)):
            if x.weight > 0:
                out.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
        return out


def _total(node) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else float(node)


def _options(node: dict) -> Column:
    """Children of a node as a constant array of (name, weight)."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(_total(x)).alias("weight")) for k, x in node.items()])


def _draw(key: Column, at: Column, options: Column) -> Column:
    """(t, pos, name) of the child of node ``at`` that wins the key's weighted draw; ties go to the first."""

    def arrival(child: Column, pos: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws("|", key, at, child["name"].cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((u + 0.5) / float(1 << 52)) / child["weight"]).alias("t"), pos.alias("pos"), child["name"].alias("name"))

    return F.array_min(F.transform(options, arrival))


def assign(df: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """Adds column ``out`` (int): the shard to which the tree's draws lead ``key`` (string, null: a key of its own).

    The tree's levels are constant nested arrays, so the plan's size follows the tree's
    depth; each level evaluates the draws of one node.
    """
    nodes = tree.children()
    key = F.coalesce(key, F.lit("\u0000"))
    racks = F.array(*[_options(x) for x in nodes.values()])
    shards = F.array(*[F.array(*[_options(y) for y in x.values()]) for x in nodes.values()])
    df = df.withColumn("__region", _draw(key, F.lit("root"), _options(nodes)))
    df = df.withColumn("__rack", _draw(key, F.col("__region.name").cast("string"), racks[F.col("__region.pos")]))
    leaf = shards[F.col("__region.pos")][F.col("__rack.pos")]
    df = df.withColumn("__leaf", _draw(key, F.concat_ws(".", F.col("__region.name").cast("string"), F.col("__rack.name").cast("string")), leaf))
    return df.withColumn(out, F.col("__leaf.name").cast("int")).drop("__region", "__rack", "__leaf")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """Put every row into a shard of the tree and give it a slot there.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot (gapless
    from 0 within the shard) and grown_shard (the shard with one more of them).  Null id:
    one key of its own; null text: size 1, crc32 0; repeated rows share a shard and get
    slots of their own; other columns are ignored; an empty table gives no rows.
    """
    tree = tree or Tree.even(shards)
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    # stored once: the texts are read and the draws are made a single time, and a row's number stays as it is
    placed = materialize(assign(assign(rows, key, tree, "shard"), key, tree.grown(), "grown_shard"), "placed")
    # sub-groups by the row's number, so that rows of one id or text spread; shards * SLOT_BUCKETS counts at most
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = placed.withColumn("r", F.row_number().over(within)).join(F.broadcast(base), ["shard", "bucket"])
    slot = (F.col("base") + F.col("r") - 1).cast("long").alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
