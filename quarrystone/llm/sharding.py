"""Sharding with a hierarchical weighted hash tree.

Shards are leaves of a tree region / rack / shard.  A row descends: at each level every node draws
a number from a hash of (row key, node), scaled by the node's weight, and the least draw wins.  The
draw -ln(u) / weight is an exponential variate whose rate is the weight, so a node is chosen in
proportion to its weight.

A node whose weight rises keeps its old draw; the added weight draws for itself, as a further
*generation* of that node, and leads only to the leaves that brought the weight.  So a new shard
can only win rows for itself: rows move from every other subtree into it and nowhere else.
Rows' places depend on the id and the shard count alone (law ``key``).

Slots inside a shard come without a sort of the whole shard: rows are numbered inside (shard,
bucket), where the bucket is 12 bits of the hash of the id, or of the text where the id is null, and buckets' offsets come from a table
of at most 4096 x shards counts, whose bound makes it safe to broadcast.

Only DataFrame functions are used.  Defined cases: a null text has no bytes (size 8, CRC 0); a null
id is keyed as the word null; repeated rows share a shard and get slots of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_HEX = 3
ROW_OVERHEAD = 8


@dataclass(frozen=True)
class Tree:
    """base shards stand in regions x racks x shards of generation 0; each further shard is a
    generation of its own.  weights: by shard number, 1 where absent."""

    shards: int
    base: int = 24
    regions: int = 2
    racks: int = 3
    weights: tuple[tuple[int, float], ...] = ()

    def __post_init__(self):
        if self.shards < self.base or self.base % (self.regions * self.racks):
            raise ValueError("base shards fill regions x racks evenly, and a tree never has fewer")

    def weight(self, shard: int) -> float:
        return dict(self.weights).get(shard, 1.0)

    def place(self, shard: int) -> tuple[int, int, int]:
        """(region, rack, generation) of a shard; later shards go round the racks."""
        per_rack = self.base // (self.regions * self.racks)
        spot = shard // per_rack if shard < self.base else (shard - self.base) % (self.regions * self.racks)
        return spot // self.racks, spot % self.racks, 0 if shard < self.base else shard - self.base + 1

    def nodes(self) -> dict[tuple, dict[tuple, float]]:
        """Of each inner node its children and their weights.  A node is (generation, region, rack)
        or a prefix of it; children are longer by one, and below a rack they are shard numbers."""
        found: dict[tuple, dict[tuple, float]] = {}
        for shard in range(self.shards):
            region, rack, gen = self.place(shard)
            w = self.weight(shard)
            for parent, child in (((), (gen, region)), ((gen, region), (gen, region, rack)), ((gen, region, rack), (shard,))):
                children = found.setdefault(parent, {})
                children[child] = children.get(child, 0.0) + w
        return found


def draw(key: Column, node: tuple, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 48 bits of MD5 of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + ".".join(map(str, node))))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def shard_of(key: Column, tree: Tree) -> Column:
    """The leaf that key descends to."""
    nodes = tree.nodes()

    def descend(at: tuple) -> Column:
        children = sorted(nodes[at].items())
        if at and len(at) == 3 and len(children) == 1:
            return F.lit(children[0][0][0])
        if len(children) == 1:
            return descend(children[0][0])
        best = F.least(*(F.struct(draw(key, c, w).alias("d"), F.lit(i).alias("i")) for i, (c, w) in enumerate(children)))["i"]
        leaves = [F.lit(c[0]) if len(at) == 3 else descend(c) for c, _ in children]
        return F.element_at(F.array(*leaves), best + 1) if len(at) == 3 else reduce(
            lambda rest, x: F.when(best == x[0], x[1]).otherwise(rest), list(enumerate(leaves))[:-1], leaves[-1]
        )

    return descend(())


def shard_rows(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", grow: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    grown = Tree(tree.shards + 1, tree.base, tree.regions, tree.racks, tree.weights)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).cast("int").alias("shard"),
        (shard_of(key, grown) if grow else F.lit(None)).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.when(F.col(id_col).isNull(), F.md5(text)).otherwise(F.md5(F.concat(key, F.lit("|slot")))), 1, BUCKET_HEX), 16, 10).cast("int").alias("bucket"),
    )
    # rows that are alike in all columns are one row of the window and are told apart after it
    alike = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    inside = alike.withColumn("inside", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "shard", "bucket",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    )
    return inside.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("offset") + F.col("inside"), F.col("offset") + F.col("inside") + F.col("rows") - 1)).alias("slot"),
        "grown_shard",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import read_table

    return shard_rows(read_table(spark, sf_dir, "documents"), Tree(24))
