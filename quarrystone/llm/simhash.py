"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, cut into six blocks.  Two fingerprints that differ in three bits or fewer agree in
at least three whole blocks, so each fingerprint is filed under its 20 choices of three blocks (32 bits
or so) and only those that share a key are compared.  Equal fingerprints are one entry throughout.

Inside a key, distances are compared in blocks and only a spanning forest leaves the task.  A key with very many
different fingerprints is first divided: the free bits are cut into six blocks again, and each of the 20 choices fixes half of
them, which leaves at most 2 ** 18 possible fingerprints to a task; their neighbours are then looked up in a
table of the free bits instead of being compared with each other.  Nothing is capped or dropped.

Defined cases: a null or blank text has fingerprint zero and links as any other; fewer than three words are one
shingle; rows with a null id have a fingerprint, link nothing and have a null component; repeated rows of one id
are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches, written
from quarrystone.llm.components import components, local_roots

SHINGLE_WORDS, SEED, NEAR_BITS = 3, 42, 3
BLOCKS, SHARED_BLOCKS = 6, 3
#: A key with more fingerprints than this is divided by further bits.
DENSE = 2048
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64 bits as a signed integer."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp of every row."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(found, "doc_id long, fp long")


def block_masks(bits: list[int], parts: int, shared: int) -> list[int]:
    """For each choice of shared out of parts blocks of the given bit numbers: the mask of its bits, as signed 64-bit."""
    blocks = [sum(1 << b for b in chunk) for chunk in np.array_split(np.array(bits, dtype=object), parts)]
    masks = [sum(c) for c in combinations(blocks, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Pairs that a task holds before it joins them.
HELD_PAIRS = 1 << 18


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """local_roots() of pairs that come bit by bit; no more than HELD_PAIRS and one bit are held."""
    root = np.arange(n)
    left, right, size = [], [], 0

    def joined() -> np.ndarray:
        moved = np.flatnonzero(root != np.arange(n))
        return local_roots(n, np.concatenate([moved, *left]), np.concatenate([root[moved], *right]))

    for a, b in pairs:
        apart = root[a] != root[b]
        left.append(a[apart])
        right.append(b[apart])
        size += int(apart.sum())
        if size >= HELD_PAIRS:
            root = joined()
            left, right, size = [], [], 0
    return joined()


def near(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within NEAR_BITS, in blocks of rows."""
    u = fps.view(np.uint64)
    step = max(1, (1 << 18) // max(1, len(u)))
    for k in range(0, len(u), step):
        a, b = np.nonzero(np.bitwise_count(u[k : k + step, None] ^ u[None, k:]) <= NEAR_BITS)
        keep = a < b
        yield a[keep] + k, b[keep] + k


def near_in_cube(fps: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for fingerprints that agree in all bits of mask, by a table of the free bits."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    u = fps.view(np.uint64)
    place = sum((((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64) for k, b in enumerate(free))
    table = np.full(1 << len(free), -1, np.int64)
    table[place] = np.arange(len(u))
    for n in range(1, NEAR_BITS + 1):
        for flips in combinations(range(len(free)), n):
            other = table[place ^ sum(1 << f for f in flips)]
            at = np.flatnonzero(other >= 0)
            at = at[at < other[at]]
            yield at, other[at]


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (choice, mask, key, fp, node) come in order of key; leaves edges (a, b) that span each key's near pairs.
    Held are the rows of one key and one batch at most."""
    held: list[pd.DataFrame] = []

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        fps, node = group["fp"].to_numpy(np.int64), group["node"].to_numpy(np.int64)
        root = roots_of(len(fps), near(fps) if len(fps) <= DENSE else near_in_cube(fps, int(group["mask"].iloc[0])))
        at = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": node[at], "b": node[root[at]]})

    def ready(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        choice, key = rows["choice"].to_numpy(), rows["key"].to_numpy()
        cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        begin = np.concatenate(([0], cuts))
        end = np.append(cuts, len(rows))
        found = [edges(rows.iloc[a:b]) for a, b in zip(begin, end) if b - a > 1]
        if found:
            yield pd.concat(found, ignore_index=True)

    def of_row(rows: pd.DataFrame, at: int) -> tuple[int, int]:
        return rows["choice"].iloc[at], rows["key"].iloc[at]

    for batch in batches:
        held.append(batch)
        if of_row(held[0], 0) != of_row(batch, -1):  # all but the last key are whole
            rows = pd.concat(held, ignore_index=True)
            same = (rows["choice"] == rows["choice"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            begin = int(np.argmax(same.to_numpy()))
            yield from ready(rows.iloc[:begin])
            held = [rows.iloc[begin:]]
    if held:
        yield from ready(pd.concat(held, ignore_index=True))


def near_edges(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between nodes (fp, node) that keep every link of NEAR_BITS or fewer connected."""

    def filed(rows: DataFrame, choices: list[int]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(choices)))
        return rows.withColumn("c", F.explode(each)).select("c.choice", "c.mask", F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"), "fp", "node")

    first = filed(nodes, block_masks(list(range(64)), BLOCKS, SHARED_BLOCKS))
    sizes = written(first.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    shared = first.join(sizes, ["choice", "key"])
    finer = []
    for i, mask in enumerate(block_masks(list(range(64)), BLOCKS, SHARED_BLOCKS)):
        free = [b for b in range(64) if not (mask >> b) & 1]
        finer += [(i, k, (mask | m) if (mask | m) < (1 << 63) else (mask | m) - (1 << 64)) for k, m in enumerate(block_masks(free, BLOCKS, SHARED_BLOCKS))]
    usual = shared.filter(F.col("n") <= dense).select("choice", "mask", "key", "fp", "node")
    crowded = written(shared.filter(F.col("n") > dense).select("choice", "fp", "node"), "simhash-crowded")
    found = usual
    if not crowded.isEmpty():
        spark = nodes.sparkSession
        sub = F.broadcast(spark.createDataFrame(finer, "choice int, sub int, mask long"))
        divided = crowded.join(sub, "choice").select(
            (F.col("choice") * 100 + F.col("sub") + 100).alias("choice"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"
        )
        found = usual.unionByName(divided)
    dealt = found.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return dealt.mapInPandas(forest, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    linked = components(near_edges(nodes), "simhash")
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    found = prints.join(written(named, "simhash-named"), "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
