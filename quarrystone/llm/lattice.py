"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors at random to eight dimensions and files them under the nearest point of the E8
lattice.  A vector is filed in its own cell and visits the PROBES neighbouring cells it lies closest to; whoever shares a cell, as
owner or visitor, is verified by cosine in double precision.  Every vector is filed in every table: no sample, no cap.

Equal vectors of one label are one entry with a count.  Visits to cells that nobody owns end before anything is shuffled twice.
A cell with very many entries is cut into chunks and each pair of chunks is a group of its own, so no task holds a whole
cell.  Groups are taken many at a time; pairs are counted as they are found, and a pair that shares several cells is counted in the
first of them alone.  What leaves a batch of groups is a count for each entry and a spanning forest, so the rows stay in proportion
to the entries.

Defined cases: a null, empty or zero vector, one with null or non-finite components, and one without a label link
with nothing, as do vectors of different lengths; rows with a null id are returned without links (component null);
repeated rows are vectors of their own that link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, read_table, small_batches, written
from quarrystone.llm.components import components, local_roots

LEAST_COSINE = 0.93
TABLES, PROBES, SCALE, SEED = 12, 16, 1.5, 2024
#: With these, 0.92 of the pairs of cosine 0.93 share a cell, and over 0.99 of those of 0.95 (64 dimensions, measured on independent pairs).
#: Entries of one chunk of a cell, rows of groups taken together, cosines held at once, and pairs whose cells are looked at together.
CHUNK, ROWS, COSINES, PAIRS = 512, 1 << 13, 1 << 20, 1 << 16


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point (integers) of each row."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        gap = y[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


@lru_cache(1)
def least_vectors() -> np.ndarray:
    """Twice the 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a in (2, -2):
            for b in (2, -2):
                v = np.zeros(8, np.int64)
                v[i], v[j] = a, b
                found.append(v)
    for bits in range(256):
        signs = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            found.append(signs)
    return np.array(found)


@lru_cache(64)
def projection(dims: int, table: int, scale: float) -> np.ndarray:
    """dims x 8; unit vectors keep their distances in the mean, times scale x sqrt(8)."""
    return np.random.default_rng((SEED, dims, table)).standard_normal((dims, 8)) * scale


_MIX = np.random.default_rng(SEED).integers(1, 2**63, 9, dtype=np.int64) * 2 + 1


def cells(unit: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """The cell of each row, then the cells it visits: rows x (1 + probes)."""
    x = unit @ projection(unit.shape[1], table, scale)
    own = nearest_e8(x)
    vectors = least_vectors()
    close = np.argpartition(-((x - own / 2) @ vectors.T.astype(float)), probes, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
    every = np.concatenate((own[:, None, :], own[:, None, :] + vectors[close]), 1)
    with np.errstate(over="ignore"):
        return (every * _MIX[:8]).sum(2) + np.int64(table) * _MIX[8]


def units(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def salt_of(label: int, dims: int) -> np.int64:
    """Keeps the cells of labels and lengths apart."""
    return np.int64(hash((int(label), int(dims))))


def cell_members(entries: DataFrame, tables: int, probes: int) -> DataFrame:
    """cell, node: every entry in its own cells and in those it visits, of all tables, with own; labels and lengths apart."""

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dims), rows in batch.groupby(["label", "dims"]):
                unit, node = units(rows["embedding"]), rows["node"].to_numpy(np.int64)
                for table in range(tables):
                    found = cells(unit, table, probes)
                    yield pd.DataFrame({
                        "cell": (found ^ salt_of(label, dims)).ravel(), "node": np.repeat(node, found.shape[1]),
                        "own": np.tile(np.arange(found.shape[1]) == 0, len(node))
                    })

    return entries.select("node", "label", F.size("embedding").alias("dims"), "embedding").mapInPandas(filed, "cell long, node long, own boolean")


def first_cell(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first cell, over tables and then by number, that both of each pair share and one of them owns."""
    none = np.iinfo(np.int64).max
    own = keys[0][:, 0]
    # most near pairs own one cell of the first table, which is then their first
    first = np.where(own[left] == own[right], own[left], none)
    open_ = np.flatnonzero(first == none)
    for at in keys if len(open_) else []:
        a, b = at[left[open_]], at[right[open_]]
        one = np.where((b == a[:, :1]).any(1), a[:, 0], none)
        two = np.where((a == b[:, :1]).any(1), b[:, 0], none)
        best = np.minimum(one, two)
        first[open_] = best
        open_ = open_[best == none]
        if not len(open_):
            break
    return first


def close_pairs(unit: np.ndarray, begin: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (left < right) of one group with a cosine of at least least; groups of one size are multiplied together."""
    for n in np.unique(size[size > 1]).tolist():
        first = begin[size == n]
        step = max(1, COSINES // (n * max(n, unit.shape[1])))
        for k in range(0, len(first), step):
            rows = first[k : k + step, None] + np.arange(n)
            held = unit[rows]
            g, a, b = np.nonzero(np.triu(held @ held.transpose(0, 2, 1) >= least, 1))
            if len(g):
                yield rows[g, a], rows[g, b]


def linked_counts(tables: int, probes: int, least: float):
    """For mapInPandas: rows (cell, low, high, chunk, own, node, label, dims, copies, embedding) in the order of their groups
    (cell, low, high) become node, root, links."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROWS:
                rows = pd.concat(held, ignore_index=True)
                last = rows[["cell", "low", "high"]].to_numpy()
                begin = int(np.argmax((last == last[-1]).all(1)))
                yield from found(rows.iloc[:begin])
                held = [rows.iloc[begin:]]
                size = len(held[0])
        if held:
            yield from found(pd.concat(held, ignore_index=True))

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for dims, part in rows.groupby("dims"):
            part = part.sort_values(["cell", "low", "high", "label", "node"]).reset_index(drop=True)
            yield from pairs(int(dims), part)

    def pairs(dims: int, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = part[["cell", "low", "high", "label"]].to_numpy(np.int64)
        begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        own, chunk, cell, node, label = (part[c].to_numpy() for c in ("own", "chunk", "cell", "node", "label"))
        one_chunk, copies = keys[:, 1] == keys[:, 2], part["copies"].to_numpy(np.int64)
        unit = units(part["embedding"])
        lefts, rights = [], []
        for left, right in close_pairs(unit, begin, np.diff(np.append(begin, len(part))), least):
            meets = (own[left] | own[right]) & (one_chunk[left] | (chunk[left] != chunk[right]))
            lefts.append(left[meets])
            rights.append(right[meets])
        if not lefts:
            return
        left, right = np.concatenate(lefts), np.concatenate(rights)
        # an entry stands in several groups: its cells are worked out once, and only if it is in a pair
        used, at = np.unique(np.concatenate((left, right)), return_inverse=True)
        _, row, entry = np.unique(node[used], return_index=True, return_inverse=True)
        rep = used[row]
        salt = np.zeros(len(rep), np.int64)
        for each in np.unique(label[rep]):
            salt[label[rep] == each] = salt_of(each, dims)
        a, b = entry[at[: len(left)]], entry[at[len(left) :]]
        places = [cells(unit[rep], table, probes) ^ salt[:, None] for table in range(tables)]
        here = np.concatenate([np.zeros(0, bool)] + [
            first_cell(places, a[k : k + PAIRS], b[k : k + PAIRS]) == cell[left[k : k + PAIRS]]
            for k in range(0, len(a), PAIRS)
        ])
        a, b = a[here], b[here]
        n = copies[rep]
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        root = local_roots(len(rep), a, b)
        out = np.flatnonzero(links > 0)
        if len(out):
            yield pd.DataFrame({"node": node[rep[out]], "root": node[rep[root[out]]], "links": links[out].astype(np.int64)})

    return counted


def lattice_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, tables: int = TABLES,
    probes: int = PROBES
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    sound = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    keyed = written(
        rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("digest", F.when(F.col("ok"), F.sha2(F.to_binary(F.concat_ws(",", F.transform(e, lambda x: x.cast("string"))), F.lit("utf-8")), 256))),
        "vectors"
    )
    entries = written(
        keyed.filter("ok").groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("embedding").alias("embedding")),
        "vector-entries"
    )

    owned = written(cell_members(entries, tables, 0).select("cell").distinct(), "owned-cells")
    met = written(cell_members(entries, tables, probes).join(owned, "cell"), "cell-members")
    sizes = written(met.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell-sizes")
    crowd = met.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    each = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("low"), F.greatest(c, F.col("chunk")).alias("high"))
    ))
    dealt = crowd.withColumn("p", each).select("cell", "p.low", "p.high", "chunk", "own", "node")
    full = dealt.join(entries.select("node", "label", F.size("embedding").alias("dims"), "copies", "embedding"), "node")
    grouped = full.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    found = written(grouped.mapInPandas(linked_counts(tables, probes, least), "node long, root long, links long"), "vector-links")
    discard(owned, met, sizes)

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    named = entries.select("label", "digest", "node", "copies").join(counts, "node", "left").join(linked, "node", "left")
    named = written(
        named.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id")),
        "vector-classes"
    )
    result = keyed.drop("embedding").join(named, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def op10_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lattice_links(read_table(spark, sf_dir, "embeddings"))
