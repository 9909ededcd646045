"""The Spark side of repeated-string operators: which segments of which rows can hold repeats.

1. Each row yields its distinct anchors (see ``winnow``), which are written once; they are counted with a map-side combine.
2. Anchors that repeat are joined with them, and each row gets the list of its own that repeat.
3. Rows are cut: every run with a repeated anchor becomes a segment row.  Runs whose anchor is held by
   very many rows are cut into single windows instead, so that no group of different segments that
   must meet in one place can grow with the corpus.
4. Equal segments become one (combined before the shuffle), and whole anchor groups meet in batches of
   bounded size, where an index over the batch (FM-index or radix sort) finds the repeated windows.
5. What it finds goes back to the rows that hold the segments, and from there to the documents.

Rows are keyed by (key, tag): the id, or a hash of the text where the id is null, and a 64-bit hash of the
text, which tells rows apart that share an id but not a text.  What is compared is compared as text; results find their way
back to the rows by (anchor, hash of the segment, its length).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import written
from quarrystone.llm.winnow import anchor_places, gram_hashes, runs

#: Bytes of text that are cut at once.
PIECE_BYTES = 1 << 20
#: An anchor in more rows than this has its runs cut into single windows.
HOT_ROWS = 10_000
#: Bytes of segments that one index holds, but for the last anchor group.
SHARD_BYTES = 1 << 20


class Cutter:
    """Cuts texts into pieces of symbols.  window and gram are counted in symbols."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def canonical(self, text: str) -> bytes:
        raise NotImplementedError

    def split(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        """Pieces of one text and the number of the first symbol of each; they overlap by window - 1 symbols."""
        raise NotImplementedError

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Of joined pieces: symbols, bounds of the pieces, the bytes, and where in them each symbol starts and ends."""
        raise NotImplementedError

    def pieces(self, texts) -> Iterator[tuple]:
        """Row number and first symbol of each piece, then what symbols() returns."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for row, text in enumerate(texts):
            for piece, base in self.split(self.canonical(text)):
                held.append((row, base, piece))
                size += len(piece)
                if size >= PIECE_BYTES:
                    yield self._ready(held)
                    held, size = [], 0
        if held:
            yield self._ready(held)

    def _ready(self, held):
        return np.array([r for r, _, _ in held]), np.array([b for _, b, _ in held]), *self.symbols([p for _, _, p in held])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("tag"), "doc_id", "text")


def row_anchors(rows: DataFrame, cutter: Cutter) -> DataFrame:
    """key, tag, anchors, places: the distinct anchors of a row, or of a piece of it, and in how many places each stands; a written table."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, tag = batch["key"].to_numpy(), batch["tag"].to_numpy()
            for owner, _, symbols, bounds, *_ in cutter.pieces(batch["text"]):
                place, anchor = anchor_places(symbols, bounds, cutter.window, cutter.gram)
                if len(place):
                    row = owner[np.searchsorted(bounds, place, side="right") - 1]
                    order = np.lexsort((anchor, row))
                    row, anchor = row[order], anchor[order]
                    fresh = np.ones(len(row), bool)
                    fresh[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                    at = np.flatnonzero(fresh)
                    n = np.diff(np.append(at, len(row))).astype(np.int32)
                    row, anchor = row[at], anchor[at]
                    cut = np.flatnonzero(row[1:] != row[:-1]) + 1
                    firsts = np.concatenate(([0], cut))
                    yield pd.DataFrame({
                        "key": key[row[firsts]], "tag": tag[row[firsts]], "anchors": pd.Series(np.split(anchor, cut), dtype=object), "places": pd.Series(np.split(n, cut), dtype=object)
                    })

    return written(rows.select("key", "tag", "text").mapInPandas(found, "key long, tag long, anchors array<long>, places array<int>"), "anchors")


def counted_anchors(anchors: DataFrame) -> DataFrame:
    """anchor, places, rows of the anchors of row_anchors()."""
    each = anchors.select(F.explode(F.arrays_zip("anchors", "places")).alias("a"))
    return each.groupBy(F.col("a.anchors").alias("anchor")).agg(F.sum("a.places").alias("places"), F.count("*").alias("rows"))


def segments(rows: DataFrame, cutter: Cutter, anchors: DataFrame, repeats: DataFrame) -> DataFrame:
    """anchor, skey, size (hash and length that with the anchor stand for the segment), seg, key, tag, start: the segments of every row whose anchor is in repeats (anchor, hot)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(a) for a in batch["anchors"]]
            wanted = np.concatenate([np.asarray(a, np.int64) for a in batch["anchors"]])
            crowded = np.unique(np.concatenate([np.asarray(h, np.int64) for h in batch["hot"]]))
            # (row, anchor) pairs are looked up as one number; a false match only adds a segment that repeats nothing
            pairs = np.unique(wanted * np.int64(0x2545F4914F6CDD1D | 1) + np.repeat(np.arange(len(batch)), sizes))
            for owner, base, symbols, bounds, buffer, begins, ends in cutter.pieces(batch["text"]):
                first, length, anchor = runs(symbols, bounds, cutter.window, cutter.gram)
                if not len(first):
                    continue
                piece = np.searchsorted(bounds, first, side="right") - 1
                keep = among(pairs, anchor * np.int64(0x2545F4914F6CDD1D | 1) + owner[piece])
                first, length, anchor, piece = first[keep], length[keep], anchor[keep], piece[keep]
                if len(crowded) and len(first):
                    each = among(crowded, anchor)
                    if each.any():
                        n = np.where(each, length, 1)
                        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        first, piece, each = np.repeat(first, n) + inside, np.repeat(piece, n), np.repeat(each, n)
                        length = np.where(each, 1, np.repeat(length, n))
                        whole = gram_hashes(symbols, cutter.window).view(np.int64)
                        anchor = np.where(each, whole[first], np.repeat(anchor, n))
                if len(first):
                    row = owner[piece]
                    seg = [buffer[a:b] for a, b in zip(begins[first].tolist(), ends[first + length + cutter.window - 2].tolist())]
                    yield pd.DataFrame({
                        "anchor": anchor, "skey": np.fromiter(map(xxhash.xxh3_64_intdigest, seg), np.uint64, len(seg)).view(np.int64),
                        "size": np.fromiter(map(len, seg), np.int32, len(seg)), "seg": pd.Series(seg, dtype=object),
                        "key": batch["key"].to_numpy()[row], "tag": batch["tag"].to_numpy()[row], "start": base[piece] + first - bounds[piece],
                    })

    held = anchors.select("key", "tag", F.explode("anchors").alias("anchor")).join(repeats, "anchor")
    # sets: a row that repeats any number of times gathers its anchors once
    lists = held.groupBy("key", "tag").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    return rows.join(lists, ["key", "tag"]).select("key", "tag", "text", "anchors", "hot").mapInPandas(
        cut, "anchor long, skey long, size int, seg binary, key long, tag long, start int"
    )


def among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def by_shard(distinct: DataFrame, find: Callable[[list[bytes], pd.DataFrame], list], schema: str) -> DataFrame:
    """Calls find(segments, rows) on batches of whole anchor groups; returns anchor, skey, size and found."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            anchors = batch["anchor"].to_numpy()
            sizes = np.cumsum(batch["seg"].map(len).to_numpy())
            begin = 0
            while begin < len(batch):
                done = sizes[begin - 1] if begin else 0
                end = int(np.searchsorted(sizes, done + max(SHARD_BYTES - size, 0), side="left")) + 1
                while end < len(batch) and anchors[end] == anchors[end - 1]:
                    end += 1
                if end >= len(batch):
                    held.append(batch.iloc[begin:])
                    size += int(sizes[-1] - done)
                    break
                held.append(batch.iloc[begin:end])
                yield answer(held)
                held, size, begin = [], 0, end
            if size >= SHARD_BYTES and held:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(whole["anchor"].to_numpy(), whole["anchor"].iloc[-1], side="left"))
                if last:
                    yield answer([whole.iloc[:last]])
                    held = [whole.iloc[last:]]
                    size = int(held[0]["seg"].map(len).sum())
        if held:
            yield answer(held)

    def answer(held: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(held, ignore_index=True)
        return pd.DataFrame({"anchor": whole["anchor"], "skey": whole["skey"], "size": whole["size"], "found": find(list(whole["seg"]), whole)})

    dealt = distinct.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(shards, f"anchor long, skey long, size int, found {schema}")


def repeated_anchors(counted: DataFrame, condition: str) -> DataFrame:
    """anchor and hot of the counted anchors that meet the condition, as a written table."""
    return written(counted.filter(condition).select("anchor", (F.col("rows") > HOT_ROWS).alias("hot")), "repeated-anchors")
