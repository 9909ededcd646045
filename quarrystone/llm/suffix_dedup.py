"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every byte is removed that a 400-byte string covers which also starts anywhere else, in the same
document or another.  Segments that can hold such strings meet in shards of bounded size (see
``segments``).  There, suffixes are ordered through 400 bytes only, most significant digit first, 64
bytes a digit; a pass regroups the suffixes that are still equal, and suffixes that stand
alone drop out.  What is left after the last pass are exactly the repeated strings.

Copies of whole texts are combined first: such a text, if it has a window, is removed whole, and one of its copies
stands for all where other texts are searched, so copies add no segments and what is written grows with different texts.

Defined cases: a null text is empty; a text shorter than the window loses nothing; rows with a null id take
part as any other; repeated rows of one id count as places of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, read_table, small_batches, written
from quarrystone.llm.segments import PIECE_BYTES, Cutter, by_shard, counted_anchors, repeated_anchors, row_anchors, segments

WINDOW_BYTES, GRAM_BYTES = 400, 32
#: Bytes of a digit at most.
DIGIT = 64


class ByteCutter(Cutter):
    """Symbols are bytes of UTF-8."""

    def __init__(self, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES):
        super().__init__(window, gram)

    def canonical(self, text: str) -> bytes:
        return text.encode()

    def split(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(raw):
            yield raw[at : at + PIECE_BYTES + self.window - 1], at
            at += PIECE_BYTES
            if len(raw) - at < self.window:
                return

    def symbols(self, pieces):
        buffer = b"".join(pieces)
        place = np.arange(len(buffer) + 1)
        return np.frombuffer(buffer, np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), buffer, place[:-1], place[1:]


def digits(raw: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """The number of the digit that begins at each place, equal for equal bytes and in their order, and its width: the widest
    power of two up to DIGIT that fits the depth.  A digit is numbered from the two halves that were numbered before."""
    number, width = raw.astype(np.int64), 1
    while 2 * width <= min(depth, DIGIT):
        after = np.zeros(len(number), np.int64)
        after[:-width] = number[width:]
        pair = number * (number.max(initial=0) + 1) + after
        width *= 2
        number = pair if width <= 2 else np.unique(pair, return_inverse=True)[1]
    return number, width


def repeated_suffixes(raw: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes at starts share their first depth bytes with another of their group; most significant digit first.
    If the depth is no multiple of a digit, the last digit overlaps the one before, which all suffixes still grouped share."""
    repeated = np.zeros(len(starts), bool)
    digit, width = digits(raw, depth)
    radix = int(digit.max(initial=0)) + 1
    live = np.arange(len(starts))
    group = np.unique(group, return_inverse=True)[1]
    for at in [*range(0, depth - width, width), depth - width]:
        if not len(live):
            return repeated
        value = group * radix + digit[starts[live] + at]
        order = np.argsort(value)
        live, value = live[order], value[order]
        fresh = np.ones(len(live) + 1, bool)
        fresh[1:-1] = value[1:] != value[:-1]
        shared = ~(fresh[:-1] & fresh[1:])
        group = np.cumsum(fresh[:-1])[shared]
        live = live[shared]
    repeated[live] = True
    return repeated


def shard_repeats(window: int):
    """find() of by_shard(): for each segment, the windows that repeat, as first, count, first, count ..."""

    def find(segs: list[bytes], rows: pd.DataFrame) -> list[list[int]]:
        raw = np.frombuffer(b"".join(segs), np.uint8)
        lengths = np.array([len(s) for s in segs])
        begins = np.cumsum(lengths) - lengths
        counts = lengths - window + 1
        owner = np.repeat(np.arange(len(segs)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        anchor, copied = rows["anchor"].to_numpy(), rows["copies"].to_numpy() > 1
        alone = np.ones(len(segs), bool)
        alone[1:] &= anchor[1:] != anchor[:-1]
        alone[:-1] &= anchor[1:] != anchor[:-1]
        # a copied segment repeats as a whole; it is ordered only where others of its anchor can repeat it in part
        ordered = np.flatnonzero(~(alone & copied)[owner])
        hit = copied[owner]
        hit[ordered] |= repeated_suffixes(raw, (begins[owner] + inside)[ordered], anchor[owner[ordered]], window)
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:]
        keep = hit[first]
        first, last = first[keep], last[keep]
        pairs = np.stack((inside[first], last - first), 1)
        edges = np.searchsorted(owner[first], np.arange(len(segs) + 1))
        return [pairs[a:b].ravel() for a, b in zip(edges[:-1], edges[1:])]

    return find


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and two hashes of the text, key and tag, by which equal texts meet."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.xxhash64("text").alias("key"), F.xxhash64(F.md5("text")).alias("tag"), "doc_id", "text")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, kept: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, or what an expression over kept makes of them before they are dealt to the rows)."""
    rows, cutter = told_apart(docs, id_col, text_col), ByteCutter(window, gram)
    texts = written(rows.groupBy("key", "tag", "text").agg((F.count("*") > 1).alias("copied")), "texts")
    anchors = row_anchors(texts, cutter)
    repeats = repeated_anchors(counted_anchors(anchors), "places > 1")
    held = written(segments(texts, cutter, anchors, repeats), "segments")
    discard(anchors, repeats)

    distinct = held.groupBy("anchor", "skey", "size", "seg").agg(F.count("*").alias("copies"))
    found = written(by_shard(distinct, shard_repeats(window), "array<int>").filter("size(found) > 0"), "segment-repeats")
    hits = held.drop("seg").join(found, ["anchor", "skey", "size"]).select(
        "key", "tag", F.expr("transform(found, (x, i) -> if(i % 2 = 0, int(start + x), x))").alias("spans")
    )
    marks = hits.groupBy("key", "tag").agg(F.flatten(F.collect_list("spans")).alias("marks"))

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, tag, text, copied, marked in zip(batch["key"], batch["tag"], batch["text"], batch["copied"], batch["marks"]):
                raw = text.encode()
                gone = spans = 0
                kept = raw
                if copied and len(raw) >= window:
                    gone, spans, kept = len(raw), 1, b""
                elif marked is not None and len(marked):
                    pair = np.asarray(marked).reshape(-1, 2)
                    edge = np.bincount(pair[:, 0], minlength=len(raw) + 1) - np.bincount(pair[:, 0] + pair[:, 1] + window - 1, minlength=len(raw) + 1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(raw) - int(stays.sum())
                    spans = int(np.count_nonzero(~stays[1:] & stays[:-1])) + int(not stays[0])
                    kept = np.frombuffer(raw, np.uint8)[stays].tobytes()
                out.append((key, tag, len(raw), gone, spans, kept))
            yield pd.DataFrame(out, columns=["key", "tag", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = texts.join(marks, ["key", "tag"], "left").select("key", "tag", "text", "copied", "marks")
    found = marked.mapInPandas(removed, "key long, tag long, n_bytes long, n_removed long, n_spans long, kept binary")
    if kept is not None:
        found = found.withColumn("kept", kept)
    return rows.select("key", "tag", "doc_id").join(found, ["key", "tag"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = suffix_dedup(read_table(spark, sf_dir, "documents"), kept=F.sha2("kept", 256))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
