"""Substring deduplication with compressed FM-indexes.

A word is removed if a window of 13 words that covers it also starts in a document with a smaller id.
Documents are cut into segments that meet, with all segments that could match them, in shards of bounded size
(see ``segments``).  Each shard builds an FM-index over its distinct segments: backward search over a
wavelet matrix computes the matching statistics of the streamed segments, and where a match reaches the length of a window, the least document
id in the interval of its occurrences decides.  Words are compared as they are; hashes route, and name a segment when results go back to its rows.

Defined cases: a null, empty or blank text has no words; a text shorter than the window loses nothing;
rows with a null id keep all their words and remove none elsewhere; repeated rows of one id do not
remove each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, read_table, small_batches, written
from quarrystone.llm.fm_index import FmIndex
from quarrystone.llm.segments import PIECE_BYTES, Cutter, by_shard, counted_anchors, keyed, repeated_anchors, row_anchors, segments

WINDOW_WORDS, GRAM_WORDS = 13, 4


class WordCutter(Cutter):
    """Symbols are hashes of words; bytes are words joined by one space."""

    def __init__(self, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS):
        super().__init__(window, gram)
        rng = np.random.default_rng(13)
        self.letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = 0xD6E8FEB86659FD93
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.empty(0, np.uint64)

    def canonical(self, text: str) -> bytes:
        return b" ".join(text.encode().split())

    def split(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        at = base = 0
        while at < len(raw):
            end = raw.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(raw) else -1
            piece = raw[at:] if end < 0 else raw[at:end]
            yield piece, base
            if end < 0:
                return
            back = end
            for _ in range(self.window - 1):
                back = raw.rfind(b" ", at, back)
                if back < 0:
                    break
            if back <= at:  # words as long as pieces: the next piece takes the rest
                yield raw[at:], base
                return
            base += raw.count(b" ", at, back + 1)
            at = back + 1

    def symbols(self, pieces):
        buffer = b" ".join(pieces)
        raw = np.frombuffer(buffer, np.uint8)
        n = len(raw)
        if n >= len(self.powers):
            size = 2 * n + 1
            self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, self.base, np.uint64))))
            self.inverses = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, self.inverse, np.uint64))))
        spaces = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.append(spaces, n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letters[raw] * self.powers[:n])))
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        bounds = np.concatenate(([0], np.cumsum([p.count(b" ") + 1 for p in pieces])))
        return h ^ (h >> np.uint64(29)), bounds, buffer, starts, ends


def shard_minima(window: int):
    """find() of by_shard(): for each segment, the least document id that holds each of its windows.

    The index holds the distinct segments of the shard; those of the documents are streamed through it, equal ones once."""

    def find(segs: list[bytes], rows: pd.DataFrame) -> list[list[int]]:
        words = [s.split(b" ") for s in segs]
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number) + 1) if w is not None else 0 for ws in words for w in (*ws, None)], np.int64)
        lengths = np.array([len(w) for w in words])
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        index = FmIndex(flat, len(number) + 1, window)
        matched, low, high = index.matching_statistics(flat, begins, begins + lengths)
        repeats = np.flatnonzero(matched == window)  # every window of every segment, with the interval of its occurrences
        # range minima over the suffix order: intervals of one length are equal or apart
        opened, which = np.unique(low[repeats], return_inverse=True)
        closed = np.zeros(len(opened), np.int64)
        closed[which] = high[repeats]
        holder = np.repeat(rows["least"].to_numpy(np.int64), lengths + 1)[index.order]
        marks = np.stack((opened, closed), 1).ravel()
        least = np.minimum.reduceat(np.append(holder, np.iinfo(np.int64).max), marks)[::2][which]
        counts = np.add.reduceat(matched == window, begins)
        return np.split(least, np.cumsum(counts)[:-1])

    return find


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    rows, cutter = keyed(docs, id_col, text_col), WordCutter(window, gram)
    known = rows.filter("doc_id IS NOT NULL")
    anchors = row_anchors(known, cutter)
    repeats = repeated_anchors(counted_anchors(anchors), "rows > 1")
    held = written(segments(known, cutter, anchors, repeats), "segments")
    discard(anchors, repeats)

    distinct = held.groupBy("anchor", "skey", "size", "seg").agg(F.min("key").alias("least"))
    found = written(by_shard(distinct, shard_minima(window), "array<long>"), "segment-minima")
    hits = held.drop("seg").join(found, ["anchor", "skey", "size"]).select(
        "key", "tag", F.expr("filter(transform(found, (x, i) -> if(x < key, int(start + i), null)), p -> p IS NOT NULL)").alias("at")
    )
    marks = hits.filter("size(at) > 0").groupBy("key", "tag").agg(F.flatten(F.collect_list("at")).alias("marks"))

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, marked in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["marks"]):
                raw = cutter.canonical(text)
                n = raw.count(b" ") + 1 if raw else 0
                gone = 0
                if marked is not None and len(marked):
                    edge = np.bincount(marked, minlength=n + 1) - np.bincount(np.asarray(marked) + window, minlength=n + 1)
                    stays = np.cumsum(edge)[:n] == 0
                    gone = n - int(stays.sum())
                    raw = b" ".join(w for w, s in zip(raw.split(b" "), stays.tolist()) if s)
                out.append((doc, n, gone, raw))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    marked = rows.join(marks, ["key", "tag"], "left").select("doc_id", "text", "marks")
    return marked.mapInPandas(removed, "doc_id long, n_words long, n_removed long, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE least < doc_id),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
