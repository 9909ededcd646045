"""Tests of what the reviewer of round 3 found in this subpackage."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quarrystone.llm import suffix_dedup


def test_copies_of_texts_add_no_segments(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randint(2, 9)))
    long = [" ".join(word() for _ in range(300)) for _ in range(6)]
    partly = [long[0][100:700] + long[4], long[5] + "é" + long[0][90:500], "x" * 399, "x" * 400]
    texts = [*long[:3] * 20, long[3], *partly, "short", "short", "", None, None, long[1]]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1])]
    written, counts = suffix_dedup.written, {}

    def counted(df, label):
        out = written(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()

    raw, starts = [(t or "").encode() for _, t in rows], {}
    for at, r in enumerate(raw):
        for k in range(len(r) - 399):
            starts.setdefault(r[k : k + 400], []).append((at, k))
    gone = [bytearray(len(r)) for r in raw]
    for places in starts.values():
        for at, k in places if len(places) > 1 else ():
            gone[at][k : k + 400] = b"\1" * 400
    want = [
        (-1 if i is None else i, len(r), sum(g), sum(a > b for a, b in zip(g, b"\0" + g)), hashlib.sha256(bytes(b for b, x in zip(r, g) if not x)).hexdigest())
        for (i, _), r, g in zip(rows, raw, gone)
    ]
    assert sorted(map(tuple, found)) == sorted(want)
    assert counts["segments"] < 60  # before: those of twenty copies of three texts, some hundreds
