"""Importance resampling towards a target distribution.

A text is described by its runs of one to three consecutive words, hashed into BUCKETS buckets.  A bucket's gain says how
much more common it is in the target than in the corpus; the weight of a text is the sum of the gains of
its features, and with Gumbel noise drawn from a hash of the id its score.  The highest scores are the sample.

The draw needs no sort of the corpus: scores are integers, so their exact histogram is small.  Suffix sums of the counts say how many
rows stand above each score; the last score that still has a place is the cutoff, and rows below it are done.  Each
surviving score numbers its own rows by id, from its offset on.

Suffix sums are taken in two levels: over at most COARSE + 1 ranges of scores, and inside each range over its scores.

Features are hashed where the texts lie: the CRC of a run of words follows from those of its words by shifts, which are
linear, so a text costs one CRC for each word and a few table look-ups for each feature.

Defined cases: a null, empty or wordless text has no features and weight 0; a null id draws its noise as the word null and comes
last among ties; rows that are alike get ranks of their own; an empty target or corpus counts nothing and
gives every bucket the gain of its zero counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, reduce
from operator import xor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.common import read_table, small_batches, written

BUCKETS, LONGEST_RUN, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Ranges of scores that one task sums up.
COARSE = 4096
#: Lower-cases A-Z, keeps digits, a-z and all that is not ASCII, and makes a space of every other byte.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Word lengths whose shifts are tables; longer words are shifted in steps.
_TABLES = 64


@cache
def shift_tables() -> np.ndarray:
    """[n, k, b]: what n zero bytes after it make of a CRC whose byte k is b and whose others are 0, all without the inversions of CRC-32."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    found = np.zeros((_TABLES, 4, 256), np.uint32)
    found[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _TABLES):
        found[n] = one[found[n - 1] & 255] ^ (found[n - 1] >> 8)
    return found


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a CRC contributes when n more bytes follow."""
    tables = shift_tables()
    crc, n = crc.copy(), n.copy()
    while len(n) and n.max() >= _TABLES:
        far = np.flatnonzero(n >= _TABLES)
        crc[far] = shifted(crc[far], np.full(len(far), _TABLES - 1))
        n[far] -= _TABLES - 1
    return reduce(xor, (tables[n, k, (crc >> (8 * k)) & 255] for k in range(4)))


def features(texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and of all features the number of their text and their bucket."""
    words = [t.encode().translate(_WORDS).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    crc = np.array([zlib.crc32(w) for ws in words for w in ws], np.uint32)
    size = np.array([len(w) for ws in words for w in ws], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    run, rows, found = crc, [owner], [crc % buckets]
    for n in range(1, LONGEST_RUN):
        run = shifted(run[: len(crc) - n], size[n:] + 1) ^ spaced[n:]
        inside = owner[n:] == owner[: len(owner) - n]
        rows.append(owner[n:][inside])
        found.append(run[inside] % buckets)
        if not len(run):
            break
    return counts, np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts; each task adds up its own before anything is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch["text"], buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held.astype(np.int32), "n": total[held]})

    found = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(counted, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket, from two tables of at most so many rows."""

    def column(counts: DataFrame) -> np.ndarray:
        found = np.zeros(buckets)
        for bucket, n in counts.collect():  # at most one row a bucket
            found[bucket] = n
        return found

    s, t = column(corpus), column(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, rows, found = features(batch["text"], buckets)
            weight = np.zeros(len(batch), np.int64)
            np.add.at(weight, rows, gain[found])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_words": n_words, "n_features": np.bincount(rows, minlength=len(batch)), "weight": weight
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return found.withColumn("score", F.col("weight") + noise)


def score_offsets(scores: DataFrame) -> DataFrame:
    """score, n, above: of each score its rows and the rows of greater scores."""
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    width = ((high - low) // COARSE + 1) if low is not None else 1
    ranged = histogram.withColumn("range", F.floor((F.col("score") - F.lit(low or 0)) / F.lit(width)))
    falling = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    coarse = ranged.groupBy("range").agg(F.sum("n").alias("rows")).select("range", F.coalesce(F.sum("rows").over(falling), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(F.broadcast(coarse), "range").select("score", "n", (F.col("before") + F.col("within")).alias("above"))


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null where it is not drawn)."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = written(weighed(docs, gain, id_col, text_col, seed), "importance")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    offsets = written(score_offsets(scored.filter(able)), "importance-offsets").filter(F.col("above") < drawn)
    cutoff = offsets.agg(F.min("score")).first()[0]

    survives = able & (F.col("score") >= cutoff)
    rest = scored.filter(~survives).select(*columns, F.lit(None).cast("long").alias("rank"))
    # rows that are alike are one row of the window and are told apart after it
    alike = scored.filter(survives).groupBy(*columns).agg(F.count("*").alias("rows"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    first = alike.withColumn("first", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows") + 1)
    placed = first.join(offsets.select("score", "above"), "score").select(
        *columns, F.explode(F.sequence(F.col("above") + F.col("first"), F.col("above") + F.col("first") + F.col("rows") - 1)).alias("rank")
    )
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return importance_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: CRC-32 goes byte by byte over a table of 256 values, which the query derives from the polynomial 0xEDB88320.
OP13_SQL = r"""
WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i))),
txt AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM txt),
f AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS x FROM w),
u AS MATERIALIZED (
  SELECT x, xor(list_reduce(list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) % 10000 AS b FROM (SELECT DISTINCT x FROM f), tab),
n AS MATERIALIZED (SELECT side, r, b, count(*) AS n FROM f JOIN u USING (x) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM n GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
p AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM n JOIN g USING (b) WHERE side = 'd' GROUP BY r),
z AS (
  SELECT r, id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM w LEFT JOIN p USING (r) WHERE side = 'd'),
s AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS of FROM s WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= of * 5 // 100 THEN place END AS rank FROM s LEFT JOIN o USING (r)
"""
