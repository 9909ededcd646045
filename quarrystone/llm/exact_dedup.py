"""Exact deduplication with a log-structured merge index of text digests.

Each task of the scan is a memtable, bounded by what a task reads: it flushes its (digest, id) entries as a sorted
Parquet run that carries a Bloom filter of its digests.  No text and no row is shuffled for that.  Compaction
merges runs by digest, keeps the smallest identifier and the number of rows, and writes a sorted
run of the next level.  Digests held by more than one row are hits; their whole texts are compared
byte by byte (grouping by digest *and* text), so two texts that share a digest stay apart.

A batch of documents flushes once and compacts once; an index that lives on takes further flushes, compacts a level
when it is full, and answers lookup() of a few digests from the row groups whose filters may hold them.

Only DataFrame functions are used.  Copies are combined before every shuffle of texts, and the one
join with a hot key (rows with the merged run) has no aggregate above it, so Spark can split it.

Defined cases: a null text counts as the empty text; rows with a null id follow the rest of their
group (null only if the whole group has no id); of repeated rows with the smallest id one stays;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACES, scratch_path, written

#: A hit list of at most this many digests (32 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_DIGESTS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Sorted runs of (digest, id, rows) on shared storage, by level."""

    FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "50000"}

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 4):
        self.spark, self.root, self.fanout = spark, root or scratch_path(spark, "digests"), fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, entries: DataFrame, level: int) -> str:
        path = f"{self.root}/level={level}/run={self.made}"
        entries.sortWithinPartitions("digest", "id").write.options(**self.FILTER).option("compression", "zstd").parquet(path)
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        return path

    def flush(self, entries: DataFrame) -> DataFrame:
        """Adds (digest, id) rows as level-0 runs, one for each task, and merges a level that is full; returns the rows as written."""
        entries = entries.select("digest", "id", F.lit(1).cast("long").alias("rows"))
        path = self._write(entries, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return self._read(path)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("digest binary, id long, rows long").parquet(*paths)

    def runs(self, level: int | None = None) -> DataFrame:
        return self._read(*(p for k, level_paths in enumerate(self.levels) for p in level_paths if level in (None, k)))

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next, where each digest has its smallest id and its number of rows.
        The files of merged runs stay: a flush may still be read."""
        self._write(self._least(self.runs(level)), level + 1)
        self.levels[level] = []

    @staticmethod
    def _least(runs: DataFrame) -> DataFrame:
        return runs.groupBy("digest").agg(F.min("id").alias("id"), F.sum("rows").alias("rows"))

    def merged(self) -> DataFrame:
        """Over all runs: the smallest id of each digest and its number of rows.  One run above level 0 needs no merge."""
        runs = self.runs()
        single = not self.levels[0] and sum(map(len, self.levels)) == 1
        return (runs if single else self._least(runs)).select("digest", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """merged() of the given digests.  Parquet skips the row groups whose filter or bounds rule a digest out: each is asked for
        by an equality that reaches the scan."""
        asked = [self._least(self.runs().filter(F.col("digest") == F.lit(d))) for d in dict.fromkeys(digests)]
        found = reduce(DataFrame.unionByName, asked, self.runs().limit(0))
        return found.select("digest", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))

    index = DigestIndex(spark)
    entries = index.flush(texts)
    index.compact(0)
    merged = index.merged()

    hits = merged.filter("group_size > 1").select("digest")
    if hits.count() <= BROADCAST_DIGESTS:
        hits = F.broadcast(hits)
    groups = texts.join(hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = written(groups.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "shared-digests")

    alike = entries.groupBy("digest", "id").agg(F.sum("rows").alias("rows"))
    found = alike.join(merged, "digest").select("digest", "id", "rows", "keep_id", "group_size")
    if not shared.isEmpty():
        apart = texts.join(shared, "digest", "left_semi").groupBy("digest", "norm", "id").agg(F.count("*").alias("rows"))
        firsts = texts.join(shared, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(firsts, ["digest", "norm"]).select(*found.columns)
        found = found.join(shared, "digest", "left_anti").unionByName(apart)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("rows")), lambda i: F.col("id").eqNullSafe(F.col("keep_id")) & (i == 1))).alias("kept"),
        "digest",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import read_table

    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
