"""A word index that outlives a search: postings in the shared folder, read word by word.

A store is a folder.  Each upsert adds a segment: rows (bucket, word, key, places), in one folder for each bucket of the word's hash, sorted by word inside
small row groups with Bloom filters, so a search opens only the buckets of its words and skips the row groups without them.  Places
are delta-coded by the file format.  A word that most documents hold is spread over SPREAD files, so no task writes or reads it alone.

Nothing is ever changed in place.  An upsert or delete also notes the keys it concerns: in segments older than the note they
count no more.  A merge writes what still counts as one segment and drops the notes.  What belongs to the store stands in a manifest with a number;
a change reads the last one and creates the next, which fails if somebody else did so first.

Defined cases: a null or empty text holds no words, its key still takes the place of older texts; a key that stands twice in one batch holds the words of
both rows; null keys are left out; a search on an empty store finds nothing; words are folded as in ``search.words_of``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.gates import GateError
from quarrystone.operators.search import boolean_hits, parsed_query, row_postings, words_of

#: Folders of words, files that one bucket's postings are spread over, bytes of a row group.
BUCKETS, SPREAD, ROW_GROUP = 64, 8, 1 << 20
#: Notes of at most so many keys are sent to all tasks of a search; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Segment:
    """A written part of the store: postings (bucket, word, key, places), or notes (key)."""

    number: int
    path: str
    rows: int


class WordStore:
    """A word index in a folder, over keys of one type.  All changes are seen by readers that look afterwards."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "long", buckets: int = BUCKETS, spread: int = SPREAD):
        self.spark, self.folder, self.key, self.key_type, self.buckets, self.spread = spark, folder.rstrip("/"), key, key_type, buckets, spread
        self.number, self.segments, self.notes = 0, [], []
        self.refresh()

    # ---- manifest

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def refresh(self) -> None:
        """Takes over the last manifest."""
        path, fs = self._path("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if number and number != self.number:
            path, fs = self._path(f"manifest/{number:09d}")
            stream = fs.open(path)
            try:
                found = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            if (found["key_type"], found["buckets"]) != (self.key_type, self.buckets):
                raise GateError("INDEX_LAYOUT_DIFFERS")
            self.segments, self.notes = ([Segment(**s) for s in found[x]] for x in ("segments", "notes"))
        self.number = number

    def _publish(self, segments: list[Segment], notes: list[Segment]) -> None:
        path, fs = self._path(f"manifest/{self.number + 1:09d}")
        body = {"key_type": self.key_type, "buckets": self.buckets, "segments": [vars(s) for s in segments], "notes": [vars(s) for s in notes]}
        try:
            stream = fs.create(path, False)
        except Exception as error:
            raise GateError("INDEX_CHANGED_MEANWHILE") from error
        stream.write(json.dumps(body).encode())
        stream.close()
        self.number, self.segments, self.notes = self.number + 1, segments, notes

    # ---- writing

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def _written(self, postings: DataFrame, number: int, repeated: bool = False) -> Segment:
        """repeated: a word may stand more than once with a key; its places are put together where they meet."""
        path = f"{self.folder}/segments/{number:09d}-{uuid.uuid4().hex}"
        bucketed = postings.withColumn("bucket", self._bucket(F.col("word"))).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(self.spread)))
        dealt = bucketed.repartition(self.buckets * self.spread, "bucket", "part")
        if repeated:
            dealt = dealt.groupBy("bucket", "part", "word", "key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        writer = dealt.select("word", "key", "places", "bucket").sortWithinPartitions("bucket", "word", "key").write.partitionBy("bucket").option("compression", "zstd")
        # version 2 pages code whole numbers by their differences, where no dictionary is asked for
        writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary#places.list.element", "false")
        writer.option("parquet.bloom.filter.enabled#word", "true").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return Segment(number, path, self._read([Segment(number, path, 0)]).count())

    def _noted(self, keys: DataFrame, number: int) -> Segment:
        path = f"{self.folder}/notes/{number:09d}-{uuid.uuid4().hex}"
        keys.select(F.col(self.key).cast(self.key_type).alias("key")).filter("key IS NOT NULL").distinct().write.parquet(path)
        return Segment(number, path, self.spark.read.parquet(path).count())

    def upsert(self, docs: DataFrame, text: str = "text") -> None:
        """Adds documents; those whose key the store holds take the place of the older ones."""
        self.refresh()
        number = self.number + 1
        rows = docs.select(F.col(self.key).cast(self.key_type).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL")
        repeated = not rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        segment = self._written(row_postings(rows, "key", "text"), number, repeated)
        notes = [self._noted(docs, number)] if self.segments else []
        self._publish([*self.segments, segment], [*self.notes, *notes])

    def delete(self, keys: DataFrame) -> None:
        """Takes documents out, by their keys."""
        self.refresh()
        self._publish(self.segments, [*self.notes, self._noted(keys, self.number + 1)])

    def merge(self) -> None:
        """Makes one segment of all that counts.  Files of the parts stay for readers that still hold an older manifest."""
        self.refresh()
        if len(self.segments) > 1 or self.notes:
            self._publish([self._written(self._counting(self._read(self.segments)).drop("segment", "bucket"), self.number + 1)], [])

    # ---- reading

    def _read(self, segments: list[Segment]) -> DataFrame:
        schema = f"word string, key {self.key_type}, places array<int>, bucket int"
        parts = [self.spark.read.schema(schema).parquet(s.path).withColumn("segment", F.lit(s.number)) for s in segments]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment int")

    def _counting(self, postings: DataFrame) -> DataFrame:
        """The postings that no later note takes back."""
        if not self.notes:
            return postings
        notes = reduce(DataFrame.unionAll, [self.spark.read.parquet(n.path).withColumn("since", F.lit(n.number)) for n in self.notes])
        last = notes.groupBy(F.col("key").alias("noted")).agg(F.max("since").alias("since"))
        if sum(n.rows for n in self.notes) <= BROADCAST_KEYS:
            last = F.broadcast(last)
        return postings.join(last, (F.col("key") == F.col("noted")) & (F.col("segment") < F.col("since")), "left_anti")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """(word, key, places) of some words, or of all; only the buckets and row groups of the words are read."""
        found = self._read(self.segments)
        if words is not None:
            wanted = self.spark.range(1).select(F.array([self._bucket(F.lit(w)) for w in words])).first()[0]
            found = found.filter(F.col("bucket").isin(*sorted(set(wanted))) & F.col("word").isin(*words))
        return self._counting(found).select("word", F.col("key").alias(self.key), "places")

    def search(self, query: str) -> DataFrame:
        """The keys that a boolean query finds."""
        words = sorted({w for _, phrase in parsed_query(query) for w in phrase})
        return boolean_hits(self.postings(words), self.key, query)

    def phrase(self, phrase: str) -> DataFrame:
        """The keys whose texts hold the words of a phrase one after another."""
        return self.search('"' + phrase.replace('"', " ") + '"')

    def counts(self) -> DataFrame:
        """word, documents, places of all words."""
        return self.postings().groupBy("word").agg(F.count("*").alias("documents"), F.sum(F.size("places")).cast("long").alias("places"))


def folded(spark: SparkSession, text: str) -> list[str]:
    """The words of a text as a store folds them."""
    return spark.range(1).select(words_of(F.lit(text))).first()[0]
