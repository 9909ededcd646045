"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next.  All but the last return the columns of docs.

1. toxicity drops documents whose probability of being toxic reaches the threshold; the chain is
   fitted on labels of sf_dir.  2. exact keeps the first document of each group of equal texts.  3. near keeps the
   first document of each SimHash component (whole texts, three words to a shingle, three bits).  4. mix lays the rows out
   in the order of the Pfair schedule; it drops none.  5. bpe encodes and decodes every text that is left.

Rows without an id, and rows that share one, are judged as all others: exactly one row of a group stays in stage 3, the
one with the least id; rows without an id come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.bpe import bpe_digests, byte_bpe_path
from quarrystone.llm.common import read_table, small_batches, written
from quarrystone.llm.exact_dedup import exact_dedup, normalised, sha256
from quarrystone.llm.mixing import in_mixed_order, mix
from quarrystone.llm.simhash import simhash_components
from quarrystone.llm.toxicity import train, without_toxic

#: SQL has no classifier, SimHash fingerprint or BPE: the tests hold the pipeline against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the chain finds toxic; a null text holds no words and stays."""
    small_batches(spark)
    return without_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column, row: what a stage adds clashes with no column of docs."""
    return docs.select(F.struct("*").alias("row"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of equal texts, white space aside; a null text is an empty one, of repeated rows one stays."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    marked = packed(docs).withColumn("digest", sha256(normalised(F.col("row.text"))))
    firsts = marked.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    again = F.row_number().over(Window.partitionBy("row.doc_id", "digest").orderBy("row.text"))
    return firsts.withColumn("again", again).filter("again = 1").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each component of near texts; texts without words are near each other."""
    small_batches(spark)
    keyed = written(packed(docs).withColumn("key", F.monotonically_increasing_id()), "near-rows")
    found = simhash_components(keyed, "key", "row.text").select(F.col("doc_id").alias("key"), F.coalesce("component_id", "doc_id").alias("component"))
    place = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row.text"), F.col("key").alias("key"))
    ranked = keyed.select("key", place.alias("place")).join(found, "key")
    kept = ranked.groupBy("component").agg(F.min("place")["key"].alias("key")).select("key")
    return keyed.join(kept, "key", "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture; rows without a source are a source of their own."""
    rows = packed(docs).select("row", "row.doc_id", "row.source")
    return in_mixed_order(mix(rows)).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, tokens and decoded text of every row as digests; a null text is an empty one."""
    small_batches(spark)
    return bpe_digests(docs, byte_bpe_path())


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("mix", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
