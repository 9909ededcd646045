"""The stored word index: what a search reads, and what it finds before and after changes."""

import glob
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from quarrystone.operators import search, word_store
from quarrystone.operators.gates import GateError
from quarrystone.operators.word_store import WordStore

QUERY = 'the AND (of OR "for the") NOT "of the" OR éra'


@pytest.fixture()
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(word_store, "ROW_GROUP", 4096)
    return WordStore(spark, f"file://{tmp_path}/words", buckets=8, spread=2)


def keys(df):
    return sorted(r[0] for r in df.collect())


def fresh(docs, query=QUERY):
    return keys(search.boolean_hits(search.word_index(docs, "doc_id", "text"), "doc_id", query))


def scanned(df):
    """Rows and bytes of files that a plan has read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(k).metrics() for k in range(leaves.size())]
    read = lambda name: sum(m.apply(name).value() for m in metrics if m.contains(name))
    return read("numOutputRows"), read("filesSize")


def test_searches_follow_changes(spark, store):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert keys(store.search(QUERY)) == []
    store.upsert(docs)
    assert keys(store.search(QUERY)) == fresh(docs) != []
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("era "), "text")).when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("text")))
    store.upsert(changed.filter("doc_id % 3 < 2"))
    assert keys(store.search(QUERY)) == fresh(changed)
    store.delete(docs.filter("doc_id % 5 = 0"))
    left = changed.filter("doc_id % 5 <> 0")
    assert keys(store.search(QUERY)) == fresh(left)
    store.upsert(docs.filter("doc_id = 5"))  # what was taken out may come back
    left = left.unionByName(docs.filter("doc_id = 5"))
    before = sorted(map(str, store.postings().collect()))
    other = WordStore(spark, store.folder, buckets=8)  # a reader that has opened the store anew, and stays where it is
    store.merge()
    assert len(store.segments) == 1 and store.notes == [] and len(other.segments) == 3
    assert sorted(map(str, store.postings().collect())) == sorted(map(str, other.postings().collect())) == before
    assert keys(store.search(QUERY)) == fresh(left) == keys(other.search(QUERY))
    assert keys(store.phrase("of the")) == fresh(left, '"of the"')


def test_a_search_reads_its_words_only(spark, store):
    r = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 40), i -> concat('w', pmod(xxhash64(id, i), 5000))), 'hot')").alias("text"))
    store.upsert(r)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, size = scanned(store.postings(["w17"]))
        all_rows, all_size = scanned(store.postings())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all_rows == store.segments[0].rows > 150_000 and size < all_size / 4 and rows < all_rows / 40
    assert store.postings(["w17"]).count() == r.filter("text rlike '\\\\bw17\\\\b'").count() > 0 and store.postings(["nowhere"]).count() == 0
    files = glob.glob(store.segments[0].path.removeprefix("file://") + "/bucket=*/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    places = [m.row_group(g).column(2) for m in groups for g in range(m.num_row_groups)]
    assert len(places) > 2 * len(files) and all("DELTA_BINARY_PACKED" in c.encodings for c in places)
    hot = [f for f in files if "hot" in pq.read_table(f, columns=["word"])["word"].to_pylist()]
    assert len(hot) == 2  # the word of all documents lies in as many files as it is spread over


def test_odd_texts_and_keys(spark, store):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "three"), (None, "one"), (4, "ONE, Two! öne")], "doc_id long, text string")
    store.upsert(docs.withColumn("word", F.lit("x")).withColumn("bucket", F.lit(9)))
    assert keys(store.search("one")) == [3, 4] and keys(store.search('"one two" NOT three')) == [4]
    store.upsert(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(4)))
    assert keys(store.search("one OR two")) == [3]
    store.upsert(docs.limit(0))
    store.delete(docs.limit(0))
    assert keys(store.search("one OR two")) == [3]
    assert word_store.folded(spark, "Çà, x1!") == ["ca", "x1"]


def test_changes_meet(spark, store):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    store.upsert(docs)
    late = WordStore(spark, store.folder, buckets=8)
    store.upsert(docs.withColumn("doc_id", F.lit(2)))
    with pytest.raises(GateError, match="INDEX_CHANGED_MEANWHILE"):
        late._publish(late.segments, [])
    late.upsert(docs.withColumn("doc_id", F.lit(3)))
    assert keys(WordStore(spark, store.folder, buckets=8).search("a")) == [1, 2, 3]
    with pytest.raises(GateError, match="INDEX_LAYOUT_DIFFERS"):
        WordStore(spark, store.folder, buckets=16)
    text = WordStore(spark, f"{store.folder}-{uuid.uuid4().hex}", key="name", key_type="string")
    text.upsert(spark.createDataFrame([("x", "a")], "name string, text string"))
    assert keys(text.search("a")) == ["x"]
