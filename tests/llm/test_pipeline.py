"""The pipeline's stages and registered queries of this subpackage."""

import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tests.compare import assert_same
from tests.conftest import SMALL
from tests.llm.test_operators import brute_fingerprint, least_reachable

from quarrystone.llm import bpe, queries
from quarrystone.llm.common import small_batches


def test_queries_with_sql(spark, duck):
    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, SMALL), duck.sql(sql))


def test_names_and_sizes(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.QUERIES["op7_sharding"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_pipeline_against_plain_python(spark):
    small_batches(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, SMALL)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in left.items()}
    firsts: dict[str, int] = {}
    for i in sorted(left):
        firsts.setdefault(norm[i], i)
    exact = sorted(firsts.values())
    prints = {i: brute_fingerprint(left[i]) for i in exact}
    label = least_reachable(exact, [(a, b) for a in exact for b in exact if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    near = [i for i in exact if label[i] == i]
    coder = bpe.PrefixBpe(bpe.byte_bpe_path())
    want = {(i, len(coder.encode(left[i])), hashlib.sha256(left[i].encode()).hexdigest()) for i in near}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_near_keeps_one_row_of_each_group(spark):
    small_batches(spark)
    base, other, third = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    rows = [
        (None, base), (3, base), (None, base), (None, other), (None, other), (5, third), (5, other + " x y z quite another end of it " + base[::-1]), (4, third)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[3], rows[6], rows[7]]))


CLASHES = (
    "__digest", "__again", "__kept_id", "__kept_digest", "__row", "__component", "__place", "_mix_source", "_mix_bucket", "_mix_rank", "_mix_piece", "slots",
    "digest", "id", "norm", "key", "fp", "node", "p"
)


def odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, a missing source, and columns with the names the stages use."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(120_000))
    rows = [
        (1, "one text here", "a"), (1, "one text here", "a"), (2, "one  text\there", "b"), (3, None, "a"), (4, "", None), (None, "one text here", "a"),
        (None, None, None), (5, long, "a"), (6, long + " tail", "b"), (7, " \n", "a"), (8, "quite another text of eight words or so", "c")
    ]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def test_stages_on_odd_rows(spark, tmp_path):
    rows, docs = odd_rows(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows)
    exact = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    ids = lambda df: sorted(map(str, (r.doc_id for r in df.collect())))
    assert ids(exact) == ["1", "3", "5", "6", "7", "8"]
    near = corpus_pipeline.near(spark, exact, str(tmp_path))
    # a text that is one space has no words, like the empty one
    assert near.columns == docs.columns and ids(near) == ["1", "3", "5", "8"]
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and ids(mixed) == ids(docs)
    coder = bpe.PrefixBpe(bpe.byte_bpe_path())
    got = corpus_pipeline.bpe(spark, docs, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len(coder.encode(t or "")))) for i, t, _ in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    _, docs = odd_rows(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_mixed_order_of_the_pipeline(spark, tmp_path):
    """The rows of the mix stage, file after file, follow the plan: every stretch of whole blocks holds each source in its share."""
    docs = spark.createDataFrame([(i, "t", "hot" if i % 4 else "rare") for i in range(4000)], "doc_id long, text string, source string")
    corpus_pipeline.mixing(spark, docs, SMALL).write.parquet(f"{tmp_path}/mixed")
    order = [
        r.source
        for r in spark.read.parquet(f"{tmp_path}/mixed").withColumn("f", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("f", "n").collect()
    ]
    share = 0.75**0.5 / (0.75**0.5 + 0.25**0.5)
    blocks = [order[k] for k in range(0, len(order), 32)]
    first_end = 31 * (1 / (1 - share))  # slots until the rare source, of 32 blocks, runs out
    for slot in range(1, int(first_end) + 1):
        assert abs(blocks[:slot].count("hot") - share * slot) < 1 + 1e-9
