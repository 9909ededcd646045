"""Packing in ranges against the record-by-record fold."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators.packing import packed


def folded(rows, capacity):
    out, now, shard, used = [], object(), 0, 0
    for g, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n = max(0, n or 0)
        if g != now:
            now, shard, used = g, 0, 0
        if used and used + n > capacity:
            shard, used = shard + 1, 0
        used += n
        out.append((g, o, shard))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_packing_against_the_fold(spark, seed, parts):
    r = random.Random(seed)
    capacity = r.choice([1, 10, 100, 100_000])
    sizes = r.choice([[0, 1], [0, 0, 0, 7, 200], [3, 5, 40], [1, None, -4, 12]])
    groups = r.choice([["a"], ["a", "b", None], [f"g{k}" for k in range(50)] + ["hot"] * 100])
    rows = [(r.choice(groups), k, r.choice(sizes)) for k in r.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n int").repartition(5).withColumn("g", F.lit(1)).withColumn("shard", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in packed(df, "source", "doc_id", "n", capacity).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(folded(rows, capacity), key=str)


def test_one_group_uses_all_ranges(spark):
    """No task sees the group as a whole."""
    df = spark.range(20_000).select(F.lit("all").alias("g"), "id", (F.col("id") % 17).alias("n"))
    got = packed(df, "g", "id", "n", 50)
    assert sorted(got.collect(), key=lambda r: r.id) == [tuple(x) for x in sorted(folded([("all", k, k % 17) for k in range(20_000)], 50), key=lambda x: x[1])]
    assert "applyInArrow" in got._jdf.queryExecution().toString() or "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()
    assert packed(df.limit(0), "g", "id", "n", 50).count() == 0
