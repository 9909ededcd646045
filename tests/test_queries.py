import random

import duckdb
import pytest

from tests.compare import assert_same
from tests.conftest import SMALL

from quarrystone.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLES:
        assert_same(df, duck.sql(catalogue.ORACLES[name]))
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_partitions_do_not_change_results(spark, duck, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("timeline_sequence", "attachment_numbering", "greedy_pack"):
            assert_same(catalogue.QUERIES[name](spark, SMALL), duck.sql(catalogue.ORACLES[name]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_frames_use_all_components(spark, tmp_path):
    r = random.Random(11)
    frames = []
    for label in range(3):
        seeds = [[r.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(4)]
        for k in range(60):
            signs = list(r.choice(seeds))
            for place in r.sample(range(64) if k % 2 else range(16, 64), r.randrange(8)):
                signs[place] *= -1
            frames.append((label * 1000 + k, label, [x * r.uniform(0.1, 2) for x in signs]))
    spark.createDataFrame(frames, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = {i: int("".join("1" if x > 0 else "0" for x in v), 2) for i, _, v in frames}
    # the later copies of every tenth frame, which the queries add
    turned = {0: 0, 10: 1, 20: 1 + (1 << 20), 30: 2 + (1 << 40) + (1 << 62), 40: 1 + 4 + (1 << 33) + (1 << 50)}
    copies = [(i + 10_000_000, label, None) for i, label, _ in frames if i % 10 == 0]
    bits |= {i: bits[i - 10_000_000] ^ turned[i % 50] for i, *_ in copies}
    frames += copies
    want = {
        (a, b, (bits[a] ^ bits[b]).bit_count())
        for a, la, _ in frames for b, lb, _ in frames if la == lb and a < b and (bits[a] ^ bits[b]).bit_count() <= 3
    }
    found = catalogue.QUERIES["frame_pairs"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) > 0 and {tuple(x) for x in found} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(catalogue.QUERIES["frame_pairs"](spark, str(tmp_path)), con.sql(catalogue.ORACLES["frame_pairs"]))
    assert_same(catalogue.QUERIES["frames_kept"](spark, str(tmp_path)), con.sql(catalogue.ORACLES["frames_kept"]))
    kept = {x.vec_id: x.kept for x in catalogue.QUERIES["frames_kept"](spark, str(tmp_path)).collect()}
    held: dict[int, list[int]] = {}
    for i, label, _ in frames:
        new = all((bits[i] ^ h).bit_count() > 3 for h in held.setdefault(label, []))
        held[label] += [bits[i]] * new
        assert kept[i] == new
    assert len(set(kept.values())) == 2
