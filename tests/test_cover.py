"""The cover of relation windows against the sequential rule, on windows with holes."""

import random

import pytest

from quarrystone.operators.records import window_cover


def sequential(ids, windows, anchors):
    queue, seen = sorted(anchors), set()
    added = []
    for a in queue:
        seen |= windows.get(a, set()) | {a}
    while left := [i for i in sorted(ids) if i not in seen]:
        added.append(left[0])
        seen |= windows.get(left[0], set()) | {left[0]}
    return added


@pytest.mark.parametrize("seed", range(5))
def test_cover_against_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(1000), 150)
    order = sorted(ids)
    windows = {}
    for k, i in enumerate(order):
        held = {order[j] for j in range(max(0, k - 9), min(len(order), k + 10)) if r.random() < 0.5}
        if r.random() < 0.9:
            windows[i] = held
    anchors = order[::30] + [order[-1]]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = df([(a, c) for a, held in windows.items() for c in held] + [(order[0], 5000)], "anchor long, covered long")
    got = window_cover(df([(i,) for i in ids] * 2, "mail long"), pairs, df([(a,) for a in anchors], "mail long"), "mail").collect()
    assert sorted(x.mail for x in got if x.round) == sequential(ids, windows, anchors) != []
    assert sorted(x.mail for x in got if not x.round) == sorted(anchors) and len({x.round for x in got}) > 2


def test_cover_of_nothing(spark):
    none = spark.createDataFrame([], "mail long")
    pairs = spark.createDataFrame([], "anchor long, covered long")
    assert window_cover(none, pairs, none, "mail").count() == 0
    one = spark.createDataFrame([(7,)], "mail long")
    assert [tuple(x) for x in window_cover(one, pairs, none, "mail").collect()] == [(7, 1)]
