"""Tests of what the reviewer of round 3 found, about the one GraphML file."""

from __future__ import annotations

import gzip

import pytest

from quarrystone.sources import packages
from tests.test_packages import graph


def test_one_graphml_file_is_read_by_many_tasks(spark, tmp_path):
    nodes, edges = graph(spark)
    path = f"file://{tmp_path}/a.gz"
    for n, e, at in ((nodes, edges, path), (nodes.limit(0), edges.limit(0), f"file://{tmp_path}/none.gz")):
        sizes = packages.write_graphml(n, e, at)
        found = packages.member_lines(spark, at, sizes)
        whole = gzip.decompress(open(at.removeprefix("file://"), "rb").read()).decode()
        assert [(r.line, r.value) for r in found.orderBy("line").collect()] == list(enumerate(whole.removesuffix("\n").split("\n"), 1))
        # before: one task for the whole file
        assert found.rdd.getNumPartitions() == len(sizes)
    size = sum(packages.write_graphml(nodes, edges, f"file://{tmp_path}/b.gz"))
    assert packages.member_lines(spark, f"file://{tmp_path}/b.gz", [size]).count() == 3000 + 6000 + 8
    with pytest.raises(Exception, match="ends inside"):
        packages.member_lines(spark, path, [size - 10]).count()
