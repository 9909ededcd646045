"""Packages and GraphML through the store's own file system."""

import gzip
import xml.etree.ElementTree as ET

import pytest

from quarrystone.operators.gates import GateError, gate
from quarrystone.sources import packages, sinks


def graph(spark, n=3000):
    odd = ["a & b", "<x>", 'say "hi"', "it's", "tab\tand\nline\r", "\x00\x0bbad\x1f", "é漢😀", "", None]
    nodes = [(f"n{(k * 7919) % n:05}", "t" if k % 3 else "<t>", odd[k % len(odd)]) for k in range(n)]
    edges = [(f"n{k:05}", ["knows", 'a"b', None][k % 3], f"n{(k * 31) % n:05}") for k in range(n)] * 2
    return spark.createDataFrame(nodes, "node_id string, node_type string, value string").repartition(5), spark.createDataFrame(edges, "from_id string, relation string, to_id string").repartition(5)


def test_one_graphml_file(spark, tmp_path):
    nodes, edges = graph(spark)
    for name in ("a", "b"):
        packages.write_graphml(nodes, edges, f"file://{tmp_path}/{name}.gz")
    whole = gzip.decompress((tmp_path / "a.gz").read_bytes())
    assert whole.decode() == "".join(sinks.graphml_lines(nodes, edges))
    assert (tmp_path / "a.gz").read_bytes() == (tmp_path / "b.gz").read_bytes()
    root = ET.fromstring(whole)
    found = [e.find("{*}data[@key='value']").text for e in root.iter("{http://graphml.graphdrawing.org/xmlns}node")]
    assert len(found) == 3000 and {"a & b", "<x>", 'say "hi"', "tab\tand\nline\r", "��bad�"} < set(found)
    packages.write_graphml(nodes.limit(0), edges.limit(0), f"file://{tmp_path}/none.gz")
    assert gzip.decompress((tmp_path / "none.gz").read_bytes()).decode() == sinks.GRAPHML_HEAD + sinks.GRAPHML_FOOT
    with pytest.raises(GateError, match="TARGET_EXISTS"):
        packages.write_graphml(nodes, edges, f"file://{tmp_path}/a.gz")
    assert sorted(p.name for p in tmp_path.iterdir() if "staging" in p.name) == []


def test_sealed_packages(spark, tmp_path):
    nodes, edges = graph(spark, 50)
    target = f"file://{tmp_path}/deep/package"
    with pytest.raises(GateError, match="GATES_FAILED"):
        packages.publish(spark, {"nodes": nodes}, [gate("G", spark.range(1))], target)
    assert not (tmp_path / "deep/package").exists()
    assert packages.publish(spark, {"nodes": nodes, "edges": edges}, [gate("G", spark.range(0))], target, (nodes, edges)) == {"nodes": 50, "edges": 100}
    faults = lambda: sorted((r.gate, r.rel) for r in packages.package_faults(spark, target).collect())
    assert faults() == [] and {k: v.count() for k, v in packages.read_package(spark, target).items()} == {"nodes": 50, "edges": 100}
    with pytest.raises(GateError, match="TARGET_EXISTS"):
        packages.publish(spark, {"nodes": nodes}, [gate("G", spark.range(0))], target)
    store = packages.Store(spark, target)
    store.write(f"{target}/graph.graphml.gz", iter([b"x"]), overwrite=True)
    assert faults() == [("CHECKSUM_MISMATCH", "graph.graphml.gz")]
    store.delete(f"{target}/graph.graphml.gz")
    assert faults() == [("CHECKSUM_MISSING", "graph.graphml.gz")]
    store.write(f"{target}/SHA256SUMS", iter([store.read(f"{target}/SHA256SUMS") + b"0" * 64 + b"  more\n"]), overwrite=True)
    assert faults() == [("SEAL_MISMATCH", "SEAL.json")]
    with pytest.raises(GateError, match="SEAL_MISMATCH"):
        packages.read_package(spark, target)
    store.delete(f"{target}/SEAL.json")
    assert faults() == [("SEAL_MISSING", "SEAL.json")]
