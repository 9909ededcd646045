"""Packages in any store that Spark reads: one GraphML file, checksums by tasks, a seal that is written last.

A package is made in a staging folder beside its target and moved there by one rename, when all gates hold, every table has as many rows
as were written, and its checksums are listed.  The seal names the digest of that list, so whoever finds a seal that fits has the whole package; readers
take nothing else.  Everything goes through the store's own file system; tables, elements and checksums are the work of tasks, and the driver
copies bytes of compressed parts at most.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.gates import GateError, enforce, report
from quarrystone.sources.sinks import GRAPHML_FOOT, GRAPHML_HEAD, checksum_faults, checksum_rows, edge_elements, node_elements, write_tables

#: Compressed bytes that are read at once.
PIECE_BYTES = 1 << 20
SUMS, SEAL = "SHA256SUMS", "SEAL.json"


class Store:
    """The file system behind a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, parts: Iterator[bytes | str], overwrite: bool = False) -> None:
        """A new file of bytes and of the contents of other files, by their paths, one after another."""
        out = self.fs.create(self._path(path), overwrite)
        try:
            for part in parts:
                if isinstance(part, bytes):
                    out.write(part)
                else:
                    source = self.fs.open(self._path(part))
                    try:
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, self._conf, False)
                    finally:
                        source.close()
        finally:
            out.close()

    def names(self, folder: str) -> list[str]:
        """Paths of the data files in a folder, by name."""
        found = [f.getPath().toString() for f in self.fs.listStatus(self._path(folder))]
        return sorted(f for f in found if not f.rsplit("/", 1)[1].startswith(("_", ".")))

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def move(self, source: str, target: str) -> None:
        if self.exists(target) or not self.fs.rename(self._path(source), self._path(target)):
            raise GateError(f"TARGET_EXISTS: {target}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def member(text: str) -> bytes:
    """A gzip member without a time."""
    return gzip.compress(text.encode(), mtime=0)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> list[int]:
    """The whole graph as one gzip file, nodes and edges in order.  Tasks write sorted ranges, each a member of the file; members are joined as they are.
    Returns the bytes of each member, by which member_lines() reads them apart."""
    spark = nodes.sparkSession
    store, staging = Store(spark, path), f"{path}.staging-{uuid.uuid4().hex}"
    try:
        for name, lines, order in (("nodes", node_elements(nodes), ["node_id"]), ("edges", edge_elements(edges), ["from_id", "relation", "to_id"])):
            sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
            sorted_lines.write.option("compression", "gzip").option("lineSep", "\n").text(f"{staging}/{name}")
        parts = [*store.names(f"{staging}/nodes"), *store.names(f"{staging}/edges")]
        whole = [member(GRAPHML_HEAD), *parts, member(GRAPHML_FOOT)]
        store.write(f"{staging}/whole", iter(whole))
        store.move(f"{staging}/whole", path)
        return [len(part) if isinstance(part, bytes) else store.size(part) for part in whole]
    finally:
        store.delete(staging)


def member_lines(spark: SparkSession, path: str, sizes: list[int]) -> DataFrame:
    """line (from 1) and value of one gzip file whose members end with a line each; a task reads a member, or some short ones, piece by piece.

    Lines are numbered inside a member, and a member begins after the lines of those before it: members are counted first and read then.  A store that Arrow does
    not know is read by one task, in the order of its lines."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):
        return spark.read.option("lineSep", "\n").text(path).select((F.monotonically_increasing_id() + 1).alias("line"), "value")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
        """Member, and its whole lines, some megabytes at a time."""
        store, at = fs.FileSystem.from_uri(path)
        for batch in batches:
            for k, offset, size in batch[["member", "offset", "size"]].itertuples(index=False):
                unpack, rest = zlib.decompressobj(31), b""
                with store.open_input_file(at) as source:
                    source.seek(offset)
                    while size:
                        piece = source.read(min(size, PIECE_BYTES))
                        if not piece:
                            raise EOFError(f"{path} ends inside a member")
                        size -= len(piece)
                        text = [rest]
                        while piece:
                            unpack = zlib.decompressobj(31) if unpack.eof else unpack
                            text.append(unpack.decompress(piece))
                            piece = unpack.unused_data
                        whole, end, rest = b"".join(text).rpartition(b"\n")
                        if end:
                            yield k, whole
                if rest or not unpack.eof:
                    raise EOFError(f"a member of {path} ends inside a line")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, whole in lines(batches):
            yield pd.DataFrame({"member": [k], "n": [whole.count(b"\n") + 1]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, 0
        for k, whole in lines(batches):
            at = at if k == last else 0
            values = whole.decode().split("\n")
            yield pd.DataFrame({"member": k, "at": range(at + 1, at + len(values) + 1), "value": values})
            last, at = k, at + len(values)

    begins = [sum(sizes[:k]) for k in range(len(sizes))]
    # as many tasks as members: dealt by number, each to a partition of its own
    members = spark.createDataFrame(spark.sparkContext.parallelize(list(zip(range(len(sizes)), begins, sizes)), len(sizes)), "member long, offset long, size long")
    found = members.mapInPandas(counted, "member long, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    n = {r.member: r.n for r in found}
    before = spark.createDataFrame([(k, sum(n.get(j, 0) for j in range(k))) for k in range(len(sizes))], "member long, before long")
    numbered = members.mapInPandas(read, "member long, at long, value string").join(F.broadcast(before), "member")
    return numbered.select((F.col("before") + F.col("at")).alias("line"), "value")


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], gates: list[DataFrame], target: str, graph: tuple[DataFrame, DataFrame] | None = None
) -> dict[str, int]:
    """A sealed package at target, and the rows of its tables.  Nothing stands at target unless all of it holds; a package that is there stays."""
    target = target.rstrip("/")
    store, staging = Store(spark, target), f"{target}.staging-{uuid.uuid4().hex}"
    if store.exists(target):
        raise GateError(f"TARGET_EXISTS: {target}")
    enforce(report(*gates))
    try:
        seen = {name: Observation(f"rows {name}") for name in tables}
        counts = write_tables({name: df.observe(seen[name], F.count("*").alias("n")) for name, df in tables.items()}, f"{staging}/tables")
        for name in tables:
            if counts[name] != seen[name].get["n"]:
                raise GateError(f"PARQUET_COUNT: {name}")
        if graph:
            write_graphml(*graph, f"{staging}/graph.graphml.gz")
        sums = b"".join(f"{r.sha256}  {r.rel}\n".encode() for r in checksum_rows(spark, staging, SUMS).orderBy("rel").toLocalIterator())
        store.write(f"{staging}/{SUMS}", iter([sums]))
        store.write(f"{staging}/{SEAL}", iter([json.dumps({"sums": hashlib.sha256(sums).hexdigest(), "rows": counts}, sort_keys=True).encode()]))
        store.move(staging, target)
    finally:
        store.delete(staging)
    return counts


def sealed(spark: SparkSession, target: str) -> dict:
    """The seal of a package; an error where it is missing or does not fit the list of checksums."""
    store = Store(spark, target)
    if not store.exists(f"{target}/{SEAL}"):
        raise GateError("SEAL_MISSING")
    seal = json.loads(store.read(f"{target}/{SEAL}").decode())
    if not store.exists(f"{target}/{SUMS}") or hashlib.sha256(store.read(f"{target}/{SUMS}")).hexdigest() != seal["sums"]:
        raise GateError("SEAL_MISMATCH")
    return seal


def read_package(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of a sealed package."""
    return {name: spark.read.parquet(f"{target}/tables/{name}") for name in sealed(spark, target)["rows"]}


def package_faults(spark: SparkSession, target: str) -> DataFrame:
    """gate and rel of all that does not hold in a package: its seal, and every file against the list."""
    schema = "gate string, rel string"
    try:
        sealed(spark, target)
    except GateError as error:
        return spark.createDataFrame([(str(error), SEAL)], schema)
    lines = spark.read.text(f"{target}/{SUMS}")
    listed = lines.select(F.substring("value", 1, 64).alias("sha256"), F.expr("substring(value, 67)").alias("rel"))
    there = checksum_rows(spark, target, SUMS).filter(F.col("rel") != SEAL)
    return checksum_faults(listed, there).select(F.col("fault").alias("gate"), "rel")
