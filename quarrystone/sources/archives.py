"""ZIP containers as a source: members are listed, judged, and only then inflated.

Listing reads central directories: `spark.read.format("zip")` seeks to them in files, `listed` takes containers that already are rows.  What may not be
expanded is judged on the list, by the safety rules and under a budget that all containers share.  What is left is inflated in
chunks by ranges of members, each range a task of its own, with a running hash and no more memory than a chunk.

Nothing that is broken stops a job: a container that does not open is one row with ARCHIVE_DAMAGED and no member, a member that
does not inflate keeps its row and gets ARCHIVE_MEMBER_DAMAGED, and one in a method or encryption that Python does not know ARCHIVE_MEMBER_UNSUPPORTED.

Defined cases: an empty container has no members and no row; a null content is damaged; folders have no hash; members of one name are
told apart by their index; files are opened through Arrow's file systems, so any store that Arrow reads will do.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from quarrystone.sources.files import BUDGET_BYTES, BUDGET_MEMBERS, DEPTH, MEMBER_BYTES, member_error, within_budget
from quarrystone.sources.scratch import kept

LISTED = "path string, member_index int, member_path string, compressed_bytes long, uncompressed_bytes long, crc32 long, encrypted boolean, is_directory boolean, is_link boolean, damage string"
_NAMES = [c.split()[0] for c in LISTED.split(", ")]
#: Bytes that are inflated at once, announced bytes of the members of one range, and bytes of a member that may travel as a value.
CHUNK, RANGE_BYTES, CONTENT_BYTES = 1 << 20, 64 << 20, 64 << 20
#: What a member costs beside its bytes.
MEMBER_COST = 1 << 14
#: Containers whose directories one task of the data source reads.
CONTAINERS = 64
_BROKEN = (zipfile.BadZipFile, EOFError, OSError, ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error, lzma.LZMAError)
_UNKNOWN = (NotImplementedError, RuntimeError)


def directory(path: str, file) -> Iterator[tuple]:
    """Rows of LISTED for one seekable container."""
    try:
        members = zipfile.ZipFile(file).infolist()
        rows = [
            (path, i, m.filename, m.compress_size, m.file_size, m.CRC, bool(m.flag_bits & 1), m.is_dir(), (m.external_attr >> 16) & 0o170000 == 0o120000, None)
            for i, m in enumerate(members)
        ]
    except (*_BROKEN, *_UNKNOWN, TypeError):
        rows = [(path, None, None, None, None, None, None, None, None, "ARCHIVE_DAMAGED")]
    return iter(rows)


def inflated(archive: zipfile.ZipFile, member: int, keep: bool, most: int = MEMBER_BYTES) -> tuple[str | None, str | None, bytes | None]:
    """(sha256, error, content) of a member; never more than its announced size, nor more than most, is inflated."""
    digest, size, chunks = hashlib.sha256(), 0, []
    try:
        info = archive.infolist()[member]
        keep = keep and info.file_size <= CONTENT_BYTES
        with archive.open(info) as stream:
            while chunk := stream.read(CHUNK):
                size += len(chunk)
                if size > min(most, info.file_size):
                    return None, "ARCHIVE_MEMBER_DAMAGED", None
                digest.update(chunk)
                if keep:
                    chunks.append(chunk)
        if size != info.file_size:
            return None, "ARCHIVE_MEMBER_DAMAGED", None
    except _BROKEN:
        return None, "ARCHIVE_MEMBER_DAMAGED", None
    except _UNKNOWN:
        return None, "ARCHIVE_MEMBER_UNSUPPORTED", None
    return digest.hexdigest(), None, b"".join(chunks) if keep else None


# ---- listing


class ZipSource(DataSource):
    """Directories of the ZIP files under a path: a partition for so many files."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], self.options.get("suffix", ".zip"), int(self.options.get("containers", CONTAINERS)))


class ZipReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, containers: int):
        self.path, self.suffix, self.containers = path, suffix, containers

    def partitions(self) -> list[InputPartition]:
        store, root = stores.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.type == stores.FileType.File and f.path.endswith(self.suffix))
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        return [InputPartition([scheme + n for n in names[k : k + self.containers]]) for k in range(0, len(names), self.containers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            yield from directory(path, opened(path))


def opened(path: str):
    """A seekable file, empty where there is none."""
    try:
        store, name = stores.FileSystem.from_uri(path)
        return store.open_input_file(name)
    except OSError:
        return io.BytesIO()


def store(path: str, raw: bytes) -> None:
    """Writes a file whole, whatever the store."""
    place, name = stores.FileSystem.from_uri(path)
    place.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with place.open_output_stream(name) as stream:
        stream.write(raw)


def zip_files(spark: SparkSession, path: str, suffix: str = ".zip", containers: int = CONTAINERS) -> DataFrame:
    """LISTED of all ZIP files under a path (a URI)."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip").option("path", path).option("suffix", suffix).option("containers", str(containers)).load()


def listed(containers: DataFrame) -> DataFrame:
    """LISTED of containers that are rows (path, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                found = list(directory(path, io.BytesIO(raw or b"")))
                for k in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[k : k + 10_000], columns=_NAMES, dtype=object)

    return containers.select("path", "content").mapInPandas(rows, LISTED)


# ---- judging


def judged(members: DataFrame, most_bytes: int = BUDGET_BYTES, most_members: int = BUDGET_MEMBERS, depth: int | None = None) -> DataFrame:
    """members with error: damage, the first safety rule that forbids to expand one, or the shared budget."""
    whole = members.filter("member_index IS NOT NULL")
    budget = within_budget(whole, most_bytes, most_members)
    judged = budget.withColumn("error", F.coalesce(member_error(None if depth is None else F.lit(depth)), "budget_error")).drop("budget_error")
    damaged = members.filter("member_index IS NULL").withColumn("error", F.col("damage"))
    return judged.unionByName(damaged).drop("damage")


# ---- inflating


def expanded(members: DataFrame, containers: DataFrame | None = None, with_content: bool = False) -> DataFrame:
    """judged() members with sha256, and content (where it is asked for and small enough to be a value), of those without an error.

    containers: (path, content) of members that were listed from rows; without them path is opened.  Members go to tasks in ranges that
    follow each other in a container, so a container with most members is read by many tasks."""
    fine = members.filter("error IS NULL AND NOT is_directory")
    cost = F.greatest(F.col("uncompressed_bytes"), F.col("compressed_bytes")) + MEMBER_COST
    so_far = F.sum(cost).over(Window.partitionBy("path").orderBy("member_index").rowsBetween(Window.unboundedPreceding, -1))
    ranged = fine.select("path", "member_index", F.floor(F.coalesce(so_far, F.lit(0)) / RANGE_BYTES).alias("range"))
    ranges = ranged.groupBy("path", "range").agg(F.sort_array(F.collect_list("member_index")).alias("wanted")).drop("range")
    if containers is not None:
        ranges = ranges.join(containers.select("path", "content"), "path")
    else:
        ranges = ranges.withColumn("content", F.lit(None).cast("binary"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, wanted, raw in zip(batch["path"], batch["wanted"], batch["content"]):
                found, held = [], 0
                archive = zipfile.ZipFile(opened(path) if raw is None else io.BytesIO(raw))
                for member in wanted:
                    found.append((path, member, *inflated(archive, int(member), with_content)))
                    held += len(found[-1][-1] or b"")
                    if held >= CONTENT_BYTES or len(found) >= 10_000:
                        yield pd.DataFrame(found, columns=["at", "member", "sha256", "read_error", "content"], dtype=object)
                        found, held = [], 0
                if found:
                    yield pd.DataFrame(found, columns=["at", "member", "sha256", "read_error", "content"], dtype=object)

    bodies = ranges.mapInPandas(read, "at string, member int, sha256 string, read_error string, content binary")
    joined = members.join(bodies, (F.col("path") == F.col("at")) & (F.col("member_index") == F.col("member")), "left")
    return joined.withColumn("error", F.coalesce("error", "read_error")).drop("at", "member", "read_error", *([] if with_content else ["content"]))


def tree(containers: DataFrame, most_bytes: int = BUDGET_BYTES, most_members: int = BUDGET_MEMBERS) -> DataFrame:
    """Members of containers (path, content) and of the containers inside them, to DEPTH levels, with their depth and why one is not opened.

    Each level shares the budget that the levels above have left.  A nested container's path is that of its member."""
    found, level = None, containers.select("path", "content")
    zipped = F.hex(F.substring("content", 1, 4)) == "504B0304"
    for depth in range(1, DEPTH + 1):
        members = kept(judged(listed(level), most_bytes, most_members), "archive-members")
        bodies = kept(expanded(members, level, with_content=True).withColumn("depth", F.lit(depth)), "archive-level")
        rows = bodies if depth < DEPTH else bodies.withColumn("error", F.coalesce("error", F.when(zipped, "ARCHIVE_DEPTH")))
        found = rows.drop("content") if found is None else found.unionByName(rows.drop("content"))
        used, seen = bodies.agg(F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("uncompressed_bytes"))), F.lit(0)), F.count("member_index")).first()
        most_bytes, most_members = most_bytes - used, most_members - seen
        level = bodies.filter(F.col("error").isNull() & zipped).select(F.concat_ws("!", "path", "member_path").alias("path"), "content")
    return found
