"""Sources: files of any kind, JSON and JSONL with line numbers, CSV with required headers, SQLite, archives, ledgers."""

from __future__ import annotations

import io
import os
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quarrystone.operators.gates import require_columns
from quarrystone.operators.ordered import running_totals

#: Limits of archive expansion.
MEMBER_BYTES, RATIO, RATIO_FROM, DEPTH, BUDGET_BYTES, BUDGET_MEMBERS = 2 << 30, 10_000, 100 << 20, 4, 4 << 30, 10_000
#: Signatures at the start of a file, in order: hex beginning, magic, category, mime type.
SIGNATURES = (
    ("255044462D", "pdf", "document", "application/pdf"),
    ("89504E470D0A1A0A", "png", "image", "image/png"),
    ("FFD8FF", "jpeg", "image", "image/jpeg"),
    ("474946383761", "gif", "image", "image/gif"),
    ("474946383961", "gif", "image", "image/gif"),
    ("49492A00", "tiff", "image", "image/tiff"),
    ("4D4D002A", "tiff", "image", "image/tiff"),
    ("664C6143", "flac", "audio", "audio/flac"),
    ("4F676753", "ogg", "audio", "audio/ogg"),
    ("494433", "mp3", "audio", "audio/mpeg"),
    ("1A45DFA3", "matroska", "video", "video/x-matroska"),
    ("526172211A0700", "rar", "archive", "application/vnd.rar"),
    ("526172211A070100", "rar", "archive", "application/vnd.rar"),
    ("D0CF11E0A1B11AE1", "ole-compound", "legacy-office", "application/x-ole-storage"),
    ("252150532D41646F6265", "eps", "eps", "application/postscript"),
)
OOXML = (("word/", "ooxml-word"), ("xl/", "ooxml-excel"), ("ppt/", "ooxml-powerpoint"))


def inventory(spark: SparkSession, *roots: str) -> DataFrame:
    """Files under the roots: path, rel, bytes, modified, sha256, extension, content; unfinished .part files are left out."""
    frames = []
    for root in roots:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        rel = F.regexp_replace("path", r"^.*?\Q" + root.split("://")[-1].rstrip("/") + r"\E/", "")
        frames.append(read.filter(~F.col("path").endswith(".part")).select(
            "path", rel.alias("rel"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"),
            F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "content"
        ))
    return reduce(DataFrame.unionByName, frames)


def identified(files: DataFrame) -> DataFrame:
    """magic, category and mime of files by signature, then names inside a ZIP, then extension, then the look of the text."""
    head = F.hex(F.substring("content", 1, 16))
    riff = head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645")
    mpeg = F.rlike(head, F.lit("^FF[EF]"))
    boxed = F.substring(head, 9, 8) == "66747970"
    zipped = head.startswith("504B0304")

    @F.pandas_udf("string")
    def zip_kind(content: pd.Series) -> pd.Series:
        def kind(raw: bytes) -> str:
            try:
                names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, struct.error, OverflowError):
                return "bad-zip"
            return next((k for prefix, k in OOXML if any(n.startswith(prefix) for n in names)), "zip")

        return pd.Series([None if c is None else kind(c) for c in content], dtype=object)

    video, audio = F.col("extension").isin(".mp4", ".m4v", ".mov", ".avi", ".mkv", ".webm"), F.col("extension").isin(".m4a", ".aac", ".mp3", ".wav", ".flac", ".ogg")
    image = F.col("extension").isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")
    sample = F.substring("content", 1, 4096).cast("string")
    printable = F.length(F.regexp_replace(sample, r"[^\P{C}\r\n\t]", "")) >= F.length(sample) * 0.92
    sniffed = F.when(F.length("content") == 0, "text-sniffed").when(F.rlike(sample, F.lit(r"^﻿?\s*[\[{]")), "json-text").when(F.rlike(sample, F.lit(r"^﻿?\s*<")), "markup-text").otherwise("text-sniffed")
    kinds = [(head.startswith(sig), m, c, t) for sig, m, c, t in SIGNATURES]
    kinds[7:7] = [(riff, "wav", "audio", "audio/wav")]
    late = [
        (mpeg, "mp3", "audio", "audio/mpeg"),
        (boxed & video, "iso-bmff", "video", "video/mp4"), (boxed & audio, "iso-bmff", "audio", "audio/mp4"), (boxed, "iso-bmff", "media", "application/octet-stream"),
        (F.col("extension") == ".eps", "eps", "eps", "application/postscript"), (F.col("extension") == ".json", "json", "text", "application/json"),
        (F.col("extension").isin(".html", ".htm", ".xhtml"), "html", "text", "text/html"), (F.col("extension").isin(".txt", ".csv", ".tsv", ".md", ".log", ".xml", ".rels", ".jsonl"), "text", "text", "text/plain"),
    ]
    spot = lambda i, end: reduce(lambda rest, k: F.when(k[0], F.lit(k[i])).otherwise(rest), reversed(kinds + late), end)
    z = F.when(zipped, zip_kind(F.when(zipped, F.col("content"))))
    typed = files.withColumn("_zip", z)
    magic = F.when(F.col("_zip").isNotNull(), F.col("_zip")).otherwise(spot(1, F.when(printable, sniffed).otherwise("binary")))
    by_name = F.when(image, "image").when(audio, "audio").when(video, "video").otherwise("other")
    category = F.when(F.col("_zip") == "zip", "archive").when(F.col("_zip") == "bad-zip", "other").when(F.col("_zip").isNotNull(), "office").otherwise(spot(2, F.when(printable, "text").otherwise(by_name)))
    office = F.when(F.col("_zip") == "ooxml-word", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(F.col("_zip") == "ooxml-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").when(
        F.col("_zip") == "ooxml-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation"
    )
    by_look = F.when(sniffed == "json-text", "application/json").when(sniffed == "markup-text", "text/markup").otherwise("text/plain")
    mime = F.when(F.col("_zip").isNotNull(), F.coalesce(office, F.lit("application/zip"))).otherwise(spot(3, F.when(printable, by_look).otherwise("application/octet-stream")))
    return typed.withColumn("magic", magic).withColumn("category", category).withColumn("mime", mime).drop("_zip")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_rel, line, value: the lines of text files with their physical numbers from 1, blank ones too.

    Files of any size are read in blocks: lines are numbered inside a block, and a block begins after the lines of those before it."""
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("source_rel"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    counts = rows.groupBy("source_rel", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source_rel").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_rel", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source_rel", "_block").orderBy("_row"))
    line = (F.col("_before") + F.col("_inside")).cast("long")
    bare = F.regexp_replace("value", "\r$", "")
    numbered = rows.withColumn("_inside", inside).join(offsets, ["source_rel", "_block"])
    return numbered.select("source_rel", line.alias("line"), F.when(line == 1, F.regexp_replace(bare, "^\ufeff", "")).otherwise(bare).alias("value"))


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_rel, line, json, status: physical line numbers from 1; blank lines count but give no row."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").withColumnRenamed("value", "json")
    parsed = F.try_parse_json("json")
    status = F.when(parsed.isNull(), "invalid_jsonl_line").when(F.rlike("json", F.lit(r"^\s*[\[{]")), "parsed").otherwise("parsed_json_scalar")
    return lines.select("source_rel", "line", "json", status.alias("status"))


def ledger(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of an append-only JSONL ledger: bad lines fail the read if strict, else they are dropped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_rel and json of files that hold one JSON document, told by their first character."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("source_rel"), F.regexp_replace("value", "^﻿", "").alias("json")
    )
    return files.filter(F.rlike("json", F.lit(r"^\s*[\[{]")))


def csv_required(spark: SparkSession, path: str, required: list[str], code: str) -> DataFrame:
    """CSV with a header, a byte order mark or not; missing columns raise an error with the code."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return require_columns(df.toDF(*(c.lstrip("﻿") for c in df.columns)), required, code)


class SqliteSource(DataSource):
    """Tables of an SQLite file, read only.  Options: path, table, parts (ranges of rowid)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _connect(self) -> sqlite3.Connection:
        c = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        c.execute("PRAGMA query_only = 1")
        return c

    def schema(self) -> StructType:
        kinds = {"INT": LongType(), "REA": DoubleType(), "FLO": DoubleType(), "DOU": DoubleType()}
        table = self.options["table"].replace('"', '""')
        with self._connect() as c:
            return StructType([StructField(r[1], kinds.get((r[2] or "")[:3].upper(), StringType())) for r in c.execute(f'PRAGMA table_info("{table}")')])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = options, [f.name for f in schema.fields]
        self.table = options["table"].replace('"', '""')

    def _query(self, sql: str, *args) -> Iterator[tuple]:
        c = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            yield from c.execute(sql, args)
        finally:
            c.close()

    def partitions(self) -> list[InputPartition]:
        parts = int(self.options.get("parts", 1))
        try:
            low, high = next(self._query(f'SELECT min(rowid), max(rowid) FROM "{self.table}"'))
        except sqlite3.OperationalError:  # a table without rowid is read in one piece
            return [InputPartition(None)]
        if low is None or parts == 1:
            return [InputPartition(None)]
        step = -(-(high - low + 1) // parts)
        return [InputPartition((low + k * step, low + (k + 1) * step)) for k in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        if partition.value is None:
            yield from self._query(f'SELECT {names} FROM "{self.table}"')
        else:
            yield from self._query(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', *partition.value)


def sqlite_table(spark: SparkSession, path: str, table: str, parts: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("parts", str(parts)).load()


def make_local_folder(path: str) -> None:
    """The folder of a local file, where it is not there yet."""
    os.makedirs(os.path.dirname(path), exist_ok=True)


def member_error(depth: Column | None = None) -> Column:
    """Why a member must not be expanded, by the first rule that holds; null if it may be."""
    path = F.replace(F.col("member_path"), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    unsafe = path.startswith("/") | F.rlike(path, F.lit("^[A-Za-z]:")) | F.exists(parts, lambda p: p.isin("..", "."))
    ratio = (F.col("uncompressed_bytes") > RATIO_FROM) & (F.col("uncompressed_bytes") > F.col("compressed_bytes") * RATIO)
    case = F.when(unsafe, "ARCHIVE_MEMBER_UNSAFE_PATH").when(F.col("is_link"), "ARCHIVE_MEMBER_SYMLINK").when(F.col("encrypted"), "ARCHIVE_MEMBER_ENCRYPTED").when(F.col("uncompressed_bytes") > MEMBER_BYTES, "ARCHIVE_MEMBER_TOO_LARGE").when(ratio, "ARCHIVE_MEMBER_RATIO")
    return case if depth is None else F.when(depth >= DEPTH, "ARCHIVE_DEPTH").otherwise(case)


def within_budget(members: DataFrame, most_bytes: int = BUDGET_BYTES, most_members: int = BUDGET_MEMBERS) -> DataFrame:
    """budget_error of members under a budget shared by all containers in order of path and member; what crosses it becomes a gap."""
    order = [F.lower("member_path"), "member_index"]
    inside = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = members.groupBy(F.col("path").alias("_path")).agg(F.sum("uncompressed_bytes").alias("_b"), F.count("*").alias("_n"))
    offsets = running_totals(totals, ["_path"], {"_ob": "_b", "_on": "_n"}).select("_path", "_ob", "_on")
    placed = members.withColumn("_ib", F.sum("uncompressed_bytes").over(inside)).withColumn("_in", F.count("*").over(inside)).join(offsets, F.col("path") == F.col("_path"))
    error = F.when(F.col("_ob") + F.col("_ib") > most_bytes, "ARCHIVE_BUDGET_BYTES").when(F.col("_on") + F.col("_in") > most_members, "ARCHIVE_BUDGET_MEMBERS")
    return placed.withColumn("budget_error", error).drop("_ib", "_in", "_ob", "_on", "_path")


def manifest_faults(manifest: DataFrame, occurrences: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What does not bind in manifests (manifest_id, mails, resources) of occurrences (manifest_id, mail_id, artifact_rel, sha256, bytes):
    announced counts, and resources whose file is missing or is not what it was."""
    counted = occurrences.groupBy("manifest_id").agg(F.countDistinct("mail_id").alias("m"), F.count("*").alias("r"))
    joined = manifest.join(counted, "manifest_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("m", "r")})
    wrong = F.when(F.col("mails") != F.col("m"), "MANIFEST_MAIL_COUNT").when(F.col("resources") != F.col("r"), "MANIFEST_RESOURCE_COUNT")
    counts = joined.select("manifest_id", F.lit("").alias("artifact_rel"), wrong.alias("fault")).filter("fault IS NOT NULL")
    there = artifacts.select("artifact_rel", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    bound = occurrences.join(there, "artifact_rel", "left")
    fault = F.when(F.col("_sha").isNull(), "MANIFEST_ARTIFACT_MISSING").when(F.col("_sha") != F.col("sha256"), "MANIFEST_ARTIFACT_HASH").when(F.col("_bytes") != F.col("bytes"), "MANIFEST_ARTIFACT_BYTES")
    return counts.unionByName(bound.select("manifest_id", "artifact_rel", fault.alias("fault")).filter("fault IS NOT NULL").distinct())


def manifest_occurrences(manifests: DataFrame) -> DataFrame:
    """Mails and their related resources of manifests (manifest_id, mails array), with 1-based ordinals and their place."""
    mails = manifests.select("manifest_id", F.posexplode("mails").alias("m", "mail"))
    rows = mails.select("manifest_id", "m", F.col("mail.mail_id").alias("mail_id"), F.posexplode("mail.related_resources").alias("r", "resource"))
    return rows.select(
        "manifest_id", "mail_id", (F.col("m") + 1).alias("mail_ordinal"), (F.col("r") + 1).alias("resource_ordinal"),
        F.format_string("/mails/%d/related_resources/%d", "m", "r").alias("source_pointer"), "resource"
    )


def newest_sessions(statuses: DataFrame, case: str = "case_id", modified: str = "modified") -> DataFrame:
    """The newest status of each case; ties go to the path that sorts last."""
    return statuses.withColumn(
        "_r", F.row_number().over(Window.partitionBy(case).orderBy(F.col(modified).desc(), F.col("path").desc()))
    ).filter("_r = 1").drop("_r")
