"""Sources, sinks and streams: files are written from the tables into the shared folder and read back through the engine's own readers."""

from __future__ import annotations

import sqlite3
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import urls
from quarrystone.functions.keys import short_key
from quarrystone.operators import gates
from quarrystone.plans import graph_queries, package_queries
from quarrystone.plans.tables import table
from quarrystone.sources import archives, files, packages, sinks
from quarrystone.sources.scratch import kept, scratch_folder, stored
from quarrystone.streaming import paths, state

#: Lines of one file that is read whole, because its lines are numbered.
FILE_LINES = 1000


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _one_file_each(df: DataFrame, key: str, order: str, folder: str) -> None:
    """value of df as text, one file for each key, its lines in order."""
    df.repartition(key).sortWithinPartitions(key, order).select(key, "value").write.partitionBy(key).text(folder)


def _events_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSONL files; some lines are blank, broken or scalars."""
    n = F.col("event_id") % 50
    line = F.when(n == 7, "").when(n == 13, "{broken").when(n == 21, "42").otherwise(F.coalesce("props", F.lit("{}")))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / FILE_LINES).alias("page"), "event_id", line.alias("value"))


def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSONL files with their physical number and how they parse."""
    folder = _folder(spark, "jsonl")
    _one_file_each(_events_as_lines(spark, sf_dir), "page", "event_id", folder)
    page = F.regexp_extract("source_rel", r"page=(\d+)", 1).cast("long")
    return files.jsonl_lines(spark, folder).select(page.alias("page"), "line", "json", "status")


def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a tolerant ledger: lines that are no objects drop out."""
    folder = _folder(spark, "ledger")
    _one_file_each(_events_as_lines(spark, sf_dir), "page", "event_id", folder)
    return files.ledger(spark, folder, "k long").filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("lines"))


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files: every third begins with a byte order mark, every fourth is no JSON and is left out."""
    folder = _folder(spark, "json")
    n = table(spark, sf_dir, "nation")
    body = F.to_json(F.struct("n_nationkey", "n_name"))
    marked = F.when(F.col("n_nationkey") % 4 == 3, "plain text").when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("\ufeff "), body)).otherwise(body)
    _one_file_each(n.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("o"), marked.alias("value")), "n", "o", folder)
    found = files.json_documents(spark, folder).select(F.from_json("json", "n_nationkey int, n_name string").alias("d"))
    return found.select("d.*")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through CSV: quotes, commas and line breaks survive, and required columns are there."""
    folder = _folder(spark, "csv")
    p = table(spark, sf_dir, "part")
    sinks.write_csv(p.select("p_partkey", F.concat("p_name", F.lit(' "x", '), "p_brand", F.lit("\n2")).alias("p_name"), "p_size"), folder)
    return files.csv_required(spark, folder, ["p_partkey", "p_name"], "PARTS_HEADER").select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size")
    )


def source_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions (30 rows) through an SQLite file, read only, in three ranges of rows.  The file lies on a path that all machines mount."""
    path = scratch_folder(spark).removeprefix("file:").replace("///", "/") + f"/nations-{uuid.uuid4().hex}.sqlite3"
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = [tuple(r) for r in joined.orderBy("n_nationkey").collect()]
    files.make_local_folder(path)
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE places (n_nationkey INTEGER, n_name TEXT, r_name TEXT)")
        c.executemany("INSERT INTO places VALUES (?, ?, ?)", rows)
    return files.sqlite_table(spark, path, "places", parts=3)


#: Of the archives of pages: every eleventh is cut off, in every seventh the last member is damaged, every fifth holds a member that announces far too much.
_CUT, _DAMAGED, _BOMB = 11, 7, 5


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in ZIP files of twenty; every seventeenth page has a name that leads out of the archive.  Some archives and members are damaged."""

    def zipped(key, rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import struct
        import zipfile

        out, n = io.BytesIO(), int(key[0])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, html in rows.sort_values("page_id")[["page_id", "html"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(f"../{i:09d}.html" if i % 17 == 0 else f"pages/{i:09d}.html"), html)
            if n % _BOMB == 4:
                z.writestr(zipfile.ZipInfo("pages/bomb"), b"")
            last = z.infolist()[-1]
        raw = bytearray(out.getvalue())
        if n % _BOMB == 4:  # its entry in the directory, which is the last, says three gigabytes
            at = raw.rfind(b"PK\x01\x02")
            raw[at + 24 : at + 28] = struct.pack("<I", 3 << 30)
        elif n % _DAMAGED == 3:
            raw[last.header_offset + 30 + len(last.filename)] ^= 0xFF
            raw[last.header_offset + 14] ^= 0xFF
        if n % _CUT == 2:
            raw = raw[: len(raw) // 2]
        return pd.DataFrame({"path": [f"archive-{n:09d}.zip"], "content": [bytes(raw)]})

    p = table(spark, sf_dir, "pages").select((F.floor(F.col("page_id") / 20)).alias("archive"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    return p.groupBy("archive").applyInPandas(zipped, "path string, content binary")


def source_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives, why one must not be or could not be expanded, and what falls outside a budget that all archives share."""
    made = kept(_archives(spark, sf_dir), "archives")
    members = kept(archives.judged(archives.listed(made), 1 << 60, 1 << 60), "archive-members")
    return archives.expanded(members, made).select("path", "member_index", "member_path", "uncompressed_bytes", "sha256", "error")


def source_archive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives under a budget that ends within them: what lies beyond is not read."""
    made = kept(_archives(spark, sf_dir), "archives")
    members = kept(archives.judged(archives.listed(made).filter("uncompressed_bytes < 3000000000"), 400_000, 1 << 60), "archive-members")
    return archives.expanded(members, made).select("path", "member_index", "sha256", "error")


def source_archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives as files, read through the data source: directories first, then ranges of members."""
    folder = _folder(spark, "zips")

    def stored(batches):
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                archives.store(f"{folder}/{path}", raw)
            yield batch[["path"]]

    kept(_archives(spark, sf_dir).mapInPandas(stored, "path string"), "archive-names")
    members = kept(archives.judged(archives.zip_files(spark, folder), 1 << 60, 1 << 60), "archive-members")
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("path")
    return archives.expanded(members).select(name, "member_index", "member_path", "uncompressed_bytes", "sha256", "error")


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two roots by their content: size, hash, kind; unfinished files are left out."""
    first, second = _folder(spark, "root-a"), _folder(spark, "root-b")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    _one_file_each(n.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("o"), F.col("n_name").alias("value")), "n", "o", first)
    _one_file_each(r.select(F.col("r_regionkey").alias("n"), F.lit(0).alias("o"), F.to_json(F.struct("r_name")).alias("value")), "n", "o", second)
    found = files.identified(files.inventory(spark, first, second))
    return found.select(F.regexp_extract("rel", r"^n=(\d+)/", 1).cast("int").alias("n"), "bytes", "sha256", "magic", "category", "mime")


#: Most of a package are keys in hex: pages of the second version hold their lengths and common beginnings apart from their digits, and
#: a low level does not look for short repeats among digits, which take more bytes than the digits themselves.
PACKAGE_PARQUET = {"parquet.writer.version": "v2", "parquet.compression.codec.zstd.level": "2"}


def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a relation package as Parquet, rows of one file beside each other, and the rows that reading back finds."""
    folder = _folder(spark, "package")

    def write(name: str, df: DataFrame) -> DataFrame:
        return stored(df, f"{folder}/{name}", **PACKAGE_PARQUET)

    counts = {name: df.count() for name, df in package_queries.built(spark, sf_dir, write, by_file=True).items()}
    return spark.createDataFrame(list(counts.items()), "table_name string, row_count long")


#: Tables of the first package by the types that its readers expect.
V1_SPECS = {
    "nodes": "node_id string, node_type string, value string, source_rel string", "relation_occurrence": "from_id string, relation string, to_id string, source_rel string",
    "relation_fact": "from_id string, relation string, to_id string, evidence_count bigint, first_source string, last_source string", "files": "artifact_id string, source_rel string, source_scope string, source_sha256 string, source_bytes bigint",
    "tasks": "task_id string, source_rel string, error_code string", "coverage": "source_scope string, files bigint, bytes bigint", "lineage": "lineage_id string, target_table string, target_key string", "text_documents": "source_rel string, task_id string, text_chars bigint",
}


def sink_v1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tables of the first package, cast to their column specs, written and read back: rows and columns of each."""
    artifacts, edges = kept(package_queries.pkg_artifacts(spark, sf_dir), "v1-files"), graph_queries.case_edges(spark, sf_dir)
    # facts are told by their subject one after another, so that its hash is stored once
    facts = graph_queries.relation_fact(spark, sf_dir).sortWithinPartitions("from_id")
    gaps, done = kept(package_queries.pkg_source_gap_task(spark, sf_dir), "v1-gaps"), kept(package_queries.pkg_derived_artifacts(spark, sf_dir), "v1-derived")
    texts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_rel"),
        F.length(F.coalesce("text", F.lit(""))).alias("text_chars")
    )
    built = {
        "nodes": graph_queries.case_nodes(spark, sf_dir), "relation_occurrence": edges, "relation_fact": facts, "files": artifacts,
        "tasks": gaps.select("task_id", "source_rel", "error_code").unionByName(done.select("task_id", "source_rel", F.lit(None).cast("string").alias("error_code"))),
        "coverage": artifacts.groupBy("source_scope").agg(F.count("*").alias("files"), F.sum("source_bytes").alias("bytes")), "lineage": package_queries.pkg_lineage(spark, sf_dir, {"source_gap_task": gaps, "derived_artifacts": done}), "text_documents": done.join(texts, "source_rel"),
    }
    typed = {name: built[name].select(*(F.col(part.split()[0]).cast(part.split()[1]) for part in spec.split(", "))) for name, spec in V1_SPECS.items()}
    folder = _folder(spark, "v1")
    counts = sinks.write_tables(typed, folder)
    shape = lambda name: ", ".join(f"{c} {t}" for c, t in spark.read.parquet(f"{folder}/{name}").dtypes)
    return spark.createDataFrame([(name, counts[name], shape(name)) for name in V1_SPECS], "table_name string, row_count long, columns string")


def source_v1_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as one JSONL graph, read with a strict schema and split by the type of the record: edges with the types of their ends."""
    folder = _folder(spark, "graph")
    nodes = graph_queries.case_nodes(spark, sf_dir).select(F.lit("node").alias("record_type"), "node_id", F.col("node_type").alias("entity_type"), "value")
    edges = graph_queries.case_edges(spark, sf_dir).select(
        F.lit("edge").alias("record_type"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), "relation", "source_rel"
    )
    sinks.write_jsonl(nodes, f"{folder}/nodes", "gzip")
    sinks.write_jsonl(edges, f"{folder}/edges", "gzip")
    read = spark.read.option("recursiveFileLookup", True).option("mode", "FAILFAST").schema("record_type string, node_id string, entity_type string, value string, `from` string, `to` string, relation string, source_rel string").json(folder)
    ends = read.filter("record_type = 'node'").select(short_key(F.col("node_id")).alias("from"), "entity_type")
    left, right = ends.toDF("from", "from_type"), ends.toDF("to", "to_type")
    edge = read.filter("record_type = 'edge'").select(short_key(F.col("from")).alias("from"), short_key(F.col("to")).alias("to"), "relation")
    joined = edge.join(left, "from", "left").join(right, "to", "left")
    kind = ["relation", "from_type", "to_type"]
    # rows lie by their object when they are joined, so only subjects are dealt once more
    objects = joined.groupBy(*kind, "to").agg(F.count("*").alias("n")).groupBy(*kind).agg(F.sum("n").alias("edges"), F.count("to").alias("objects"))
    subjects = joined.select(*kind, "from").distinct().groupBy(*kind).agg(F.count("from").alias("subjects"))
    same = reduce(lambda a, b: a & b, (objects[k].eqNullSafe(subjects[k]) for k in kind))
    return objects.join(subjects, same).select(*(objects[k] for k in kind), "edges", "subjects", "objects")


def sink_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as GraphML parts: elements written, and how many name a value."""
    folder = _folder(spark, "graphml")
    sinks.write_graphml_parts(graph_queries.case_nodes(spark, sf_dir), graph_queries.case_edges(spark, sf_dir), folder)
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    element = F.regexp_extract("value", r"^<(node|edge) ", 1)
    return lines.groupBy(element.alias("element")).agg(
        F.count("*").alias("elements"), F.count_if(F.rlike("value", F.lit(r"<data key=\"(value|relation)\">[^<]+</data>"))).alias("named")
    )


def sink_graphml_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as one GraphML file, line by line in its order."""
    path = f"{_folder(spark, 'graphml')}/graph.graphml.gz"
    members = packages.write_graphml(graph_queries.case_nodes(spark, sf_dir), graph_queries.case_edges(spark, sf_dir), path)
    # by the bytes of its members a compressed file is read by many tasks
    return packages.member_lines(spark, path, members).select("line", F.sha2("value", 256).alias("sha256"))


def package_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package is published and verified, then one file is changed, one is added, and the seal is taken away: the gates that fail."""
    target = _folder(spark, "published") + "/package"
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    orphans = gates.gate("ORDER_WITHOUT_CUSTOMER", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"))
    tables = {"customers": c.select("c_custkey", "c_name").coalesce(2), "orders": o.select("o_orderkey", "o_custkey").coalesce(2)}
    counts = packages.publish(spark, tables, [orphans], target)
    store = packages.Store(spark, target)
    rows = [("published", name, n) for name, n in counts.items()]
    rows += [("read", name, df.count()) for name, df in packages.read_package(spark, target).items()]

    def faults(stage: str) -> None:
        rows.extend((stage, r.gate, r.n) for r in packages.package_faults(spark, target).groupBy("gate").agg(F.count("*").alias("n")).collect())

    faults("whole")
    store.write(store.names(f"{target}/tables/orders")[0], iter([b"changed"]), overwrite=True)
    faults("changed")
    store.write(f"{target}/tables/more", iter([b"more"]))
    faults("added")
    store.delete(f"{target}/{packages.SEAL}")
    faults("unsealed")
    return spark.createDataFrame(rows, "stage string, gate string, n long")


def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through JSONL: every text comes back as it was."""
    folder = _folder(spark, "documents")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), folder)
    return files.ledger(spark, folder, "doc_id long, text string, source string", strict=True).select(
        "doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def sink_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of a folder of nations against a list with faults of every kind, by the nation in the path."""
    folder = _folder(spark, "sums")
    n = table(spark, sf_dir, "nation")
    _one_file_each(n.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("o"), F.col("n_name").alias("value")), "n", "o", folder)
    there = sinks.checksum_rows(spark, folder).withColumn("k", F.regexp_extract("rel", r"n=(\d+)/", 1).cast("int"))
    listed = there.filter("k <> 4").select(
        F.when(F.col("k") == 7, F.concat(F.lit("../"), "rel")).when(F.col("k") == 9, F.concat("rel", F.lit(".gone"))).otherwise(F.col("rel")).alias("rel"),
        F.when(F.col("k") % 5 == 1, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), "k"
    )
    twice = listed.unionByName(listed.filter("k = 2")).drop("k")
    return sinks.checksum_faults(twice, there.drop("k")).select(F.regexp_extract("rel", r"n=(\d+)/", 1).cast("int").alias("n"), "fault")


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a corpus by kind: mails, documents with recognised pages, payloads by allow-list with their duplicates, customs candidates that stay unverified."""
    from quarrystone.plans.capture_queries import allowed_payloads

    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    record = lambda df, kind, ident, size, status: df.select(F.lit(kind).alias("kind"), ident.cast("string").alias("record"), size.cast("long").alias("bytes"), status.alias("status"))
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    read = d.join(p, "doc_id", "left")
    found = [
        record(table(spark, sf_dir, "conversations"), "mail", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), size("text"), F.lit("observed")),
        record(read, "document", F.col("doc_id"), size("text") + size("html"), F.when(F.col("html").isNull(), "native_text").otherwise("with_pages")),
        record(allowed_payloads(spark, sf_dir), "payload", F.col("sha256"), F.col("duplicates"), F.lit("observed")),
        record(table(spark, sf_dir, "supplier"), "customs", F.col("s_suppkey"), F.length("s_name"), F.lit("customs_candidate_unverified")),
    ]
    return reduce(DataFrame.unionByName, found)


def _finished(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _stream(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, str]:
    """Events as an append-only JSONL ledger, read as a stream of a few files at a time."""
    folder = _folder(spark, label)
    e = table(spark, sf_dir, "events")
    sinks.write_jsonl(
        e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type").repartition(6), f"{folder}/in"
    )
    return paths.ledger_stream(spark, f"{folder}/in", "event_id long, ts timestamp_ntz, user_id long, event_type string", files_per_batch=2), folder


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their first row of the ledger, whatever batch it came in."""
    stream, folder = _stream(spark, sf_dir, "first-seen")
    rows = paths.first_seen(stream.select("user_id"), "user_id")
    _finished(rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.schema("user_id long").parquet(f"{folder}/out")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user over all batches; of one instant, the highest id."""
    stream, folder = _stream(spark, sf_dir, "latest")
    latest = paths.latest_by_key(
        stream.withColumn("at", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "at"), "user_id", "at"
    ).drop("at")
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out")
    _finished(latest.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of business time over all batches.  A watermark longer than the data keeps every row, whenever it came."""
    stream, folder = _stream(spark, sf_dir, "windows")
    windows = paths.business_windows(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", late="3650 days")
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out")
    _finished(windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").select(
        F.unix_micros("window_start").alias("window_start"), "events", F.unix_micros("first_event").alias("first_event"),
        F.unix_micros("last_event").alias("last_event")
    )


def stream_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as observed repair entries that come in several batches: the last snapshot of the queue."""
    folder = _folder(spark, "repairs")
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("severity"), F.max("quality").alias("quality"))  # noqa: E741
    rows = l.select(
        F.col("doc_id").alias("entry"), "severity", (F.col("doc_id") % 100).alias("recorded"), (F.col("doc_id") % 4).alias("attempts"),
        F.when(F.col("quality") == 1, F.col("doc_id") % 130).alias("resolved_at")
    )
    sinks.write_jsonl(rows.repartition(4), f"{folder}/in")
    stream = paths.ledger_stream(spark, f"{folder}/in", "entry long, severity int, recorded long, attempts long, resolved_at long", files_per_batch=2)
    query = paths.repair_queue(stream, f"{folder}/queue", f"{folder}/state")
    _finished(query)
    return spark.read.parquet(f"{folder}/queue/version={query.lastProgress.batchId if query.lastProgress else 0}").select("entry", "severity", "attempts", "status")


def stream_repair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair queue as keyed state: half of the ledger, a restart, and the other half, in several batches each."""
    folder = _folder(spark, "repair-states")
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("severity"), F.max("quality").alias("quality"))  # noqa: E741
    twice = l.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = twice.select(
        F.col("doc_id").alias("entry"), (F.col("severity") - F.col("again")).alias("severity"), (F.col("doc_id") % 100 + 40 * F.col("again")).alias("recorded"),
        (F.col("doc_id") % 4 + F.col("again")).alias("attempts"), F.when(F.col("quality") == 1, F.col("doc_id") % 130).alias("resolved_at"), "again"
    ).select("entry", F.greatest("severity", F.lit(0)).alias("severity"), "recorded", "attempts", "resolved_at", "again")
    for again in (0, 1):  # the second part comes after the query was stopped and started anew
        sinks.write_jsonl(rows.filter(F.col("again") == again).drop("again").repartition(4), f"{folder}/in/part={again}")
        stream = paths.ledger_stream(spark, f"{folder}/in", "entry long, severity int, recorded long, attempts long, resolved_at long", files_per_batch=2)
        _finished(state.append_updates(state.repair_states(stream, timed=False), f"{folder}/updates", f"{folder}/state"))
    return state.present(spark, f"{folder}/updates").select("entry", "severity", "attempts", "first_recorded", "last_recorded", "status")


def stream_repair_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers of open entries: what is not heard of for an hour of business time is due, and given up when it has had its attempts."""
    folder = _folder(spark, "repair-timers")
    n = table(spark, sf_dir, "customer").select("c_custkey")
    hour = 3_600_000
    first = n.select(
        F.col("c_custkey").alias("entry"), F.lit(1).alias("severity"), (F.col("c_custkey") % 50 + hour).cast("long").alias("recorded"), (F.col("c_custkey") % 6).alias("attempts"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(3 * hour).cast("long")).alias("resolved_at")
    )
    news = n.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entry"), F.lit(1).alias("severity"), F.lit(2 * hour).cast("long").alias("recorded"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("long").alias("resolved_at"))
    clock = spark.range(1).select((-F.lit(1)).cast("long").alias("entry"), F.lit(0).alias("severity"), F.lit(2 * hour + hour // 2).cast("long").alias("recorded"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("long").alias("resolved_at"))
    for k, part in enumerate((first, news, clock)):  # parts follow each other, each in as many files as one batch takes; the last one only moves the clock
        sinks.write_jsonl(part.coalesce(paths.FILES_PER_BATCH), f"{folder}/in/part={k}")
        stream = paths.ledger_stream(spark, f"{folder}/in", "entry long, severity int, recorded long, attempts long, resolved_at long")
        _finished(state.append_updates(state.repair_states(stream), f"{folder}/updates", f"{folder}/state"))
    return state.present(spark, f"{folder}/updates").filter("entry >= 0").select("entry", "attempts", "status")


def url_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest capture of each canonical url, with its fragment and parameters put in order."""
    p = table(spark, sf_dir, "pages").select(urls.canonical(F.col("url")).alias("canonical"), "page_id", F.sha2("html", 256).alias("sha256"))
    return p.groupBy("canonical").agg(F.max_by("sha256", "page_id").alias("sha256"), F.count("*").alias("captures"))


QUERIES = {f.__name__: f for f in (
    source_jsonl, source_ledger, source_json, source_csv, source_sqlite, source_archive, source_archive_budget, source_archive_files, source_inventory, source_v1_graph, sink_tables, sink_v1_tables, sink_graphml, sink_graphml_file, package_published, sink_jsonl, sink_checksums, corpus_records,
    stream_first_seen, stream_latest, stream_windows, stream_repairs, stream_repair_states, stream_repair_timers, url_map,
)}

_LINES = """l AS (SELECT event_id, event_id // 1000 AS page, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line, event_id % 50 AS n, coalesce(props, '{}') AS props FROM events)"""
_E = graph_queries.EDGES_SQL
_V1_ROWS = {
    "nodes": "SELECT count(*) FROM nodes", "relation_occurrence": "SELECT count(*) FROM edges", "relation_fact": "SELECT count(*) FROM facts", "files": "SELECT count(*) FROM artifacts",
    "tasks": "SELECT count(*) FROM documents", "coverage": "SELECT count(DISTINCT source_scope) FROM artifacts", "lineage": "SELECT count(*) FROM lineage", "text_documents": "SELECT count(*) FROM derived_artifacts",
}
_PACKAGE = package_queries.PACKAGE_SQL

_XML = "replace(replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_ARCHIVE_MEMBERS = f"""a AS (SELECT page_id // 20 AS n, page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY page_id // 20) AS members FROM pages),
f AS (SELECT n, k, CASE WHEN page_id % 17 = 0 THEN '../' ELSE 'pages/' END || lpad(page_id::varchar, 9, '0') || '.html' AS member_path, strlen(html) AS size, sha256(html) AS sha,
    CASE WHEN page_id % 17 = 0 THEN 'ARCHIVE_MEMBER_UNSAFE_PATH' WHEN n % {_DAMAGED} = 3 AND n % {_BOMB} <> 4 AND k = members - 1 THEN 'ARCHIVE_MEMBER_DAMAGED' END AS error FROM a
  UNION ALL SELECT DISTINCT n, members, 'pages/bomb', 3221225472, NULL, 'ARCHIVE_MEMBER_TOO_LARGE' FROM a WHERE n % {_BOMB} = 4),
m AS (SELECT 'archive-' || lpad(n::varchar, 9, '0') || '.zip' AS path, k::int AS member_index, member_path, size, sha, error FROM f WHERE n % {_CUT} <> 2)"""
_ARCHIVE_SQL = f"""WITH {_ARCHIVE_MEMBERS} SELECT path, member_index, member_path, size AS uncompressed_bytes, CASE WHEN error IS NULL THEN sha END AS sha256, error FROM m
UNION ALL SELECT DISTINCT 'archive-' || lpad(n::varchar, 9, '0') || '.zip', NULL, NULL, NULL, NULL, 'ARCHIVE_DAMAGED' FROM f WHERE n % {_CUT} = 2"""

ORACLES = {
    "source_jsonl": f"""WITH {_LINES} SELECT page, line, CASE n WHEN 13 THEN '{{broken' WHEN 21 THEN '42' ELSE props END AS json, CASE n WHEN 13 THEN 'invalid_jsonl_line' WHEN 21 THEN 'parsed_json_scalar' ELSE 'parsed' END AS status FROM l WHERE n <> 7""",
    "source_ledger": f"""WITH {_LINES} SELECT (props->>'$.k')::bigint AS k, count(*) AS lines FROM l WHERE n NOT IN (7, 13, 21) AND props->>'$.k' IS NOT NULL GROUP BY 1""",
    "source_json": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 3",
    "source_csv": """SELECT p_partkey, p_name || ' "x", ' || p_brand || chr(10) || '2' AS p_name, p_size FROM part""",
    "source_sqlite": "SELECT n_nationkey::bigint AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "source_archive": _ARCHIVE_SQL,
    "source_archive_budget": f"""WITH {_ARCHIVE_MEMBERS}, b AS (SELECT *, sum(size) OVER (ORDER BY path, lower(member_path), member_index) AS used FROM m WHERE size < 3000000000)
SELECT path, member_index, CASE WHEN error IS NULL AND used <= 400000 THEN sha END AS sha256,
  CASE WHEN error = 'ARCHIVE_MEMBER_UNSAFE_PATH' THEN error WHEN used > 400000 THEN 'ARCHIVE_BUDGET_BYTES' ELSE error END AS error FROM b""",
    "source_archive_files": _ARCHIVE_SQL,
    "source_inventory": """SELECT n_nationkey AS n, strlen(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256, 'text' AS magic, 'text' AS category, 'text/plain' AS mime FROM nation
UNION ALL SELECT r_regionkey, strlen(r_name) + 14, sha256('{"r_name":"' || r_name || '"}' || chr(10)), 'text', 'text', 'text/plain' FROM region""",
    "source_v1_graph": f"""WITH {_E}, {graph_queries.NODES_SQL} SELECT relation, s.node_type AS from_type, o.node_type AS to_type, count(*) AS edges, count(DISTINCT from_id) AS subjects, count(DISTINCT to_id) AS objects
FROM edges LEFT JOIN nodes s ON s.node_id = from_id LEFT JOIN nodes o ON o.node_id = to_id GROUP BY ALL""",
    "sink_tables": f"WITH {_PACKAGE} " + " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in package_queries.TABLES),
    "sink_v1_tables": f"WITH {_PACKAGE.replace('nodes AS (', 'package_nodes AS (')}, {_E}, {graph_queries.FACTS_SQL}, {graph_queries.NODES_SQL} "
    + " UNION ALL ".join(f"SELECT '{name}' AS table_name, ({sql}) AS row_count, '{V1_SPECS[name]}' AS columns" for name, sql in _V1_ROWS.items()),
    "sink_graphml": f"WITH {_E}, {graph_queries.NODES_SQL} SELECT 'node' AS element, count(*) AS elements, count(*) AS named FROM nodes UNION ALL SELECT 'edge', count(*), count(*) FROM edges",
    "sink_graphml_file": f"""WITH {_E}, {graph_queries.NODES_SQL},
e AS (SELECT 1 AS part, row_number() OVER (ORDER BY node_id) AS k, '<node id="' || {_XML.format('node_id')} || '"><data key="type">' || {_XML.format('node_type')} || '</data><data key="value">' || {_XML.format('value')} || '</data></node>' AS value FROM nodes
  UNION ALL SELECT 2, row_number() OVER (ORDER BY from_id, relation, to_id), '<edge source="' || {_XML.format('from_id')} || '" target="' || {_XML.format('to_id')} || '"><data key="relation">' || {_XML.format('relation')} || '</data></edge>' FROM edges
  UNION ALL SELECT 0, k, x FROM (SELECT unnest({sinks.GRAPHML_HEAD.splitlines()!r}) AS x, unnest(range({len(sinks.GRAPHML_HEAD.splitlines())})) AS k)
  UNION ALL SELECT 3, k, x FROM (SELECT unnest({sinks.GRAPHML_FOOT.splitlines()!r}) AS x, unnest(range({len(sinks.GRAPHML_FOOT.splitlines())})) AS k))
SELECT row_number() OVER (ORDER BY part, k) AS line, sha256(value) AS sha256 FROM e""",
    "package_published": """SELECT stage, gate, n FROM (VALUES ('published'), ('read')) s(stage), (SELECT 'customers' AS gate, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)
UNION ALL SELECT * FROM (VALUES ('changed', 'CHECKSUM_MISMATCH', 1), ('added', 'CHECKSUM_MISMATCH', 1), ('added', 'CHECKSUM_COVERAGE', 1), ('unsealed', 'SEAL_MISSING', 1)) v(stage, gate, n)""",
    "sink_jsonl": "SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "sink_checksums": """WITH n AS (SELECT n_nationkey AS n FROM nation)
SELECT n, CASE n WHEN 4 THEN 'CHECKSUM_COVERAGE' WHEN 7 THEN 'CHECKSUM_PATH_ESCAPES' WHEN 9 THEN 'CHECKSUM_MISSING' WHEN 2 THEN 'CHECKSUM_DUPLICATE' ELSE 'CHECKSUM_MISMATCH' END AS fault FROM n WHERE n IN (2, 4, 7, 9) OR n % 5 = 1
UNION ALL SELECT n, 'CHECKSUM_COVERAGE' FROM n WHERE n IN (7, 9)""",
    "corpus_records": """WITH f AS (SELECT sha256(props) AS sha, count(*) - 1 AS n FROM events WHERE event_type IN ('click', 'view', 'purchase', 'login') AND user_id % 10 IN (1, 2, 3, 5, 8) GROUP BY 1)
SELECT 'mail' AS kind, conv_id || '/' || turn AS record, strlen(coalesce(text, '')) AS bytes, 'observed' AS status FROM conversations
UNION ALL SELECT 'document', doc_id::varchar, strlen(coalesce(text, '')) + strlen(coalesce(html, '')), CASE WHEN page_id IS NULL THEN 'native_text' ELSE 'with_pages' END FROM documents LEFT JOIN pages ON page_id = doc_id
UNION ALL SELECT 'payload', sha, n, 'observed' FROM f UNION ALL SELECT 'customs', s_suppkey::varchar, length(s_name), 'customs_candidate_unverified' FROM supplier""",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "stream_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "stream_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS events, min(epoch_us(ts)) AS first_event, max(epoch_us(ts)) AS last_event FROM events GROUP BY 1",
    "stream_repairs": """SELECT doc_id AS entry, max(toxic)::int AS severity, doc_id % 4 AS attempts, CASE WHEN max(quality) = 1 AND doc_id % 130 >= doc_id % 100 THEN 'resolved' ELSE 'open' END AS status FROM labels GROUP BY doc_id""",
    "stream_repair_states": """SELECT doc_id AS entry, max(toxic)::int AS severity, doc_id % 4 + 1 AS attempts, doc_id % 100 AS first_recorded, doc_id % 100 + 40 AS last_recorded,
  CASE WHEN max(quality) = 1 AND doc_id % 130 >= doc_id % 100 + 40 THEN 'resolved' ELSE 'open' END AS status FROM labels GROUP BY doc_id""",
    "stream_repair_timers": """SELECT c_custkey AS entry, c_custkey % 6 + (c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 6 < 5)::int AS attempts,
  CASE WHEN c_custkey % 4 = 0 THEN 'resolved' WHEN c_custkey % 3 = 0 THEN 'open' WHEN c_custkey % 6 = 5 THEN 'given_up' ELSE 'due' END AS status FROM customer""",
    "url_map": """WITH q AS (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS base, list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '')) AS pairs FROM pages)
SELECT CASE WHEN len(pairs) > 0 THEN base || '?' || array_to_string(pairs, '&') ELSE base END AS canonical, sha256(arg_max(html, page_id)) AS sha256, count(*) AS captures FROM q GROUP BY 1""",
}
