"""Sessions, manifests of mails, announced counts, and tasks that an interruption left behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import content, gates, tree_hash
from quarrystone.plans.tables import table
from quarrystone.sources import files


def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status files of their user's sessions: the newest of each case by day, of equals the one whose path sorts last."""
    statuses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.format_string("session-%09d/status.json", "event_id").alias("path"), F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("modified"), "event_type"
    )
    return files.newest_sessions(statuses)


def manifest_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as manifests: turns are mails, the words of a turn are its related resources."""
    c = table(spark, sf_dir, "conversations")
    mail = F.struct("turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("mail_id"), F.split(F.coalesce("text", F.lit("")), " ").alias("related_resources"))
    manifests = c.groupBy(F.col("conv_id").alias("manifest_id")).agg(F.sort_array(F.collect_list(mail)).alias("mails"))
    return files.manifest_occurrences(manifests)


def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced counts of tables against what they hold: two that hold and two that do not."""
    names = {"nation": 25, "region": 6, "supplier": 0, "clean": 0}
    tables = {name: table(spark, sf_dir, name) for name in ("nation", "region", "supplier")}
    orphans = table(spark, sf_dir, "nation").join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")
    return gates.expected_counts(names, tables | {"clean": orphans})


def recovered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks of a run that broke off: what was running is pending again, with a code."""
    d = table(spark, sf_dir, "documents")
    states = F.array(*(F.lit(s) for s in ("pending", "running", "completed", "failed", "running")))
    tasks = d.select("doc_id", F.get(states, (F.length(F.coalesce("text", F.lit(""))) % 5).cast("int")).alias("state"), F.when(F.col("doc_id") % 6 == 0, "READER_FAILED").alias("error_code"))
    return content.recovered(tasks)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders of their language and source."""
    rel = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", rel.alias("rel"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def _folders(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'folder'").select(F.concat_ws("/", F.when(F.col("parent") != "", F.col("parent")), "name").alias("folder"), "digest")


def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all folders of documents, and of the root."""
    return _folders(tree_hash.folded(spark, tree_hash.files_of(_tree(spark, sf_dir))))


def tree_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tree after some files were changed: the folders that were hashed again."""
    listing = _tree(spark, sf_dir)
    path = tree_hash.stored(tree_hash.folded(spark, tree_hash.files_of(listing)), f"tree-{uuid.uuid4().hex}")
    changed = listing.filter("doc_id % 97 = 5").withColumn("sha256", F.sha2(F.concat("sha256", F.lit("!")), 256))
    return _folders(tree_hash.brought_up_to_date(spark, path, tree_hash.files_of(changed))[0])


QUERIES = {f.__name__: f for f in (newest_sessions, manifest_occurrences, expected_counts, recovered_tasks, tree_digests, tree_after_changes)}

def _level(rows: str) -> str:
    """The digests of the folders (parent) of nodes (parent, name, kind, digest)."""
    return f"""(SELECT parent, sha256(string_agg(bin || chr(0) || d, chr(10) ORDER BY bin || chr(0) || d)) AS digest FROM (
  SELECT parent, substr(sha256(name), 1, 2) AS bin, sha256(string_agg(name || chr(0) || kind || chr(0) || digest, chr(10) ORDER BY name || chr(0) || kind || chr(0) || digest)) AS d FROM {rows} GROUP BY ALL) GROUP BY ALL)"""


def _tree_sql(digest: str) -> str:
    return f"""WITH f AS (SELECT doc_id, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s, {digest} AS digest FROM documents),
a AS (SELECT l || '/' || s AS parent, doc_id || '.txt' AS name, 'file' AS kind, digest FROM f), x AS {_level("a")},
b AS (SELECT split_part(parent, '/', 1) AS parent, split_part(parent, '/', 2) AS name, 'folder' AS kind, digest FROM x), y AS {_level("b")},
c AS (SELECT '' AS parent, parent AS name, 'folder' AS kind, digest FROM y), z AS {_level("c")},
every AS (SELECT parent AS folder, digest FROM x UNION ALL FROM y UNION ALL FROM z)"""


_SHA = "sha256(coalesce(text, ''))"

ORACLES = {
    "tree_digests": f"{_tree_sql(_SHA)} SELECT folder, digest FROM every",
    "tree_after_changes": f"""{_tree_sql(f"CASE WHEN doc_id % 97 = 5 THEN sha256({_SHA} || '!') ELSE {_SHA} END")}
SELECT folder, digest FROM every WHERE folder IN (SELECT unnest([l || '/' || s, l, '']) FROM f WHERE doc_id % 97 = 5)""",
    "newest_sessions": """WITH s AS (SELECT user_id AS case_id, printf('session-%09d/status.json', event_id) AS path, epoch_us(date_trunc('day', ts)) AS modified, event_type FROM events)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY modified DESC, path DESC) = 1""",
    "manifest_occurrences": """WITH m AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations),
r AS (SELECT conv_id, turn, m, unnest(w) AS resource, unnest(range(1, len(w) + 1)) AS r FROM m)
SELECT conv_id AS manifest_id, conv_id || '/' || turn AS mail_id, m::int AS mail_ordinal, r::int AS resource_ordinal, '/mails/' || m - 1 || '/related_resources/' || r - 1 AS source_pointer, resource FROM r""",
    "expected_counts": """WITH c AS (SELECT 'nation' AS gate_id, count(*) AS n, 25 AS e FROM nation UNION ALL SELECT 'region', count(*), 6 FROM region UNION ALL SELECT 'supplier', count(*), 0 FROM supplier UNION ALL SELECT 'clean', 0, 0)
SELECT gate_id, abs(n - e)::bigint AS violations, CASE WHEN n = e THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
    "recovered_tasks": """WITH t AS (SELECT doc_id, ['pending', 'running', 'completed', 'failed', 'running'][length(coalesce(text, '')) % 5 + 1] AS s, CASE WHEN doc_id % 6 = 0 THEN 'READER_FAILED' END AS e FROM documents)
SELECT doc_id, CASE WHEN s = 'running' THEN 'pending' ELSE s END AS state, CASE WHEN s = 'running' THEN 'INTERRUPTED' ELSE e END AS error_code FROM t""",
}
