"""Content queries: documents are files, labels are the states of their tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import content
from quarrystone.operators.snapshot_store import SnapshotStore
from quarrystone.plans.tables import table
from quarrystone.sources.scratch import scratch_folder

KINDS = ["extract_text", "ocr_image", "extract_office_xml", "classify_binary"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    category = F.when(F.col("lang") == "en", "text").when(F.col("lang") == "de", "image").when(F.col("lang") == "fr", "office").otherwise("other")
    return d.select(
        "doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), F.sha2(text, 256).alias("sha256"),
        F.octet_length(text).cast("long").alias("bytes"), category.alias("category"), F.lit("text").alias("magic"), "source"
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = files(spark, sf_dir).groupBy("sha256").agg(F.min("category").alias("category"), F.min("magic").alias("magic"), F.min("doc_id").alias("doc_id"))
    planned = content.planned_tasks(objects).join(objects.select("sha256", "doc_id"), "sha256")
    states = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    state = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "source_gap").when(F.col("quality") == 1, "completed").otherwise("failed")
    return planned.join(states, "doc_id", "left").select("task_id", "sha256", "task_kind", state.alias("state"))


def content_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_objects(files(spark, sf_dir))


def content_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.occurrences(files(spark, sf_dir), "session")


def task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir)


def task_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.task_pivot(tasks(spark, sf_dir), KINDS)


def task_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).groupBy("task_kind", "state").agg(F.count("*").alias("tasks"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).agg(
        F.count("*").alias("tasks"), F.count_if(~F.col("state").isin(*content.TERMINAL)).alias("open_tasks"),
        F.count_if(F.col("state") == "source_gap").alias("gaps")
    )
    return t.withColumn("status", content.run_status(F.col("open_tasks"), F.col("gaps")))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, t = files(spark, sf_dir), tasks(spark, sf_dir)
    return content.coverage(
        ("files", f, "source", None, F.col("bytes")),
        ("content", content.content_objects(f), F.lit("sha256"), None, F.col("bytes")),
        ("category", f, "category", None, F.col("bytes")),
        ("tasks", t, "task_kind", F.col("state").isin(*content.TERMINAL), None),
    )


def upsert_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old snapshot lacks every fourth document and has other sizes for every third; the new one lacks every fifth."""
    f = files(spark, sf_dir).select("doc_id", "sha256", "bytes")
    old = f.filter("doc_id % 4 <> 0").withColumn("bytes", F.when(F.col("doc_id") % 3 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return content.synced(old, f.filter("doc_id % 5 <> 0"), "doc_id", ["sha256", "bytes"])


def snapshot_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots through a store that writes changed buckets only: its rows after both syncs, and what the second one changed."""
    f = files(spark, sf_dir).select("doc_id", "sha256", "bytes")
    old = f.filter("doc_id % 4 <> 0").withColumn("bytes", F.when(F.col("doc_id") % 3 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    store = SnapshotStore(spark, f"{scratch_folder(spark)}/snapshot-{uuid.uuid4().hex}", "doc_id", "long", {"sha256": "string", "bytes": dict(f.dtypes)["bytes"]}, buckets=16)
    store.sync(old)
    changes = store.sync(f.filter("doc_id % 5 <> 0")).select("doc_id", "change")
    return store.rows().join(changes, "doc_id", "left").withColumn("change", F.coalesce("change", F.lit("unchanged")))


def prior_result_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text, the document whose result is reused: completed before others, then the latest."""
    f = files(spark, sf_dir).select("doc_id", "sha256")
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("done_id")).distinct()
    rows = f.join(done, F.col("doc_id") == F.col("done_id"), "left").withColumn("completed", F.col("done_id").isNotNull())
    return content.best_prior(rows, ["sha256"], [F.col("completed").desc(), F.col("doc_id").desc()]).select("sha256", "doc_id", "completed")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.substring("text", 1, 12).alias("object_key"), F.col("doc_id").alias("position"), "source")


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.last_writes(_ledger(spark, sf_dir), "object_key", "position")[0]


def superseded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.last_writes(_ledger(spark, sf_dir), "object_key", "position")[1]


QUERIES = {
    f.__name__: f
    for f in (content_objects, content_occurrences, task_plan, task_pivot, task_state_counts, run_status, coverage_report, upsert_sync, snapshot_sync, prior_result_choice, last_write_wins, superseded_writes)
}

FILES_SQL = """
files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS rel, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::bigint AS bytes,
  CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'image' WHEN 'fr' THEN 'office' ELSE 'other' END AS category, source FROM documents)"""
TASKS_SQL = f"""{FILES_SQL},
objects AS (SELECT sha256, min(category) AS category, min(doc_id) AS doc_id FROM files GROUP BY ALL),
lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL),
tasks AS (SELECT sha256('v2' || chr(0) || sha256 || chr(0) || task_kind) AS task_id, sha256, task_kind,
  CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'source_gap' WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS state
  FROM (SELECT *, CASE category WHEN 'text' THEN 'extract_text' WHEN 'image' THEN 'ocr_image' WHEN 'office' THEN 'extract_office_xml' ELSE 'classify_binary' END AS task_kind FROM objects) LEFT JOIN lab USING (doc_id))"""

_SYNC_SQL = f"""WITH {FILES_SQL},
o AS (SELECT doc_id, sha256, CASE WHEN doc_id % 3 = 0 THEN bytes + 1 ELSE bytes END AS bytes FROM files WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, sha256, bytes FROM files WHERE doc_id % 5 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.sha256, o.sha256) AS sha256, coalesce(n.bytes, o.bytes) AS bytes, (n.doc_id IS NOT NULL)::int AS active,
  CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deactivated' WHEN o.sha256 = n.sha256 AND o.bytes = n.bytes THEN 'unchanged' ELSE 'updated' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id"""

ORACLES = {
    "content_objects": f"""WITH {FILES_SQL} SELECT sha256, min(bytes) AS bytes, arg_min(rel, (lower(rel), rel)) AS representative_rel, count(*) AS occurrences, count(DISTINCT bytes) > 1 AS size_conflict FROM files GROUP BY sha256""",
    "content_occurrences": f"""WITH {FILES_SQL} SELECT sha256('session' || chr(0) || rel || chr(0) || sha256) AS occurrence_id, 'session' AS source_scope, rel AS source_rel, sha256 AS content_sha256 FROM files""",
    "task_plan": f"WITH {TASKS_SQL} SELECT * FROM tasks",
    "task_pivot": f"WITH {TASKS_SQL} SELECT sha256, {', '.join(f'''min(state) FILTER (WHERE task_kind = '{k}') AS {k}''' for k in KINDS)} FROM tasks GROUP BY sha256",
    "task_state_counts": f"WITH {TASKS_SQL} SELECT task_kind, state, count(*) AS tasks FROM tasks GROUP BY ALL",
    "run_status": f"""WITH {TASKS_SQL}, c AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE state NOT IN ('completed', 'source_gap')) AS open_tasks, count(*) FILTER (WHERE state = 'source_gap') AS gaps FROM tasks)
SELECT *, CASE WHEN open_tasks > 0 THEN 'INCOMPLETE' WHEN gaps > 0 THEN 'INCOMPLETE_SOURCE_GAPS' ELSE 'PASS' END AS status FROM c""",
    "coverage_report": f"""WITH {TASKS_SQL}
SELECT 'files' AS scope, source AS name, count(*) AS total, count(*) AS completed, sum(bytes)::bigint AS bytes FROM files GROUP BY ALL
UNION ALL SELECT 'content', 'sha256', count(*), count(*), sum(bytes)::bigint FROM (SELECT sha256, min(bytes) AS bytes FROM files GROUP BY 1)
UNION ALL SELECT 'category', category, count(*), count(*), sum(bytes)::bigint FROM files GROUP BY ALL
UNION ALL SELECT 'tasks', task_kind, count(*), count(*) FILTER (WHERE state IN ('completed', 'source_gap')), 0::bigint FROM tasks GROUP BY ALL""",
    "upsert_sync": _SYNC_SQL,
    "snapshot_sync": _SYNC_SQL,
    "prior_result_choice": f"""WITH {FILES_SQL}, r AS (SELECT sha256, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS completed FROM files)
SELECT sha256, doc_id, completed FROM r QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY completed DESC, doc_id DESC) = 1""",
    "last_write_wins": "SELECT substr(text, 1, 12) AS object_key, doc_id AS position, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 12) ORDER BY doc_id DESC) = 1",
    "superseded_writes": "SELECT substr(text, 1, 12) AS object_key, doc_id AS position, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 12) ORDER BY doc_id DESC) > 1",
}
