"""Content objects (what the bytes are) and occurrences (where they appear), tasks over them and their upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.classify import rules
from quarrystone.functions.keys import stable_key

TERMINAL = ("completed", "source_gap")
#: Extraction tasks of a kind of content.
TASKS_BY_CATEGORY = {
    "text": ("extract_text",), "office": ("extract_office_xml",), "legacy-office": ("extract_legacy_office",), "archive": ("inspect_archive",),
    "eps": ("extract_eps_text", "ocr_eps_rendered"), "image": ("ocr_image",), "audio": ("ffprobe_media", "asr_dual_diarization"),
    "video": ("ffprobe_media", "asr_dual_diarization", "video_frame_ocr"), "media": ("ffprobe_media", "asr_dual_diarization", "video_frame_ocr"),
}


def content_objects(files: DataFrame) -> DataFrame:
    """One row for each distinct content of files (rel, sha256, bytes): the path that sorts first stands for it."""
    return files.groupBy("sha256").agg(
        F.min("bytes").alias("bytes"), F.min_by("rel", F.struct(F.lower("rel"), "rel")).alias("representative_rel"), F.count("*").alias("occurrences"),
        (F.countDistinct("bytes") > 1).alias("size_conflict")
    )


def occurrences(files: DataFrame, scope: str) -> DataFrame:
    """Every appearance of a content, never merged, by a key of where it is."""
    return files.select(
        stable_key(F.lit(scope), F.col("rel"), F.col("sha256")).alias("occurrence_id"), F.lit(scope).alias("source_scope"), F.col("rel").alias("source_rel"),
        F.col("sha256").alias("content_sha256")
    )


def planned_tasks(objects: DataFrame) -> DataFrame:
    """Tasks of content objects (sha256, category, magic): by content, not by file."""
    named = lambda kinds: F.array(*(F.lit(k) for k in kinds))
    kinds = rules(
        (F.col("magic") == "bad-zip", named(("inspect_archive",))),
        (F.col("category") == "text", named(TASKS_BY_CATEGORY["text"])),
        (F.col("magic") == "pdf", named(("extract_pdf_native", "ocr_pdf_all_pages"))),
        *((F.col("category") == c, named(k)) for c, k in TASKS_BY_CATEGORY.items() if c != "text"),
        otherwise=named(("classify_binary",)),
    )
    tasks = objects.select("sha256", F.explode(kinds).alias("task_kind"))
    return tasks.withColumn("task_id", stable_key(F.lit("v2"), F.col("sha256"), F.col("task_kind")))


def task_pivot(tasks: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each content, a column with the state of each kind of task."""
    return tasks.groupBy("sha256").pivot("task_kind", kinds).agg(F.min("state"))


def coverage(*parts: tuple[str, DataFrame, str | Column, Column | None, Column | None]) -> DataFrame:
    """scope, name, total, completed, bytes of each (scope, rows, name column, completed condition, bytes column)."""
    rows = []
    for scope, df, name, done, size in parts:
        name = F.col(name) if isinstance(name, str) else name
        rows.append(
            df.groupBy(name.cast("string").alias("name"))
            .agg(F.count("*").alias("total"), F.count_if(done if done is not None else F.lit(True)).alias("completed"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).cast("long").alias("bytes"))
            .select(F.lit(scope).alias("scope"), "name", "total", "completed", "bytes")
        )
    return reduce(DataFrame.unionByName, rows)


def synced(old: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """A new snapshot: rows of new are active, rows only in old stay with active 0; change tells what happened."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    here, there = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    same = reduce(Column.__and__, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in payload])
    change = F.when(~there, "added").when(~here, "deactivated").when(same, "unchanged").otherwise("updated")
    values = [F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload]
    return both.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *values, here.cast("int").alias("active"), change.alias("change"))


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks that were running when the run broke off are pending again, with a code."""
    broken = F.col("state") == "running"
    return tasks.withColumn("error_code", F.when(broken, "INTERRUPTED").otherwise(F.col("error_code"))).withColumn("state", F.when(broken, "pending").otherwise(F.col("state")))


def best_prior(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def last_writes(ledger: DataFrame, key: str, position: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows that stand, and those that a later row of the same key superseded."""
    w = Window.partitionBy(key).orderBy(F.col(position).desc())
    ranked = ledger.withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_rank"), ranked.filter("_rank > 1").drop("_rank")


def run_status(open_tasks: Column, gaps: Column) -> Column:
    """A gap at the source is terminal but is no success."""
    return F.when(open_tasks > 0, "INCOMPLETE").when(gaps > 0, "INCOMPLETE_SOURCE_GAPS").otherwise("PASS")


def active_rows(rows: DataFrame) -> DataFrame:
    """Rows that are active; tables without that column have no others."""
    return rows.filter("active = 1") if "active" in rows.columns else rows


def reused_tasks(planned: DataFrame, prior: DataFrame, outputs: DataFrame) -> DataFrame:
    """Planned tasks (sha256, task_kind) with the prior result they take over: of results (sha256, task_kind, state, updated_at,
    output_rel, result_sha256) the completed and latest first whose output (output_rel, sha256) is there and is what it was."""
    there = outputs.select("output_rel", F.col("sha256").alias("_found"))
    sound = prior.filter(F.col("state").isin(*TERMINAL)).join(there, "output_rel").filter("_found = result_sha256")
    best = best_prior(sound, ["sha256", "task_kind"], [(F.col("state") == "completed").desc(), F.col("updated_at").desc(), F.col("output_rel")])
    taken = best.select("sha256", "task_kind", F.col("state").alias("_state"), "output_rel")
    return planned.join(taken, ["sha256", "task_kind"], "left").withColumn("state", F.coalesce("_state", F.lit("pending"))).drop("_state")
