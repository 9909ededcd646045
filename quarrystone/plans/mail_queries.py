"""Mail queries: a conversation is a thread, its turns are mails; some parents are made wrong on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import mail
from quarrystone.plans.tables import table


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh thread answers its own last turn from its first, every eleventh turn names itself, every thirteenth a mail
    that is not there, and turns of threads divisible by five have no time."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.min("turn").alias("first_turn"))
    ident = lambda conv, turn: F.concat(F.lpad(conv.cast("string"), 8, "0"), F.lit("-"), F.lpad(turn.cast("string"), 4, "0"))
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.col("conv_id") * 31 + F.col("turn")
    first = turn == F.col("first_turn")
    parent = (
        F.when(first & (conv % 7 == 0), ident(conv, F.col("last_turn")))
        .when(first, F.lit(None))
        .when(n % 11 == 0, ident(conv, turn))
        .when(n % 13 == 0, F.lit("nowhere"))
        .otherwise(ident(conv, turn - 1))
    )
    local = F.when(conv % 5 != 0, F.concat(F.lit("2024-01-01T"), F.lpad(F.when(n % 17 == 0, F.lit(0)).otherwise(turn).cast("string"), 6, "0")))
    return c.join(last, "conv_id").select(
        "conv_id", ident(conv, turn).alias("mail_id"), parent.alias("parent_id"), local.alias("local_key"), turn.alias("ordinal"), "role", "text"
    )


def mail_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.in_order(mails(spark, sf_dir), "conv_id").select("conv_id", "mail_id", F.col("mail_order").cast("long").alias("mail_order"))


def mail_parent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.checked_parents(mails(spark, sf_dir)).select("mail_id", "parent_id", "parent_status", "valid_parent")


def mail_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of threads on a cycle, and whose parent is dropped to break it."""
    checked = mail.checked_parents(mails(spark, sf_dir).drop("text"))
    on = mail.cycle_members(checked, 6).withColumn("on_cycle", F.lit(True))
    broken = mail.without_cycles(checked, "conv_id", 6)
    return broken.join(on, "mail_id", "left").select("mail_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "broken", "valid_parent")


def mail_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_parent_status(spark, sf_dir).groupBy("parent_status").agg(F.count("*").alias("mails"))


def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.participants(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("place").cast("long").alias("place"), "address")


def participant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document-address relations with their evidence."""
    return email_extract(spark, sf_dir).groupBy("doc_id", "address").agg(F.count("*").alias("evidence_count"), F.min("place").alias("first_place"))


def attachment_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are attachments, orders the mails that hold them."""
    links = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("attachment"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("mail_key")
    )
    return mail.numbered_attachments(links)


QUERIES = {f.__name__: f for f in (mail_order, mail_parent_status, mail_cycles, mail_qa, email_extract, participant_edges, attachment_numbering)}

MAILS_SQL = """
c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL),
l AS (SELECT conv_id, max(turn) AS last_turn, min(turn) AS first_turn FROM c GROUP BY ALL),
i AS (SELECT *, conv_id * 31 + turn AS n, lpad(conv_id::varchar, 8, '0') || '-' AS p FROM c JOIN l USING (conv_id)),
mails AS (SELECT conv_id, p || lpad(turn::varchar, 4, '0') AS mail_id,
  CASE WHEN turn = first_turn AND conv_id % 7 = 0 THEN p || lpad(last_turn::varchar, 4, '0') WHEN turn = first_turn THEN NULL WHEN n % 11 = 0 THEN p || lpad(turn::varchar, 4, '0')
       WHEN n % 13 = 0 THEN 'nowhere' ELSE p || lpad((turn - 1)::varchar, 4, '0') END AS parent_id,
  CASE WHEN conv_id % 5 <> 0 THEN '2024-01-01T' || lpad(CASE WHEN n % 17 = 0 THEN 0 ELSE turn END::varchar, 6, '0') END AS local_key, turn AS ordinal FROM i),
checked AS (SELECT m.*, CASE WHEN m.parent_id IS NULL THEN 'none' WHEN m.parent_id = m.mail_id THEN 'self' WHEN p.mail_id IS NULL THEN 'missing' WHEN p.local_key > m.local_key THEN 'later' ELSE 'valid' END AS parent_status
  FROM mails m LEFT JOIN mails p ON m.parent_id = p.mail_id),
valid AS (SELECT *, CASE WHEN parent_status = 'valid' THEN parent_id END AS valid_parent FROM checked)"""
EMAIL_SQL = f"""
e AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{mail.EMAIL}') AS a FROM documents),
found AS (SELECT doc_id, unnest(range(len(a))) AS place, unnest(a) AS address FROM e)"""

ORACLES = {
    "mail_order": f"""WITH {MAILS_SQL} SELECT conv_id, mail_id, row_number() OVER (PARTITION BY conv_id ORDER BY local_key IS NULL, local_key, CASE WHEN local_key IS NULL THEN ordinal END NULLS FIRST, mail_id) AS mail_order FROM mails""",
    "mail_parent_status": f"WITH {MAILS_SQL} SELECT mail_id, parent_id, parent_status, valid_parent FROM valid",
    "mail_cycles": f"""WITH RECURSIVE {MAILS_SQL},
walk AS (SELECT mail_id AS begun, valid_parent AS reached, 1 AS n FROM valid WHERE valid_parent IS NOT NULL
         UNION ALL SELECT begun, v.valid_parent, n + 1 FROM walk JOIN valid v ON v.mail_id = walk.reached WHERE walk.reached <> begun AND v.valid_parent IS NOT NULL AND n < 64),
onc AS (SELECT DISTINCT begun AS mail_id FROM walk WHERE reached = begun),
lastm AS (SELECT conv_id, arg_max(mail_id, (coalesce(local_key, ''), mail_id)) AS last_id FROM valid WHERE mail_id IN (SELECT mail_id FROM onc) GROUP BY ALL)
SELECT mail_id, mail_id IN (SELECT mail_id FROM onc) AS on_cycle, coalesce(mail_id = last_id, false) AS broken, CASE WHEN mail_id = last_id THEN NULL ELSE valid_parent END AS valid_parent
FROM valid LEFT JOIN lastm USING (conv_id)""",
    "mail_qa": f"WITH {MAILS_SQL} SELECT parent_status, count(*) AS mails FROM checked GROUP BY ALL",
    "email_extract": f"WITH {EMAIL_SQL} SELECT * FROM found",
    "participant_edges": f"WITH {EMAIL_SQL} SELECT doc_id, address, count(*) AS evidence_count, min(place) AS first_place FROM found GROUP BY ALL",
    "attachment_numbering": """
WITH f AS (SELECT l_partkey AS attachment, min(lpad(l_orderkey::varchar, 12, '0')) AS first_mail, count(*) AS links FROM lineitem GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY first_mail, attachment)::varchar AS k FROM f)
SELECT 'ATT-' || CASE WHEN length(k) < 4 THEN lpad(k, 4, '0') ELSE k END AS attachment_no, attachment, first_mail, links FROM n""",
}
