"""Queries of captured requests, responses and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import responses
from quarrystone.plans.tables import table

_CONTRACTS = [("GET", "/api/mail"), ("post", "/api/order/list")]


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in five encodings, read again by the first that fits."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, r"[^\x20-\x7E]", "")
    odd = F.when(F.length(plain) % 2 == 0, F.concat(plain, F.lit("x"))).otherwise(plain)
    k, raw = F.col("doc_id") % 5, lambda c: c.cast("binary")
    content = (
        F.when(k == 0, raw(text)).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw(text))).when(k == 2, F.encode(text, "UTF-16"))
        .when(k == 3, F.concat(F.unhex(F.lit("BCDB")), raw(odd))).otherwise(F.concat(F.unhex(F.lit("E920")), raw(odd)))
    )
    found = table(spark, sf_dir, "documents").select("doc_id", responses.decoded(content).alias("d"))
    return found.select("doc_id", "d.encoding", F.sha2("d.text", 256).alias("text_sha256"))


def request_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests to three hosts under two contracts."""
    k = F.col("page_id") % 6
    url = F.when(k == 0, "https://app.example.com/api/mail?id=1").when(k == 1, "HTTPS://APP.example.com/api/order/list").when(k == 2, "https://app.example.com/api/mail/x").when(k == 3, "https://app.example.com").otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 < 2, "get").otherwise("POST").alias("method"), url.alias("url"))
    return rows.select("page_id", responses.body_role(F.col("method"), F.col("url"), "https://app.example.com", _CONTRACTS).alias("role"))


def mail_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as responses for mails, with faults of every kind."""
    c = table(spark, sf_dir, "conversations")
    mail, k = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), (F.col("conv_id") * 7 + F.col("turn")) % 12
    item = lambda i: F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.struct(i.alias("mailId"), F.col("text")).alias("item")).alias("data")))
    body = (
        F.when(k == 2, "not json").when(k == 3, "[1]").when(k == 4, '{"code": 1219}').when(k == 5, '{"code": "x", "data": {}}').when(k == 6, '{"code": 0}').when(k == 7, '{"code": 0, "data": 5}')
        .when(k == 8, '{"code": 0, "data": {"rows": []}}').when(k == 9, item(F.lit("other"))).otherwise(item(mail))
    )
    rows = c.select(
        "conv_id", "turn", mail.alias("mail"), F.when(k == 0, 404).otherwise(200).alias("status"), F.when(k == 1, "reset").alias("error"), body.alias("body"),
        F.when(F.col("turn") % 2 == 0, "detail").otherwise("track").alias("kind")
    )
    return rows.select("conv_id", "turn", responses.mail_response(F.col("status"), F.col("error"), F.col("body"), F.col("mail"), F.col("kind")).alias("reason"))


QUERIES = {f.__name__: f for f in (decoded_texts, request_roles, mail_responses)}

ORACLES = {
    "decoded_texts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^\x20-\x7E]', '', 'g') AS p FROM documents), o AS (SELECT *, CASE WHEN length(p) % 2 = 0 THEN p || 'x' ELSE p END AS odd FROM d)
SELECT doc_id, ['utf-8-sig', 'utf-8-sig', 'utf-16', 'gb18030', 'latin-1'][doc_id % 5 + 1] AS encoding, sha256(CASE doc_id % 5 WHEN 3 THEN '价' || odd WHEN 4 THEN 'é ' || odd ELSE t END) AS text_sha256 FROM o""",
    "request_roles": """SELECT page_id, CASE WHEN page_id % 6 > 3 THEN 'external_service' WHEN page_id % 6 = 0 AND page_id % 4 < 2 OR page_id % 6 = 1 AND page_id % 4 > 1 THEN 'contract_business' ELSE 'same_origin_other' END AS role FROM pages""",
    "mail_responses": """WITH r AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 12 AS k, turn % 2 = 0 AS detail FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'http_404' WHEN 1 THEN 'transport_error' WHEN 2 THEN 'invalid_json_object' WHEN 3 THEN 'invalid_json_object' WHEN 4 THEN CASE WHEN detail THEN 'source_deleted' ELSE 'application_code_not_zero' END
  WHEN 5 THEN 'application_code_not_zero' WHEN 6 THEN 'missing_data' WHEN 7 THEN 'invalid_data_shape' WHEN 8 THEN CASE WHEN detail THEN 'mail_id_missing' ELSE 'ok' END WHEN 9 THEN 'mail_id_mismatch' ELSE 'ok' END AS reason FROM r""",
}
