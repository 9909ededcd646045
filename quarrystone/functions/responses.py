"""What a captured request and its response are: whose body it is, whether a mail's response is valid, how a file's bytes read as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.classify import rules

#: Encodings in the order they are tried, and the application code of a mail that its source has deleted.
ENCODINGS, DELETED = ("utf-8-sig", "utf-16", "gb18030", "latin-1"), 1219


def decoded(content: Column) -> Column:
    """struct(text, encoding) of bytes: as text by the first encoding that fits, and which one that was; null bytes stay null."""

    def first(raw: bytes | None) -> tuple[str | None, str | None]:
        for encoding in ENCODINGS if raw is not None else ():
            try:
                return raw.decode(encoding), encoding
            except UnicodeDecodeError:
                continue
        return None, None

    @F.pandas_udf("text string, encoding string")
    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first(x) for x in batch], columns=["text", "encoding"], dtype=object)

    return read(content)


def body_role(method: Column, url: Column, origin: str, contracts: list[tuple[str, str]]) -> Column:
    """Of the body of a request: business under a contract (method, path), another one to the same origin, or one to somebody else."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    agreed = F.concat_ws(" ", F.upper(method), F.when(path == "", "/").otherwise(path)).isin(*(f"{m.upper()} {p}" for m, p in contracts))
    return rules((~F.coalesce(found == origin.lower(), F.lit(False)), "external_service"), (agreed, "contract_business"), otherwise="same_origin_other")


def mail_response(status: Column, error: Column, body: Column, mail_id: Column, kind: Column) -> Column:
    """Why a response for a mail (kind: detail or track) does not count, by the first rule that holds; ok or source_deleted if it does.

    A detail must name the mail that was asked for, a track may name none; ids are looked for at any depth of its data."""
    parsed = F.try_parse_json(body)
    code = F.get_json_object(body, "$.code").try_cast("double")
    data = F.get_json_object(body, "$.data")
    shape = F.schema_of_variant(parsed)
    ids = F.regexp_extract_all(data, F.lit(r'(?i)"mail_?id"\s*:\s*"?([^",}\]\s]+)'), 1)
    named = F.array_contains(ids, mail_id.cast("string"))
    detail = kind == "detail"
    return rules(
        (~F.coalesce(status.between(200, 299), F.lit(False)), F.concat(F.lit("http_"), F.coalesce(status.cast("string"), F.lit("")))),
        (F.coalesce(error, F.lit("")) != "", "transport_error"),
        (~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)), "invalid_json_object"),
        (detail & F.coalesce(code == DELETED, F.lit(False)), "source_deleted"),
        (~F.coalesce(code == 0, F.lit(False)), "application_code_not_zero"),
        (data.isNull(), "missing_data"),
        (~F.rlike(data, F.lit(r"^\s*[\[{]")), "invalid_data_shape"),
        (detail & (F.size(ids) == 0), "mail_id_missing"),
        ((F.size(ids) > 0) & ~named, "mail_id_mismatch"),
        otherwise="ok",
    )
