"""Deterministic keys: SHA-256 of parts joined by NUL, node, edge and fact identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def stable_key(*parts: Column) -> Column:
    """SHA-256 (lowercase hex) of the parts joined by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def node_id(node_type: str | Column, value: Column) -> Column:
    """type:sha256(value)."""
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(kind, F.lit(":"), F.sha2(value.cast("string"), 256))


def fact_id(left: Column, relation: Column, right: Column) -> Column:
    """First 32 upper-case hex digits over both ends and the relation."""
    return F.upper(F.substring(stable_key(left, relation, right), 1, 32))


def short_key(*parts: Column) -> Column:
    """16 bytes of SHA-256, a quarter of what a key in hex takes: what rows are matched by when they only have to be told apart.
    A lone null stays null; of several parts, null is a value of its own."""
    texts = [p.cast("string") for p in parts]
    told = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.substring(F.sha2(F.concat(*told) if len(texts) > 1 else texts[0], 256), 1, 32))


def match_key(*parts: Column) -> Column:
    """Two hashes of different kinds, 12 bytes, that cost a fraction of SHA-256: what rows of one query are matched by, not written for anyone.
    Unequal parts meet by chance only (under 1e-11 for a thousand million keys).  A lone null stays null; of several parts, null is a value of its own."""
    texts = [p.cast("string") for p in parts]
    if len(texts) == 1:
        return F.when(texts[0].isNotNull(), F.struct(F.xxhash64(texts[0]).alias("a"), F.hash(texts[0]).alias("b")))
    told = [c for t in texts for c in (t.isNull(), t)]
    return F.struct(F.xxhash64(*told).alias("a"), F.hash(*told).alias("b"))
