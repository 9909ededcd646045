"""Comparing a Spark result with a DuckDB one, whatever their order."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal


def shown(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, list | tuple):
        return str([shown(v) for v in value])
    if isinstance(value, dict):
        return str({k: shown(v) for k, v in value.items()})
    if isinstance(value, float | Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(bytes(value)) if isinstance(value, bytes | bytearray) else str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(row[k]) for k in order) for row in rows)


def assert_same(df, relation) -> None:
    """df against a DuckDB relation: the same names and the same rows, nulls and repeats included."""
    assert sorted(df.columns) == sorted(relation.columns)
    found = df.toArrow()
    got = rows_of(df.columns, zip(*(column.to_pylist() for column in found.columns)))
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    wrong = [pair for pair in zip(got, want) if pair[0] != pair[1]]
    assert not wrong, f"{len(wrong)} of {len(want)} rows differ: {wrong[:3]}"
