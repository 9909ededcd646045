"""Quality gates: one row for each, with its number of violations; nothing passes silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate or requirement that does not hold; the message begins with its stable code."""


def gate(gate_id: str, violations: DataFrame) -> DataFrame:
    """gate_id, violations, status of the rows that break a rule."""
    counted = violations.agg(F.count("*").alias("violations"))
    return counted.select(F.lit(gate_id).alias("gate_id"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"))


def report(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def enforce(gates: DataFrame) -> DataFrame:
    """Raises GateError naming every gate that fails; the gates are few, whatever they look at."""
    failed = [f"{r.gate_id}={r.violations}" for r in gates.filter("status <> 'PASS'").orderBy("gate_id").collect()]
    if failed:
        raise GateError("GATES_FAILED: " + ", ".join(failed))
    return gates


def expected_counts(expected: dict[str, int], actual: dict[str, DataFrame]) -> DataFrame:
    """One gate for each count; counts must be given, as integers of 0 or more."""
    for name, n in expected.items():
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise GateError(f"EXPECTED_COUNT_INVALID: {name}")
    missing = set(actual) - set(expected)
    if missing:
        raise GateError(f"EXPECTED_COUNT_MISSING: {', '.join(sorted(missing))}")
    rows = []
    for name, df in actual.items():
        counted = df.agg(F.count("*").alias("actual"))
        rows.append(counted.select(
            F.lit(name).alias("gate_id"), F.abs(F.col("actual") - expected[name]).alias("violations"),
            F.when(F.col("actual") == expected[name], "PASS").otherwise("FAIL").alias("status")
        ))
    return report(*rows)


def require_columns(df: DataFrame, columns: list[str], code: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GateError(f"{code}: missing {', '.join(missing)}")
    return df
