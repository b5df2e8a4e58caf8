"""Schema checks that read no data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.profile import schema_types

REPORT = "column string, status string, expected string, actual string"


def exact(expected: DataFrame | dict[str, str], actual: DataFrame) -> DataFrame:
    """Report of missing, extra and differently typed columns; all ``ok`` when the schemas agree."""
    return actual.sparkSession.createDataFrame(_rows(_types(expected), schema_types(actual), True), REPORT)


def superset(expected: DataFrame | dict[str, str], actual: DataFrame) -> DataFrame:
    """As :func:`exact`, but extra columns are fine and not reported."""
    return actual.sparkSession.createDataFrame(_rows(_types(expected), schema_types(actual), False), REPORT)


def problems(expected: DataFrame | dict[str, str], actual: DataFrame, allow_extra: bool = False) -> list[dict]:
    rows = _rows(_types(expected), schema_types(actual), not allow_extra)
    return [dict(zip(("column", "status", "expected", "actual"), r)) for r in rows if r[1] != "ok"]


def conforms(expected: DataFrame | dict[str, str], actual: DataFrame, allow_extra: bool = False) -> bool:
    return not problems(expected, actual, allow_extra)


def _types(schema: DataFrame | dict[str, str]) -> dict[str, str]:
    return schema if isinstance(schema, dict) else schema_types(schema)


def _rows(expected: dict[str, str], actual: dict[str, str], extras: bool) -> list[tuple]:
    rows = []
    for name, kind in expected.items():
        if name not in actual:
            rows.append((name, "missing", kind, None))
        else:
            rows.append((name, "ok" if actual[name] == kind else "type mismatch", kind, actual[name]))
    if extras:
        rows += [(name, "extra", None, kind) for name, kind in actual.items() if name not in expected]
    return rows


def compare_profiles(expected: DataFrame, actual: DataFrame, allow_extra: bool = False) -> DataFrame:
    """The same report from two (column, type) profiles of values."""
    want = expected.select(F.col("column").alias("e"), F.col("type").alias("expected"))
    have = actual.select(F.col("column").alias("a"), F.col("type").alias("actual"))
    status = (
        F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra")
        .when(F.col("expected") != F.col("actual"), "type mismatch").otherwise("ok")
    )
    joined = want.join(have, F.col("e") == F.col("a"), "left" if allow_extra else "full")
    return joined.select(F.coalesce("e", "a").alias("column"), status.alias("status"), "expected", "actual")
