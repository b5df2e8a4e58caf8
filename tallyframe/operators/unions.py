"""Vertical merges: common columns, strict, and union of all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tallyframe.functions.names import col, field_type, is_number, is_time
from tallyframe.functions.text import as_text


def _widened(t1: T.DataType, t2: T.DataType) -> T.DataType:
    if t1 == t2:
        return t1
    if is_number(t1) and is_number(t2):
        both_integral = isinstance(t1, T.IntegralType) and isinstance(t2, T.IntegralType)
        return T.LongType() if both_integral else T.DoubleType()
    if is_time(t1) and is_time(t2):
        return T.TimestampNTZType()
    return T.StringType()


def _as(df: DataFrame, name: str, t: T.DataType) -> Column:
    own = field_type(df, name)
    c = col(name)
    if own == t:
        return c
    return (as_text(c, own) if isinstance(t, T.StringType) else c.cast(t)).alias(name)


def union_common(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both tables under their common columns, in the first table's order; copies stay."""
    common = [c for c in top.columns if c in bottom.columns]
    if not common:
        raise ValueError("no common columns")
    types = {c: _widened(field_type(top, c), field_type(bottom, c)) for c in common}
    return top.select(*[_as(top, c, t) for c, t in types.items()]).unionByName(
        bottom.select(*[_as(bottom, c, t) for c, t in types.items()])
    )


def dropped_columns(top: DataFrame, bottom: DataFrame) -> dict[str, list[str]]:
    return {
        "table1": [c for c in top.columns if c not in bottom.columns],
        "table2": [c for c in bottom.columns if c not in top.columns],
    }


def union_strict(top: DataFrame, bottom: DataFrame, loose_names: bool = False) -> DataFrame:
    """Both tables must hold the same columns; ``loose_names`` trims and lower-cases names first."""
    if loose_names:
        top = top.toDF(*[c.strip().lower() for c in top.columns])
        bottom = bottom.toDF(*[c.strip().lower() for c in bottom.columns])
    if set(top.columns) != set(bottom.columns):
        raise ValueError("the tables hold different columns")
    return union_common(top, bottom)


def union_all_columns(tables: list[DataFrame]) -> DataFrame:
    """All columns of all tables; a column a table lacks is NULL there."""
    if not tables:
        raise ValueError("at least one table is needed")
    types: dict[str, T.DataType] = {}
    for df in tables:
        for f in df.schema.fields:
            types[f.name] = _widened(types.get(f.name, f.dataType), f.dataType)
    typed = [df.select(*[_as(df, c, types[c]) for c in df.columns]) for df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)
