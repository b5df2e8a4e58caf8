"""Column names may hold spaces, dots, pipes and colons, so every reference is quoted."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_fraction(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_sortable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return is_sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(is_sortable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def require(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found in {what}: {', '.join(missing)}")


def free_name(taken: Iterable[str], stem: str) -> str:
    taken = set(taken)
    while stem in taken:
        stem += "_"
    return stem


def shared_groups(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides whose group ``g`` the other side has too, so that no one-sided group reaches a task."""
    names = [df.select("g").distinct() for df in (left, right)]
    return join_keys(left, names[1], ["g"], "left_semi"), join_keys(right, names[0], ["g"], "left_semi")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join on equally named columns that keeps the left keys only.

    The right keys are renamed first, so both sides may stem from the same table.
    """
    taken = set(left.columns) | set(right.columns)
    other = {k: free_name(taken, f"__r{i}") for i, k in enumerate(keys)}
    right = right.select(*[col(c).alias(other.get(c, c)) for c in right.columns])
    on = all_of(col(k).eqNullSafe(col(other[k])) for k in keys)
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())
