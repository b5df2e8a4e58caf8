"""Profiling in one pass: logical types, summaries and date formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import dates
from tallyframe.functions.names import col, cols, is_fraction, is_number, is_text, is_time
from tallyframe.functions.text import as_text, exact_text, to_number

# Texts that make a column boolean, and the share of date-like values above which it is a date.
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no"]
DATE_SHARE = 0.7


_KINDS = ("n", "bool", "shape", "date", "number", "whole")


def logical_types(df: DataFrame) -> DataFrame:
    """(column, type) by value: boolean, date, integer, float or string.

    Per column the values of each kind are counted, then a ``CASE`` decides. A 0/1 column is boolean;
    a date needs more than 70 % date shapes and every value readable as a date. Text columns are
    counted as (column, value) rows, so the plan stays small however wide the table is; the counts
    combine before the shuffle, which carries one row per column and task.
    """
    fields = df.schema.fields
    text = [f.name for f in fields if not is_number(f.dataType) and not is_time(f.dataType)]
    # Every column appears in this one row; text columns with zeros, to which their counts are added.
    counts, entries = [], []
    for i, f in enumerate(fields):
        kinds = {} if f.name in text else _typed_counts(col(f.name), f.dataType)
        counts += [e.alias(f"c{i}_{k}") for k, e in kinds.items()]
        entries.append(F.struct(F.lit(f.name).alias("column"), *[
            (F.col(f"c{i}_{k}") if k in kinds else F.lit(0).cast("long")).alias(k) for k in _KINDS
        ]))
    row = df.agg(F.lit(1).alias("one"), *counts) if counts else df.sparkSession.range(1)
    found = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if text:
        found = found.unionByName(_text_counts(df, text))
    totals = found.groupBy("column").agg(*[F.sum(k).alias(k) for k in _KINDS])
    return totals.select("column", _decide().alias("type"))


def _typed_counts(c: Column, t: T.DataType) -> dict[str, Column]:
    value = F.nanvl(c, F.lit(None).cast(t)) if is_fraction(t) else c
    n = F.count(value)
    if is_time(t):
        return {"n": n, "shape": n, "date": n}
    counts = {"n": n, "date": n, "number": n}
    if not isinstance(t, T.IntegralType):
        return counts | {"whole": F.count_if(value == F.floor(value))}
    # Whole numbers read as YYYYMMDD have the shape of a date.
    return counts | {
        "whole": n, "bool": F.count_if(value.isin(0, 1)), "shape": F.count_if(value.between(10_000_000, 99_999_999)),
    }


def _text_counts(df: DataFrame, names: list[str]) -> DataFrame:
    texts = F.array(*[as_text(col(n), df.schema[n].dataType) for n in names])
    values = df.select(F.posexplode(texts).alias("at", "v")).filter(F.col("v").isNotNull())
    v = F.col("v")
    parsed = to_number(v)
    labels = F.array(*[F.lit(n) for n in names])
    return values.groupBy("at").agg(
        F.count(v).alias("n"),
        F.count_if(F.lower(v).isin(BOOLEAN_WORDS)).alias("bool"),
        F.count_if(v.rlike(dates.DATE_SHAPE)).alias("shape"),
        F.count_if(dates.stamp_any(v).isNotNull()).alias("date"),
        F.count_if(parsed.isNotNull()).alias("number"),
        F.count_if(parsed == F.floor(parsed)).alias("whole"),
    ).select(F.element_at(labels, F.col("at") + 1).alias("column"), *_KINDS)


def _decide() -> Column:
    n, boolean, shape, date, number, whole = (F.col(k) for k in _KINDS)
    return (
        F.when(n == 0, "string")
        .when(boolean == n, "boolean")
        .when((shape > n * F.lit(DATE_SHARE)) & (date == n), "date")
        .when(whole == n, "integer")
        .when(number == n, "float")
        .when(date == n, "date")
        .otherwise("string")
    )


def schema_types(df: DataFrame) -> dict[str, str]:
    """Labels by schema type alone, without reading data."""
    return {f.name: schema_label(f.dataType) for f in df.schema.fields}


def schema_label(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if is_time(t):
        return "date"
    if isinstance(t, T.IntegralType):
        return "integer"
    return "float" if is_number(t) else "string"


def storage_types(df: DataFrame) -> dict[str, str]:
    """The four storage labels: integer, float, datetime, string."""
    names = {"date": "datetime", "boolean": "string"}
    return {n: names.get(t, t) for n, t in schema_types(df).items()}


def mixed_types(df: DataFrame) -> DataFrame:
    """(column, type): schema types first, values decide for text columns only; no value booleans."""
    text = [f.name for f in df.schema.fields if is_text(f.dataType)]
    known = [(n, t) for n, t in schema_types(df).items() if n not in set(text)]
    spark = df.sparkSession
    fixed = spark.createDataFrame(known, "column string, type string")
    if not text:
        return fixed
    found = logical_types(df.select(*cols(text)))
    whole = F.when(F.col("type") == "boolean", "string").otherwise(F.col("type"))
    return fixed.unionByName(found.select("column", whole.alias("type")))


def summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, rows, nulls, distinct) per column.

    Exact distinct counts go through (column, value) pairs: the shuffle key is the pair, so no
    column and no frequent value gathers in one task.
    """
    fields = df.schema.fields
    values = [exact_text(_plain(f), f.dataType) for f in fields]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(_plain(f)).alias(f"n{i}") for i, f in enumerate(fields)],
        *([F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values)] if approximate else []),
    )
    entries = [
        F.struct(
            F.lit(i).alias("at"),
            F.lit(f.name).alias("column"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            *([F.col(f"d{i}").alias("distinct")] if approximate else []),
        )
        for i, f in enumerate(fields)
    ]
    per_column = counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if approximate:
        return per_column.drop("at")
    pairs = df.select(F.posexplode(F.array(*values)).alias("at", "value")).filter(F.col("value").isNotNull())
    distinct = pairs.groupBy("at").agg(F.count_distinct("value").alias("distinct"))
    return per_column.join(distinct, "at", "left").select(
        "column", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct")
    )


def _plain(f: T.StructField) -> Column:
    return F.nanvl(col(f.name), F.lit(None).cast(f.dataType)) if is_fraction(f.dataType) else col(f.name)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def profile(df: DataFrame) -> DataFrame:
    """Types and summary side by side, one row per column."""
    return summary(df).join(logical_types(df), "column").select("column", "type", "rows", "nulls", "distinct")


def date_formats(df: DataFrame, columns: list[str], sample: int | None = None) -> DataFrame:
    """(column, format): the first known format that reads every value, else YYYY-MM-DD.

    ``sample`` looks at the first values only, as an interactive preview does.
    """
    data = df.select(*[as_text(col(c), df.schema[c].dataType).alias(str(i)) for i, c in enumerate(columns)])
    if sample:
        data = data.filter(" or ".join(f"`{i}` is not null" for i in range(len(columns)))).limit(sample)
    names = list(dates.DATE_FORMATS)
    counts = [F.count(F.col(str(i))).alias(f"n{i}") for i in range(len(columns))]
    for i in range(len(columns)):
        for j, name in enumerate(names):
            read = dates.parse_with(F.col(str(i)), dates.DATE_FORMATS[name])
            counts.append(F.count_if(read.isNotNull()).alias(f"f{i}_{j}"))
    row = data.agg(*counts)
    found = []
    for i, c in enumerate(columns):
        case = F.when(F.col(f"n{i}") == 0, dates.DEFAULT_FORMAT)
        for j, name in enumerate(names):
            case = case.when(F.col(f"f{i}_{j}") == F.col(f"n{i}"), name)
        found.append(F.struct(F.lit(c).alias("column"), case.otherwise(dates.DEFAULT_FORMAT).alias("format")))
    return row.select(F.explode(F.array(*found)).alias("p")).select("p.column", "p.format")
