"""Scans: typed, null-token, sampled, column subset, multi-file, and registration with a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import col, cols, is_text, require
from tallyframe.operators.clean import nan_to_null
from tallyframe.operators.profile import profile
from tallyframe.operators.unions import union_all_columns
from tallyframe.sources.records import has_line_breaks, parse, records, split_parities

FORMATS = ("csv", "json", "parquet", "orc")
# Cell texts that mean "missing".
NULL_TOKENS = ("NA", "")


def format_of(path: str, fmt: str | None = None) -> str:
    found = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if found not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; give one of {', '.join(FORMATS)}")
    return found


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: str | T.StructType | None = None,
    columns: list[str] | None = None,
    null_tokens: tuple[str, ...] | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """Read one table. A given ``schema`` spares the inference pass; ``columns`` prune the scan.

    In csv a doubled quote inside quotes is a quote, and line breaks may stand inside quotes. Quotes are counted split by
    split first; only files in which a quoted cell does hold a line break are then cut into records, still in splits. A
    quote that is open at the end of a file raises. ``line_breaks=False`` spares the count: every line is a record.
    """
    fmt = format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
        reader = reader.option("quote", '"').option("escape", '"')
        if null_tokens:
            reader = reader.option("nullValue", null_tokens[0])
    parities = split_parities(spark, path) if fmt == "csv" and line_breaks else None
    if parities is not None and has_line_breaks(parities):
        names = None if schema is None else (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).names
        df = parse(reader, records(spark, path, parities), names)
    else:
        df = reader.format(fmt).load(path)
    if columns is not None:
        require(df, columns)
        df = df.select(*cols(columns))
    df = tokens_to_null(df, null_tokens) if null_tokens else df
    return nan_to_null(df) if fmt == "csv" else df


def tokens_to_null(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Text cells equal to a null token become NULL."""
    return df.select(*[
        F.when(~col(f.name).isin(*tokens), col(f.name)).alias(f.name) if is_text(f.dataType) else col(f.name)
        for f in df.schema.fields
    ])


def read_sample(spark: SparkSession, path: str, n: int, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """First rows only; the scan stops early."""
    return read_table(spark, path, fmt, schema).limit(n)


def read_stacked(spark: SparkSession, paths: list[str], fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Several files under the union of their columns."""
    return union_all_columns([read_table(spark, p, fmt, schema) for p in paths])


def register_table(df: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Register the whole table under ``name`` and return it with its profile.

    With ``folder`` the table is written as parquet and its profile beside it.
    """
    if folder:
        target = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(target)
        df = df.sparkSession.read.parquet(target)
    about = profile(df)
    if folder:
        about.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}.profile")
    df.createOrReplaceTempView(name)
    return df, about
