"""Sinks: one table, row-capped parts with a count summary, reconciliation pairs, format conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.readers import format_of, read_table

# Fixed value: rows per part of a row-capped output.
PART_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", part_rows: int | None = None) -> None:
    writer = df.write.mode(mode)
    if part_rows:
        writer = writer.option("maxRecordsPerFile", part_rows)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def write_parts(df: DataFrame, path: str, summary: DataFrame | None = None, fmt: str = "csv",
                part_rows: int = PART_ROWS, mode: str = "errorifexists") -> None:
    """Parts of at most ``part_rows`` rows, all rows kept; the count summary goes to ``<path>_summary``."""
    write_table(df, path, fmt, mode, part_rows)
    if summary is not None:
        write_table(summary.coalesce(1), path.rstrip("/") + "_summary", fmt, mode)


def part_counts(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(rows, parts) a row-capped output needs at least."""
    parts = F.ceil(F.col("rows") / F.lit(part_rows)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", parts)


def write_pair(pair: tuple[DataFrame, DataFrame], paths: tuple[str, str], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The two tables of a reconciliation."""
    for df, path in zip(pair, paths):
        write_table(df, path, fmt, mode)


def convert(spark: SparkSession, source: str, target: str, source_fmt: str | None = None, target_fmt: str | None = None,
            mode: str = "errorifexists") -> None:
    write_table(read_table(spark, source, source_fmt), target, format_of(target, target_fmt), mode)


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
