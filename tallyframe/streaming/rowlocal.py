"""Filters, computed columns, edits and formats need only their own row, so they take streams as they are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.columns import add_column
from tallyframe.operators.edits import edit_batch
from tallyframe.operators.formatting import apply_formatting
from tallyframe.operators.predicates import filter_rows

_STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": lambda df, s: filter_rows(df, s["rules"], s.get("dialect", "token")),
    "add_column": lambda df, s: add_column(df, s["name"], s["kind"], **(s.get("spec") or {})),
    "edit": lambda df, s: edit_batch(df, s["operations"]),
    "format": lambda df, s: apply_formatting(df, s["configs"]),
}


def transform(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply row-local steps to a stream or a table."""
    for step in steps:
        if step["step"] not in _STEPS:
            raise ValueError(f"not a row-local step: {step['step']!r}")
    return reduce(lambda acc, s: _STEPS[s["step"]](acc, s), steps, df)


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def drain(df: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything that has arrived, then stop; the checkpoint makes each row count once."""
    query = (
        df.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
