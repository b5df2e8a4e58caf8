"""Chart-ready datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.names import col, cols, field_type, is_number, require
from tallyframe.functions.text import as_text
from tallyframe.operators.sorting import top_groups


def series_wide(df: DataFrame, x: str, series: list[dict]) -> DataFrame:
    """x and one column per series, raw rows."""
    names = list(dict.fromkeys([x] + [s["column"] for s in series]))
    require(df, names)
    return df.select(*cols(names))


def series_long(df: DataFrame, x: str, series: list[dict]) -> DataFrame:
    """(x, series, type, axis, value) for line, bar and combination charts.

    One row per source row and series; ``axis`` is Left or Right. A projection, no shuffle.
    """
    require(df, [x] + [s["column"] for s in series])
    numeric = all(is_number(field_type(df, s["column"])) for s in series)
    entries = []
    for s in series:
        value = col(s["column"])
        value = value.cast("double") if numeric else as_text(value, field_type(df, s["column"]))
        entries.append(F.struct(
            F.lit(s["column"]).alias("series"),
            F.lit(s.get("type", "Bar")).alias("type"),
            F.lit(s.get("axis", "Left")).alias("axis"),
            value.alias("value"),
        ))
    return df.select(col(x), F.explode(F.array(*entries)).alias("__s")).select(col(x), "__s.*")


def horizontal_bars(df: DataFrame, y: str, series: list[dict]) -> DataFrame:
    """(y, series, value): the label runs along the vertical axis, all series share one value axis."""
    return series_long(df, y, series).drop("type", "axis")


def pie(df: DataFrame, labels: str, values: str, largest: int | None = None) -> DataFrame:
    """Sum per label for pie and donut charts, the largest only when asked."""
    return top_groups(df, labels, values, largest)
