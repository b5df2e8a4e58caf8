"""Cleaning: empty columns, null fills, infinities and display forms."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import col, cols, field_type, is_fraction, is_number, is_text, is_time, require
from tallyframe.functions.text import as_text

# Fixed value: the date that stands for a missing date.
BLANK_DATE = date(1900, 1, 1)


def nan_to_null(df: DataFrame) -> DataFrame:
    """A NaN is a missing value here, while Spark treats it as the largest number."""
    return _by_type(df, lambda c, t: F.nanvl(c, F.lit(None).cast(t)) if is_fraction(t) else c)


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Infinities and NaN become NULL."""
    def finite(c: Column, t: T.DataType) -> Column:
        if not is_fraction(t):
            return c
        return F.when(F.abs(c) < F.lit(float("inf")), c)
    return _by_type(df, finite)


def fill_blanks(df: DataFrame, dates: bool = True) -> DataFrame:
    """NULL becomes 0, 1900-01-01 or '' by the type of the column."""
    def filled(c: Column, t: T.DataType) -> Column:
        if is_number(t):
            plain = F.nanvl(c, F.lit(None).cast(t)) if is_fraction(t) else c
            return F.coalesce(plain, F.lit(0).cast(t))
        if is_time(t) and dates:
            return F.coalesce(c, F.lit(BLANK_DATE).cast(t))
        if is_text(t):
            return F.coalesce(c, F.lit(""))
        return c
    return _by_type(df, filled)


def fill_literal(df: DataFrame, literal: str = "-") -> DataFrame:
    """Display form: every cell as text, NULL as ``literal``."""
    return df.select(*[
        F.coalesce(as_text(col(f.name), f.dataType), F.lit(literal)).alias(f.name) for f in df.schema.fields
    ])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a value and columns named ``Unnamed...``; one aggregate decides."""
    named = [c for c in df.columns if c and not c.startswith("Unnamed")]
    if not named:
        return df.select()
    counts = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(named)]).first()
    return df.select(*cols(c for i, c in enumerate(named) if counts[i] > 0))


def format_result(df: DataFrame) -> DataFrame:
    """Dates as ISO text; numeric columns with "year" in their name as integers."""
    fields = []
    for f in df.schema.fields:
        c = col(f.name)
        if is_time(f.dataType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif is_number(f.dataType) and "year" in f.name.lower():
            c = c.try_cast("int")
        fields.append(c.alias(f.name))
    return df.select(*fields)


def standardise_key(df: DataFrame, column: str) -> DataFrame:
    """Make a join key comparable: year text, ISO date, 0 for a missing fraction, else trimmed text."""
    require(df, [column])
    c, t = col(column), field_type(df, column)
    if is_time(t):
        key = F.year(c).cast("string") if column == "Year" else F.date_format(c, "yyyy-MM-dd")
    elif is_fraction(t):
        key = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    elif is_number(t):
        key = c
    else:
        key = F.trim(as_text(c, t))
    return df.select(*[key.alias(n) if n == column else col(n) for n in df.columns])


def _by_type(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
