"""Sorting, previews, top-k groups, pages and distributed row numbers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.names import col, cols, free_name, require
from tallyframe.operators.numbering import number_rows, total_order
from tallyframe.operators.predicates import filter_rows
from tallyframe.session import PAGE_TAKE_ROWS, setting


def sort_keys(df: DataFrame, config: list[dict]) -> list[Column]:
    """Sort columns with NULLs last in both directions."""
    require(df, [c["column"] for c in config])
    keys = []
    for rule in config:
        word = str(rule.get("order") or rule.get("direction") or "asc").lower()
        if word not in ("asc", "desc", "ascending", "descending"):
            raise ValueError(f"order must be asc or desc: {word!r}")
        c = col(rule["column"])
        keys.append(c.desc_nulls_last() if word.startswith("desc") else c.asc_nulls_last())
    return keys


def sort_rows(df: DataFrame, config: list[dict]) -> DataFrame:
    return df.orderBy(*sort_keys(df, config)) if config else df


def sort_filter(df: DataFrame, sort_config: list[dict], filter_config: list[dict], dialect: str = "token") -> DataFrame:
    return sort_rows(filter_rows(df, filter_config, dialect), sort_config)


def head(df: DataFrame, n: int = 25) -> DataFrame:
    return df.limit(n)


def top_groups(df: DataFrame, label: str, value: str, k: int | None = None) -> DataFrame:
    """Sum of ``value`` per ``label``; the k largest when k is given, ties by label."""
    require(df, [label, value])
    sums = (
        df.filter(col(label).isNotNull())
        .groupBy(col(label))
        .agg(F.coalesce(F.sum(col(value)), F.lit(0)).alias(value))
    )
    if k:
        return sums.orderBy(col(value).desc_nulls_last(), col(label)).limit(k)
    return sums


def page(df: DataFrame, config: list[dict], number: int, per_page: int) -> DataFrame:
    """One page of the sorted table; page numbers start at 1 and are clamped to the pages there are.

    A page near the start is a top-k. A deep page numbers the rows across partitions instead, so no
    task holds all rows before it. All other columns complete the order, so both ways show the same rows.
    """
    most = setting(df.sparkSession, PAGE_TAKE_ROWS)
    if number > 1:
        # Whether a page near the start exists shows in its first row; the count stops there.
        reach = (number - 1) * per_page + 1
        number = clamp_page(number, (df.limit(reach) if reach <= most else df).count(), per_page)
    keys = total_order(df, sort_keys(df, config), [c["column"] for c in config])
    skip = (max(number, 1) - 1) * per_page
    if skip + per_page <= most:
        return df.orderBy(*keys).offset(skip).limit(per_page)
    at = free_name(df.columns, "__row")
    rows = number_rows(df, keys, at)
    return rows.filter((col(at) > skip) & (col(at) <= skip + per_page)).orderBy(col(at)).select(*cols(df.columns))


def page_info(df: DataFrame, per_page: int) -> DataFrame:
    """Total rows and pages as one row."""
    pages = F.ceil(F.col("total_rows") / F.lit(per_page)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_pages", pages)


def clamp_page(number: int, total_rows: int, per_page: int) -> int:
    return max(1, min(number, max(1, ceil(total_rows / per_page))))
