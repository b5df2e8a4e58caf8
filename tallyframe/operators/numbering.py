"""Distributed row numbers that survive hot groups.

``row_number`` over a window puts a whole group into one task. That is right for ordinary groups.
A group above the size limit is numbered differently: its rows are range-partitioned by their order,
so the group lies sorted across many tasks, each task counts its own stretch, and the running total
of the stretch sizes (one row per group and partition) turns local positions into group positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.names import col, cols, free_name, is_sortable, join_keys
from tallyframe.session import HOT_GROUP_ROWS, cut, setting

_POSITION_BITS = 33  # monotonically_increasing_id: partition in the upper bits, position in the lower 33


def total_order(df: DataFrame, order: list[Column], used: list[str] = ()) -> list[Column]:
    """``order`` made total by all other columns, so only exact copies can tie."""
    rest = [f.name for f in df.schema.fields if f.name not in set(used) and is_sortable(f.dataType)]
    return list(order) + [col(n).asc_nulls_last() for n in rest]


def hot_groups(tables: list[DataFrame], keys: list[str]) -> DataFrame | None:
    """Keys of the groups above the size limit in any of the tables, or None.

    Counting combines on the map side. At most (rows / limit) groups can be hot, so the result is
    small by construction; it is materialised only when there is one.
    """
    limit = setting(tables[0].sparkSession, HOT_GROUP_ROWS)
    size, table = free_name(keys, "__size"), free_name(keys, "__table")
    counted = reduce(DataFrame.unionByName, [
        df.select(*cols(keys), F.lit(i).alias(table)) for i, df in enumerate(tables)
    ])
    found = counted.groupBy(*cols(keys), col(table)).agg(F.count(F.lit(1)).alias(size)).filter(col(size) > limit)
    found = found.select(*cols(keys))
    return cut(found.distinct()) if found.take(1) else None


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, rows of hot groups)."""
    return join_keys(df, hot, keys, "left_anti"), join_keys(df, hot, keys, "left_semi")


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Row number from 1 within each group of ``keys``."""
    return number_groups(df, keys, order, name, hot_groups([df], keys))


def number_groups(df: DataFrame, keys: list[str], order: list[Column], name: str, hot: DataFrame | None) -> DataFrame:
    """As :func:`number_within`, with the hot groups already known."""
    if hot is None:
        return _window_number(df, keys, order, name)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    return _window_number(cold_rows, keys, order, name).unionByName(_ranged_number(hot_rows, keys, order, name))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number from 1 over the whole table, without a single-task window."""
    return _ranged_number(df, [], order, name)


def _window_number(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order)).cast("long"))


def _ranged_number(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    names = df.columns
    mark, part, tie = (free_name(names, s) for s in ("__mark", "__part", "__tie"))
    # Exact copies tie on every column; the random tie key keeps a run of copies from filling one partition.
    ranging = [c.asc_nulls_first() for c in cols(keys)] + list(order) + [col(tie)]
    ranged = (
        df.withColumn(tie, F.rand(17))
        .repartitionByRange(*ranging)
        .sortWithinPartitions(*ranging)
        .drop(tie)
        .withColumn(mark, F.monotonically_increasing_id())
    )
    # Both uses below must see the same partitions, whatever is recomputed: cut here.
    ranged = cut(ranged).withColumn(part, F.shiftright(col(mark), _POSITION_BITS))
    first, size, before = (free_name(names, s) for s in ("__first", "__size", "__before"))
    stretches = ranged.groupBy(*cols(keys + [part])).agg(
        F.min(col(mark)).alias(first), F.count(F.lit(1)).alias(size)
    )
    earlier = Window.partitionBy(*cols(keys)) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(col(part)).rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn(before, F.coalesce(F.sum(col(size)).over(earlier), F.lit(0)))
    joined = join_keys(ranged, stretches, keys + [part], "inner")
    at = col(mark) - col(first) + col(before) + 1
    return joined.select(*cols(names), at.cast("long").alias(name))
