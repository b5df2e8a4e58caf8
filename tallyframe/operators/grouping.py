"""Group aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import all_of, col, cols, field_type, free_name, is_text, join_keys, require
from tallyframe.functions.text import as_text
from tallyframe.operators.numbering import hot_groups, number_within, split_hot
from tallyframe.session import PIVOT_MAX_COLUMNS, setting

# The aggregations a specification may name, and those that need numbers.
AGGREGATIONS = ("sum", "mean", "count", "min", "max", "first", "last", "median", "std", "var")
NUMBER_ONLY = ("sum", "mean", "median", "min", "max", "std", "var")


def value_names(values: list[dict]) -> list[str]:
    """Output name per value: its column, or ``column:aggregation`` when the column repeats."""
    columns = [v["column"] for v in values]
    return [c if columns.count(c) == 1 else f"{c}:{v['aggregation']}" for c, v in zip(columns, values)]


def _check(df: DataFrame, keys: list[str], values: list[dict], text_sum: str) -> list[dict]:
    require(df, keys + [v["column"] for v in values])
    checked = []
    for v in values:
        name, how = v["column"], v["aggregation"]
        if how not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}: {how!r}")
        if how in NUMBER_ONLY and is_text(field_type(df, name)):
            if how == "sum" and text_sum == "first":
                how = "first"
            else:
                raise ValueError(f"{how} cannot be applied to text column {name!r}")
        checked.append({"column": name, "aggregation": how})
    return checked


def _aggregate(df: DataFrame, name: str, how: str, order: list[str]) -> Column:
    c = col(name)
    if how == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if how in ("first", "last"):
        # Without an order the whole row gives one, so that the answer does not depend on which task ends first.
        order = order or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        key = F.when(c.isNotNull(), F.struct(*cols(order)))
        return (F.min_by if how == "first" else F.max_by)(c, key)
    plain = {
        "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
        "median": F.median, "std": F.stddev_samp, "var": F.var_samp,
    }
    return plain[how](c)


def group_aggregate(
    df: DataFrame,
    keys: str | list[str],
    values: list[dict],
    order_by: list[str] | None = None,
    drop_empty: bool = True,
    text_sum: str = "error",
) -> DataFrame:
    """One row per key tuple; tuples with a NULL key are left out.

    A sum over no values is 0; ``first`` and ``last`` skip NULLs and follow ``order_by``.
    ``drop_empty`` leaves out groups in which every aggregate is NULL.
    """
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    values = _check(df, keys, values, text_sum)
    names = value_names(values)
    rows = df.filter(all_of(col(k).isNotNull() for k in keys)) if keys else df
    order = order_by or []
    holistic = [(n, v) for n, v in zip(names, values) if v["aggregation"] == "median"]
    if holistic and not keys:
        everything = free_name(df.columns, "__all")
        whole = df.withColumn(everything, F.lit(0))
        return group_aggregate(whole, everything, values, order_by, False, text_sum).drop(everything)
    hot = hot_groups([rows], keys) if holistic else None
    if hot is None:
        made = [_aggregate(df, v["column"], v["aggregation"], order).alias(n) for n, v in zip(names, values)]
        result = rows.groupBy(*cols(keys)).agg(*made)
    else:
        made = [
            _aggregate(df, v["column"], v["aggregation"], order).alias(n)
            for n, v in zip(names, values) if v["aggregation"] != "median"
        ]
        result = rows.groupBy(*cols(keys)).agg(*made, F.count(F.lit(1)).alias(free_name(names + keys, "__rows")))
        for n, v in holistic:
            medians = exact_median(rows, keys, v["column"], n, hot)
            result = join_keys(result, medians, keys, "left")
    result = result.select(*cols(keys + names))
    if drop_empty and keys:
        result = result.filter(F.coalesce(*[col(n).cast("string") for n in names]).isNotNull())
    return result


def exact_median(df: DataFrame, keys: list[str], column: str, name: str, hot: DataFrame) -> DataFrame:
    """Median per group. A hot group is not gathered: its values are numbered across partitions
    and the middle one or two are averaged."""
    values = df.filter(col(column).isNotNull()).select(*cols(keys + [column]))
    cold, spread_out = split_hot(values, keys, hot)
    usual = cold.groupBy(*cols(keys)).agg(F.median(col(column)).alias(name))
    at, n = free_name(df.columns, "__at"), free_name(df.columns, "__n")
    numbered = number_within(spread_out, keys, [col(column)], at)
    sizes = spread_out.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias(n))
    placed = join_keys(numbered, sizes, keys, "inner")
    middle = (col(at) == F.floor((col(n) + 1) / 2)) | (col(at) == F.floor(col(n) / 2) + 1)
    return usual.unionByName(placed.filter(middle).groupBy(*cols(keys)).agg(F.avg(col(column)).alias(name)))


def pivot(
    df: DataFrame,
    row_index: str | list[str],
    column_index: str | list[str] | None,
    values: list[dict],
    order_by: list[str] | None = None,
    headers: list | None = None,
    text_sum: str = "error",
) -> DataFrame:
    """Cross table with columns ``Value|header``, values in the given order, headers sorted.

    The table is aggregated per (row, header) first; spreading the cells into columns then works on
    that small result. The headers are read once, unless given, and their number is checked.
    """
    rows = [row_index] if isinstance(row_index, str) else list(row_index or [])
    if column_index in (None, "", "None", []):
        return group_aggregate(df, rows, values, order_by, text_sum=text_sum)
    heads = [column_index] if isinstance(column_index, str) else list(column_index)
    names = value_names(values)
    cells = group_aggregate(df, rows + heads, values, order_by, text_sum=text_sum)
    limit = setting(df.sparkSession, PIVOT_MAX_COLUMNS)
    label = free_name(df.columns, "__label")
    text = F.concat_ws("|", *[as_text(col(h), field_type(df, h)) for h in heads])
    if headers is None:
        found = df.dropna(subset=rows + heads).select(*cols(heads), text.alias(label)).distinct().limit(limit + 1).collect()
        labels = [r[-1] for r in sorted(found, key=lambda r: tuple(r)[:-1])]
    else:
        labels = _labels(df, heads, headers)
    if len(labels) * len(names) > limit:
        raise ValueError(f"the pivot needs more than {limit} columns (spark.tallyframe.pivotMaxColumns)")
    spread = (
        cells.select(*cols(rows), text.alias(label), *[col(n).alias(f"__v{i}") for i, n in enumerate(names)])
        .groupBy(*cols(rows))
        .pivot(label, labels)
        .agg(*[F.first(F.col(f"__v{i}"), ignorenulls=True).alias(f"__v{i}") for i in range(len(names))])
    )
    # The cells are taken by place: headers may differ in case only.
    placed = spread.toDF(*[f"r{i}" for i in range(len(rows))], *[f"c{i}" for i in range(len(labels) * len(names))])
    made = [
        F.col(f"c{j * len(names) + i}").alias(f"{n}|{x}") for i, n in enumerate(names) for j, x in enumerate(labels)
    ]
    return placed.select(*[F.col(f"r{i}").alias(r) for i, r in enumerate(rows)], *made)


def _labels(df: DataFrame, heads: list[str], headers: list[tuple]) -> list[str]:
    """Text of given header values, made by the same expression as in the data."""
    if not headers:
        return []
    types = [field_type(df, h) for h in heads]
    texts = [
        F.concat_ws("|", *[as_text(F.lit(v).cast(t), t) for v, t in zip(h if isinstance(h, tuple) else (h,), types)])
        for h in headers
    ]
    return list(df.sparkSession.range(1).select(F.array(*texts)).first()[0])


def sum_by_keys(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums per key tuple, as a reconciliation groups its "many" side."""
    require(df, keys + values)
    sums = [F.coalesce(F.sum(col(v)), F.lit(0)).alias(v) for v in dict.fromkeys(values)]
    return df.groupBy(*cols(keys)).agg(*sums) if sums else df.select(*cols(keys)).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, count) of the non-NULL values."""
    require(df, [column])
    return df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
