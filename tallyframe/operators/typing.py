"""Column typing: lenient (bad values become NULL) and strict (bad values are an error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyframe.functions import dates
from tallyframe.functions.names import col, field_type, is_number, is_text, is_time
from tallyframe.functions.text import as_text, to_number
from tallyframe.operators.edits import select_source_order
from tallyframe.operators.profile import date_formats

# The names of the conversion targets.
TARGETS = ("integer", "float", "str", "string", "datetime")


def parse_date(df: DataFrame, column: str, fmt: str | None = None) -> Column:
    """Date of a column: partial dates completed, the given format first, then any known format."""
    c, t = col(column), field_type(df, column)
    if is_time(t):
        return c.cast("date")
    text = dates.complete_partial(as_text(c, t))
    return dates.parse_any(text, first=dates.spark_pattern(fmt))


def _whole(c: Column, t) -> Column:
    """Whole numbers, exactly: text that is one digit for digit, else a number without a fraction; others do not convert."""
    if isinstance(t, IntegralType):
        return c.cast("bigint")
    value = c.cast("double") if is_number(t) else to_number(as_text(c, t))
    by_value = F.when((value == F.floor(value)) & (F.abs(value) <= 2**53), value).try_cast("bigint")
    return by_value if is_number(t) else F.coalesce(F.trim(as_text(c, t)).try_cast("bigint"), by_value)


def _converted(df: DataFrame, column: str, target: str, fmt: str | None) -> Column:
    c, t = col(column), field_type(df, column)
    if target == "integer":
        return _whole(c, t)
    if target == "float":
        return c.cast("double") if is_number(t) else to_number(as_text(c, t))
    if target in ("str", "string"):
        return as_text(c, t)
    if target == "datetime":
        return parse_date(df, column, fmt)
    raise ValueError(f"unknown type {target!r}; use one of {', '.join(TARGETS)}")


def coerce_types(df: DataFrame, column_types: dict[str, str], datetime_formats: dict[str, str] | None = None) -> DataFrame:
    """Convert the listed columns; a value that does not convert becomes NULL. Unknown columns are ignored."""
    formats = datetime_formats or {}
    return df.select(*[
        _converted(df, c, column_types[c], formats.get(c)).alias(c) if c in column_types else col(c)
        for c in df.columns
    ])


def infer_types(df: DataFrame, known: dict[str, str] | None = None, datetime_formats: dict[str, str] | None = None) -> dict[str, str]:
    """Target type of every column: integer if all whole numbers, float, datetime (only where a
    format is given), else str. Typed columns need no data; text columns take one aggregate."""
    known, formats = known or {}, datetime_formats or {}
    found, checks = dict(known), {}
    for f in df.schema.fields:
        name, t = f.name, f.dataType
        if name in found:
            continue
        if is_time(t):
            found[name] = "datetime"
        elif is_text(t):
            value = to_number(col(name))
            checks[name] = [F.count(col(name)), F.count_if(value.isNotNull()), F.count_if(value == F.floor(value))]
            if name in formats:
                checks[name].append(F.count_if(parse_date(df, name, formats[name]).isNotNull()))
        elif is_number(t):
            value = col(name)
            checks[name] = [F.count(value), F.count(value), F.count_if(value == F.floor(value))]
        else:
            found[name] = "str"
    if checks:
        flat = [e.alias(f"{i}_{j}") for i, es in enumerate(checks.values()) for j, e in enumerate(es)]
        row = df.agg(*flat).first()
        for i, (name, es) in enumerate(checks.items()):
            n, numeric, whole = (row[f"{i}_{j}"] for j in range(3))
            if numeric == n and (n > 0 or is_number(field_type(df, name))):
                found[name] = "integer" if whole == n else "float"
            elif len(es) == 4 and row[f"{i}_3"] == n:
                found[name] = "datetime"
            else:
                found[name] = "str"
    return {c: found[c] for c in df.columns}


def bad_values(df: DataFrame, column: str, target: str, fmt: str | None = None, n: int = 5) -> DataFrame:
    """A few values of ``column`` that do not convert to ``target``."""
    lost = _converted(df, column, target, fmt).isNull() & col(column).isNotNull()
    return df.filter(lost).select(as_text(col(column), field_type(df, column)).alias("value")).limit(n)


def strict_types(
    df: DataFrame,
    column_selections: dict[str, bool] | list[str] | None = None,
    column_types: dict[str, str] | None = None,
    datetime_formats: dict[str, str] | None = None,
    check: bool = True,
) -> DataFrame:
    """Select and type columns; a value that does not convert is an error naming some of them.

    Only the selected columns are typed, so the scan stays narrow. With ``check`` one aggregate
    counts the failures up front; without it the plan stays lazy and a bad value fails its task.
    """
    formats = datetime_formats or {}
    picked = select_source_order(df, column_selections)
    known = {c: t for c, t in (column_types or {}).items() if c in picked.columns}
    types = infer_types(picked, known, formats)
    made = {c: _converted(picked, c, types[c], formats.get(c)) for c in picked.columns}
    if check:
        asked = list(known)  # an inferred type fits every value already
        lost = picked.agg(*[
            F.count_if(made[c].isNull() & _present(picked, c)).alias(str(i)) for i, c in enumerate(asked)
        ]).first() if asked else []
        for i, c in enumerate(asked):
            if lost[i]:
                samples = [r[0] for r in bad_values(picked, c, types[c], formats.get(c)).collect()]
                raise ValueError(f"cannot convert column {c!r} to {types[c]}: {', '.join(map(str, samples))}")
        return picked.select(*[made[c].alias(c) for c in picked.columns])

    def guarded(c: str) -> Column:
        message = F.concat(F.lit(f"cannot convert column {c!r} to {types[c]}: "), as_text(col(c), field_type(picked, c)))
        return F.when(made[c].isNull() & _present(picked, c), F.raise_error(message)).otherwise(made[c]).alias(c)

    return picked.select(*[guarded(c) for c in picked.columns])


def _present(df: DataFrame, column: str) -> Column:
    c = col(column)
    return c.isNotNull() & (F.trim(c) != "") if is_text(field_type(df, column)) else c.isNotNull()


def inferred_date_format(df: DataFrame, column: str, sample: int | None = None) -> str:
    return date_formats(df, [column], sample).first()["format"]


def type_tables(tables: dict[str, DataFrame], configs: list[dict]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Type several tables; a failing table is reported and leaves the others alone."""
    done, report = {}, []
    for config in configs:
        name = config["tableName"]
        try:
            if name not in tables:
                raise ValueError(f"table not found: {name}")
            done[name] = strict_types(
                tables[name], config.get("columnSelections"), config.get("columnTypes"), config.get("datetimeFormats")
            )
            report.append({"tableName": name, "success": True, "error": None})
        except Exception as error:  # noqa: BLE001 - partial success is the contract
            report.append({"tableName": name, "success": False, "error": str(error)})
    return done, report
