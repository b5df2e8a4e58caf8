"""Column edits: rename, reorder, move, drop, select, replace, and the ordered batch of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import dates
from tallyframe.functions.names import col, cols, field_type, is_number, is_time, require
from tallyframe.functions.text import as_text
from tallyframe.operators.predicates import number, number_literal


def rename(df: DataFrame, mapping: dict[str, str] | list[dict]) -> DataFrame:
    """Rename by map, or by a list of ``{column, newName}``; blanks and unknown names are skipped."""
    if isinstance(mapping, list):
        mapping = {m.get("column"): m.get("newName") for m in mapping}
    mapping = {old: new for old, new in mapping.items() if old and new}
    return df.select(*[col(c).alias(mapping.get(c, c)) for c in df.columns])


def reorder(df: DataFrame, order: list[str]) -> DataFrame:
    """Listed columns first, the rest in their order."""
    require(df, order)
    return df.select(*cols(order + [c for c in df.columns if c not in order]))


def move(df: DataFrame, column: str, positions: int) -> DataFrame:
    """Shift one column left (negative) or right, stopping at the ends."""
    require(df, [column])
    names = [c for c in df.columns if c != column]
    target = max(0, min(len(names), df.columns.index(column) + positions))
    names.insert(target, column)
    return df.select(*cols(names))


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = set(columns)
    return df.select(*cols(c for c in df.columns if c not in gone))


def select_source_order(df: DataFrame, selection: dict[str, bool] | list[str] | None) -> DataFrame:
    """Chosen columns in the table's own order."""
    if selection is None:
        return df
    chosen = {c for c, on in selection.items() if on} if isinstance(selection, dict) else set(selection)
    names = [c for c in df.columns if c in chosen]
    if not names:
        raise ValueError("no columns selected")
    return df.select(*cols(names))


def select_requested_order(df: DataFrame, names: list[str]) -> DataFrame:
    """Chosen columns in the requested order; unknown names are ignored."""
    return df.select(*cols(n for n in names if n in df.columns))


def unique_names(df: DataFrame) -> DataFrame:
    """The n-th column of one name becomes ``name.n``."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name]}")
    return df.toDF(*names)


def typed_literal(value: object) -> object:
    """Read literal text as boolean, NULL, date or number, else keep it."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    lowered = text.lower()
    if lowered in ("true", "false"):
        return lowered == "true"
    if lowered in ("null", "nan", ""):
        return None
    if any(mark in text for mark in "-/.:") and text[:1].isdigit():
        moment = dates.user_stamp(text)
        if moment is not None:
            return moment
    parsed = number(text)
    if parsed is None:
        return text
    return parsed if "." in text or "e" in lowered else int(parsed)


def _replacement(c: Column, t: T.DataType, old: object, new: object) -> Column | None:
    """New cell value, or None when ``old`` has another type than the column."""

    def lit(value: object) -> Column:
        return F.lit(None).cast(t) if value is None else F.lit(value).cast(t)

    def fits(value: object) -> bool:
        if value is None:
            return True
        if is_time(t):
            return isinstance(value, datetime)
        if isinstance(t, T.BooleanType):
            return isinstance(value, bool)
        if is_number(t):
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        return True

    if not fits(old) or not fits(new):
        return None
    if is_number(t) and isinstance(new, float) and isinstance(t, T.IntegralType) and not new.is_integer():
        t = T.DoubleType()
        c = c.cast(t)
    if not (is_number(t) or is_time(t) or isinstance(t, T.BooleanType)):
        new = None if new is None else str(new)
        if old is None:
            return F.coalesce(c, lit(new))
        return F.when(as_text(c, t) == F.lit(str(old)), lit(new)).otherwise(c)
    if old is None:
        return F.coalesce(c, lit(new))
    return F.when(c == F.lit(old), lit(new)).otherwise(c)


def replace_typed(df: DataFrame, columns: list[str], old: object, new: object) -> DataFrame:
    """Replace whole cells equal to a typed literal in the columns of that type (``All`` for every column)."""
    targets = df.columns if "All" in columns else columns
    require(df, targets)
    raw_old, raw_new = old, new
    old, new = typed_literal(old), typed_literal(new)
    changed = {}
    for name in targets:
        t = field_type(df, name)
        other = isinstance(t, (T.StringType, T.VarcharType, T.CharType))
        cell = _replacement(
            col(name), t,
            raw_old if other and old is not None else old,
            raw_new if other and new is not None else new,
        )
        if cell is not None:
            changed[name] = cell
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def replace_cells(df: DataFrame, replacements: list[dict]) -> DataFrame:
    """Replace whole cells one rule after the other; ``matchCase`` false ignores case."""
    for rule in replacements:
        name, old, new = rule["column"], rule.get("oldValue"), rule.get("newValue")
        require(df, [name])
        c, t = col(name), field_type(df, name)
        old_number, new_number = number(old), number(new)
        if is_number(t):
            if old_number is None:
                continue
            if new_number is None:
                cell = F.when(c == number_literal(old_number, t), F.lit(new)).otherwise(as_text(c, t))
            else:
                fits = not isinstance(t, T.IntegralType) or float(new_number).is_integer()
                kind = t if fits else T.DoubleType()
                cell = F.when(c == number_literal(old_number, t), F.lit(new_number).cast(kind)).otherwise(c.cast(kind))
        else:
            text = as_text(c, t)
            wanted = "" if old is None else str(old)
            same = text == F.lit(wanted) if rule.get("matchCase", True) else F.lower(text) == F.lit(wanted.lower())
            if is_time(t) and dates.user_stamp(old) is not None:
                same = c == F.lit(dates.user_stamp(old)).cast(t)
            value = F.lit(None if new is None else str(new))
            cell = F.when(same, value.try_cast(t) if is_time(t) else value).otherwise(c)
        df = df.select(*[cell.alias(n) if n == name else col(n) for n in df.columns])
    return df


def edit_batch(df: DataFrame, operations: list[dict]) -> DataFrame:
    """Delete, reorder and replace in the given order; all renames come last."""
    for op in operations:
        kind = op.get("type")
        if kind == "delete_columns":
            df = drop(df, op.get("columns") or [])
        elif kind == "reorder_columns":
            df = reorder(df, op.get("order") or [])
        elif kind == "replace_values":
            df = replace_cells(df, op.get("replacements") or [])
        elif kind != "rename_columns":
            raise ValueError(f"unknown edit: {kind!r}")
    for op in operations:
        if op.get("type") == "rename_columns":
            df = rename(df, op.get("mapping") or {})
    return df
