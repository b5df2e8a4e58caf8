"""Number formats as value conversions, conditional formats as style columns, and cell ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.functions.names import col, cols, field_type, is_number, is_time, require
from tallyframe.functions.text import as_text, to_number
from tallyframe.operators.clean import infinite_to_null
from tallyframe.operators.predicates import WORD_OPERATORS, number

STYLE_SUFFIX = "__style"
NUMBER_FORMATS = ("number", "percentage", "date")

_LETTERS = r"[A-Z]+"
_RANGE = re.compile(rf"^(?P<c1>{_LETTERS})?(?P<r1>\d+)?(?::(?P<c2>{_LETTERS})?(?P<r2>\d+)?)?$")


def number_format_expr(df: DataFrame, column: str, kind: str) -> Column:
    """Cell values under a number format; what does not convert becomes NULL."""
    require(df, [column])
    c, t = col(column), field_type(df, column)
    if kind == "date":
        return c if is_time(t) else dates.stamp_any(dates.complete_partial(as_text(c, t)))
    if kind not in NUMBER_FORMATS:
        raise ValueError(f"number format must be one of {', '.join(NUMBER_FORMATS)}: {kind!r}")
    value = c.cast("double") if is_number(t) else to_number(as_text(c, t))
    return value / F.lit(100.0) if kind == "percentage" else value


def style_expr(df: DataFrame, column: str, conditional: dict) -> Column:
    """``trueFormat`` or ``falseFormat`` of each cell.

    Text operators ignore case. Under a numeric operator a cell that is no number gets no style.
    """
    require(df, [column])
    operator, value = conditional["operator"], conditional.get("value")
    if operator not in WORD_OPERATORS or "null" in operator:
        raise ValueError(f"unsupported operator: {operator!r}")
    test = WORD_OPERATORS[operator]
    c, t = col(column), field_type(df, column)
    true_style, false_style = F.lit(conditional.get("trueFormat")), F.lit(conditional.get("falseFormat"))
    bare = test.removeprefix("not ")
    if bare in ("starts", "ends", "has"):
        text, wanted = F.lower(F.coalesce(as_text(c, t), F.lit(""))), str(value).lower()
        found = {"starts": text.startswith, "ends": text.endswith, "has": text.contains}[bare](wanted)
        return F.when(~found if test.startswith("not ") else found, true_style).otherwise(false_style)
    wanted = number(value)
    if wanted is None:
        return F.lit(None).cast("string")
    cell = c.cast("double") if is_number(t) else to_number(as_text(c, t))
    bound = F.lit(float(wanted))
    found = {
        "eq": cell == bound, "ne": cell != bound, "gt": cell > bound,
        "ge": cell >= bound, "lt": cell < bound, "le": cell <= bound,
    }[test]
    return F.when(found, true_style).when(~found, false_style)


def column_position(letters: str) -> int:
    """0-based position of column letters: A is 0, AA is 26."""
    at = 0
    for letter in letters:
        at = at * 26 + ord(letter) - ord("A") + 1
    return at - 1


def parse_ranges(text: str | None) -> list[dict]:
    """Cell ranges such as ``A``, ``A:C``, ``1:4``, ``A1:D4``, ``A2:B`` or a comma list of them.

    Each becomes 0-based column bounds (None: all columns) and 1-based sheet row bounds, where row 1
    is the header and an open end is None.
    """
    ranges = []
    for part in [p.strip() for p in (text or "").split(",") if p.strip()]:
        found = _RANGE.match(part)
        if not found or not any(found.groupdict().values()) or part.endswith(":") or part.startswith(":"):
            raise ValueError(f"invalid range {part!r}; expected A, A:D, 1:4 or A1:D4")
        c1, r1, c2, r2 = found.group("c1", "r1", "c2", "r2")
        single = ":" not in part
        if not single and (c1 is None) != (c2 is None):
            raise ValueError(f"invalid range {part!r}; expected A, A:D, 1:4 or A1:D4")
        columns = None
        if c1:
            columns = (column_position(c1), column_position(c2 or c1))
        low = int(r1) if r1 else 2
        high = (int(r1) if r1 else None) if single else (int(r2) if r2 else None)
        ranges.append({"columns": columns, "rows": (low, high)})
    return ranges


def range_columns(df: DataFrame, text: str | None) -> list[str]:
    """Columns a range touches, in table order; a plain column name stands for itself."""
    chosen = set()
    for part in [p.strip() for p in (text or "").split(",") if p.strip()]:
        if part in df.columns:
            chosen.add(part)
            continue
        for r in parse_ranges(part):
            low, high = r["columns"] or (0, len(df.columns) - 1)
            if high >= len(df.columns):
                raise ValueError(f"range {part!r} goes past the last column")
            chosen.update(df.columns[low : high + 1])
    return [c for c in df.columns if c in chosen]


def select_range(df: DataFrame, text: str, row_id: str | None = None) -> DataFrame:
    """Columns and rows of a range. Rows need ``row_id``, a column of 1-based data row numbers."""
    ranges = parse_ranges(text)
    names = range_columns(df.drop(row_id) if row_id else df, text)
    conditions = []
    for r in ranges:
        low, high = r["rows"]
        if low <= 2 and high is None:
            return df.select(*cols(names))
        if row_id is None:
            raise ValueError("a row range needs row_id")
        at = col(row_id) + 1
        conditions.append((at >= low) & (at <= high) if high is not None else at >= low)
    keep = conditions[0]
    for c in conditions[1:]:
        keep = keep | c
    return df.filter(keep).select(*cols(names))


def apply_formatting(df: DataFrame, configs: list[dict]) -> DataFrame:
    """Apply number formats to values and add a style column per conditional format.

    Fonts, fills and widths have no table content and pass through.
    """
    df = infinite_to_null(df)
    base = df.columns
    for config in configs:
        kind, detail = config.get("type"), config.get("format") or {}
        targets = range_columns(df.select(*cols(base)), (config.get("location") or {}).get("range"))
        for name in targets:
            if kind == "Cell Number Format":
                df = df.withColumn(name, number_format_expr(df, name, detail.get("numberFormat")))
            elif kind == "Conditional Formatting":
                df = df.withColumn(name + STYLE_SUFFIX, style_expr(df, name, detail["conditional"]))
    return df
