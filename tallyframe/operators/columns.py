"""Computed columns: calculate, concatenate, conditional and pattern extraction."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import col, field_type, is_number, is_time, require
from tallyframe.functions.text import as_text, to_number
from tallyframe.operators.predicates import WORD_OPERATORS, number

# Arithmetic signs. Division by zero gives NULL.
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}


def _apply(sign: str, a: Column, b: Column) -> Column:
    if sign not in ARITHMETIC:
        raise ValueError(f"operator must be one of {', '.join(ARITHMETIC)}: {sign!r}")
    return ARITHMETIC[sign](a, b)


def _operand(df: DataFrame, name: str) -> Column:
    """Numbers take part as doubles, so integral columns neither overflow nor divide as integers."""
    require(df, [name])
    if not is_number(field_type(df, name)):
        raise ValueError(f"column {name!r} is not numeric")
    return col(name).cast("double")


def calculate_expr(df: DataFrame, operations: list[dict]) -> Column:
    """Left fold without precedence: step one starts at ``column1``, later steps go on from the result."""
    if not operations:
        raise ValueError("calculate needs at least one operation")
    if not operations[0].get("column1"):
        raise ValueError("the first operation needs column1")

    def second(op: dict) -> Column:
        if op.get("column2") is not None:
            return _operand(df, op["column2"])
        if op.get("fixed_value") is not None:
            return F.lit(float(op["fixed_value"]))
        raise ValueError("either column2 or fixed_value must be given")

    start = _operand(df, operations[0]["column1"])
    return reduce(lambda acc, op: _apply(op["operator"], acc, second(op)), operations, start)


def sum_of_steps_expr(df: DataFrame, operations: list[dict]) -> Column:
    """Each step is ``left sign right``; the step results are added."""
    if not operations:
        raise ValueError("at least one operation is needed")

    def step(op: dict) -> Column:
        right = op.get("rightOperand")
        if right == "Fixed Value" and right not in df.columns:
            other = F.lit(float(op["fixedValue"]))
        else:
            other = _operand(df, right)
        return _apply(op["operator"], _operand(df, op["leftOperand"]), other)

    return reduce(lambda a, b: a + b, [step(op) for op in operations])


def concatenate_expr(df: DataFrame, operations: list[dict]) -> Column:
    """``Left`` n, ``Right`` n or ``Full text`` of each column, joined without a separator."""
    if not operations:
        raise ValueError("concatenate needs at least one part")

    def part(op: dict) -> Column:
        require(df, [op["column"]])
        text = F.coalesce(as_text(col(op["column"]), field_type(df, op["column"])), F.lit(""))
        kind = op.get("type", "Full text")
        if kind == "Full text":
            return text
        if kind not in ("Left", "Right"):
            raise ValueError(f"type must be Left, Right or Full text: {kind!r}")
        chars = int(op.get("chars") or 0)
        if chars < 0:
            raise ValueError("chars must not be negative")
        return (F.left if kind == "Left" else F.right)(text, F.lit(chars))

    return F.concat(*[part(op) for op in operations])


def _condition(df: DataFrame, source: str, operator: str, reference: object) -> Column:
    if operator not in WORD_OPERATORS or "null" in operator:
        raise ValueError(f"unsupported operator: {operator!r}")
    c, t = col(source), field_type(df, source)
    test = WORD_OPERATORS[operator]
    text = as_text(c, t)
    if test in ("eq", "ne", "gt", "ge", "lt", "le"):
        wanted = number(reference)
        if wanted is not None and not is_time(t) and not isinstance(t, T.BooleanType):
            a, b = (c if is_number(t) else to_number(text)), F.lit(float(wanted))
        else:
            a, b = text, F.lit(str(reference))
        found = {
            "eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b,
        }[test]
        return F.coalesce(found, F.lit(test == "ne"))
    wanted = str(reference)
    bare = test.removeprefix("not ")
    found = {"starts": text.startswith, "ends": text.endswith, "has": text.contains}[bare](wanted)
    found = F.coalesce(found, F.lit(False))
    return ~found if test.startswith("not ") else found


def conditional_expr(
    df: DataFrame, source: str, conditions: list[dict], residual: object, first_match: bool = False
) -> Column:
    """Value of the last condition that holds (or the first, by option), else ``residual``.

    The results share one type: numbers when every result is a number, text otherwise.
    """
    require(df, [source])
    results = [c["conditional_value"] for c in conditions] + [residual]
    numeric = all(isinstance(r, (int, float)) and not isinstance(r, bool) for r in results if r is not None)

    def lit(value: object) -> Column:
        if value is None:
            return F.lit(None).cast("double" if numeric else "string")
        return F.lit(float(value)) if numeric else F.lit(str(value))

    ordered = conditions if first_match else list(reversed(conditions))
    case = F
    for rule in ordered:
        test = _condition(df, source, rule["operator"], rule["reference_value"])
        case = case.when(test, lit(rule["conditional_value"]))
    return case.otherwise(lit(residual)) if ordered else lit(residual)


def pattern_expr(df: DataFrame, source: str, pattern: str) -> Column:
    """All matches of ``pattern`` joined; its group when it has one, NULL without a match."""
    require(df, [source])
    groups = re.compile(pattern).groups
    pattern = pattern.replace("(?P<", "(?<")  # a named group as Java writes it
    if groups > 1:
        raise ValueError("a pattern may hold one capture group")
    if groups == 0:
        pattern = f"({pattern})"
    found = F.regexp_extract_all(as_text(col(source), field_type(df, source)), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, ""))


def column_expr(df: DataFrame, kind: str, spec: dict) -> Column:
    """Expression of one "add column" specification."""
    source = spec.get("sourceColumn") or spec.get("source_column")
    if kind == "calculate":
        return calculate_expr(df, spec.get("operations") or [])
    if kind == "sum_steps":
        return sum_of_steps_expr(df, spec.get("operations") or [])
    if kind == "concatenate":
        return concatenate_expr(df, spec.get("operations") or [])
    if kind == "conditional":
        residual = spec.get("residualValue", spec.get("residual_value"))
        return conditional_expr(df, source, spec.get("conditions") or [], residual, spec.get("first_match", False))
    if kind == "pattern":
        return pattern_expr(df, source, spec["pattern"])
    raise ValueError(f"unknown column operation: {kind!r}")


def spelled(df: DataFrame, spec: object, named: bool = False) -> object:
    """A specification with the column names it gives in another case spelled as in the table."""
    if isinstance(spec, dict):
        return {k: spelled(df, v, k in ("sourceColumn", "source_column", "column", "column1", "column2")) for k, v in spec.items()}
    if isinstance(spec, list):
        return [spelled(df, v) for v in spec]
    if named and isinstance(spec, str) and spec not in df.columns:
        like = [c for c in df.columns if c.lower() == spec.lower()]
        return like[0] if len(like) == 1 else spec
    return spec


def add_column(df: DataFrame, name: str, kind: str, **spec: object) -> DataFrame:
    spec = spelled(df, spec)
    return df.withColumn(name, column_expr(df, kind, spec))
