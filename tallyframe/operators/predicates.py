"""Row predicates in three dialects, and the conjunctive filter.

``token``   equals, not_equals, greater_than ... as saved in table steps; text is case-insensitive
``word``    "equals", "does not equal", "begins with" ...; text is case-sensitive
``format``  the words of conditional formats; text is case-insensitive

Every predicate is a native expression, so typed comparisons reach the parquet scan. A NULL cell
fails every positive test and passes every negative one.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import dates
from tallyframe.functions.names import all_of, col, field_type, is_number, is_text, is_time, require
from tallyframe.functions.text import as_text, to_number

# Operator words of each dialect and the test they stand for.
TOKEN_OPERATORS = {
    "equals": "eq",
    "not_equals": "ne",
    "contains": "has",
    "not_contains": "not has",
    "greater_than": "gt",
    "less_than": "lt",
    "greater_equals": "ge",
    "less_equals": "le",
    "starts_with": "starts",
    "ends_with": "ends",
    "is_null": "null",
    "is_not_null": "not null",
}
WORD_OPERATORS = {
    "equals": "eq",
    "does not equal": "ne",
    "not equals": "ne",
    "greater than": "gt",
    "greater than or equal to": "ge",
    "less than": "lt",
    "less than or equal to": "le",
    "begins with": "starts",
    "does not begin with": "not starts",
    "ends with": "ends",
    "does not end with": "not ends",
    "contains": "has",
    "does not contain": "not has",
    "is null": "null",
    "is not null": "not null",
}
DIALECTS = {"token": TOKEN_OPERATORS, "word": WORD_OPERATORS, "format": WORD_OPERATORS}
TRUE_WORDS = {"true", "1", "yes"}

_COMPARE = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def number(value: object) -> float | int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        pass
    try:
        parsed = float(text)
    except ValueError:
        return None
    return parsed if parsed == parsed else None


def truth(value: object) -> bool:
    return value.strip().lower() in TRUE_WORDS if isinstance(value, str) else bool(value)


def number_literal(value: float | int, t: T.DataType) -> Column:
    """An integral bound keeps an integral column uncast, so the filter is pushed to the scan."""
    if isinstance(t, T.IntegralType) and (isinstance(value, int) or float(value).is_integer()) and -(2**63) <= int(value) < 2**63:
        return F.lit(int(value))
    try:
        return F.lit(float(value))
    except OverflowError:
        return F.lit(float("inf") if value > 0 else float("-inf"))


def _fold(text: Column, value: str, insensitive: bool) -> tuple[Column, str]:
    return (F.lower(text), value.lower()) if insensitive else (text, value)


def _text_test(c: Column, t: T.DataType, test: str, value: object, insensitive: bool, regex: bool) -> Column:
    text = as_text(c, t)
    if test == "has" and regex:
        pattern = ("(?i)" if insensitive else "") + str(value)
        return text.rlike(pattern)
    text, wanted = _fold(text, str(value), insensitive)
    if test == "starts":
        return text.startswith(wanted)
    if test == "ends":
        return text.endswith(wanted)
    if test == "has":
        return text.contains(wanted)
    return _COMPARE[test](text, F.lit(wanted))


def _time_test(c: Column, t: T.DataType, test: str, value: object, whole_day: bool) -> Column | None:
    moment = dates.user_stamp(value)
    if moment is None:
        return None
    if test == "eq" and whole_day:
        start = moment.replace(hour=0, minute=0, second=0, microsecond=0)
        bounds = [_moment(start, t), _moment(start + timedelta(days=1), t)]
        return (c >= bounds[0]) & (c < bounds[1])
    return _COMPARE[test](c, _moment(moment, t))


def _moment(moment, t: T.DataType) -> Column:
    if isinstance(t, T.DateType) and moment.time() == moment.min.time():
        return F.lit(moment.date())
    text = moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp" if isinstance(t, T.TimestampType) else "timestamp_ntz")


def _compare(c: Column, t: T.DataType, test: str, value: object, dialect: str, as_type: str | None) -> Column:
    insensitive = dialect != "word"
    if isinstance(t, T.BooleanType):
        return _COMPARE[test](c, F.lit(truth(value)))
    if is_time(t):
        timed = _time_test(c, t, test, value, whole_day=dialect == "token")
        if timed is not None:
            return timed
        return _text_test(F.trim(c.cast("string")), T.StringType(), test, str(value).strip(), False, False)
    wanted = number(value)
    if is_number(t) and wanted is not None:
        return _COMPARE[test](c, number_literal(wanted, t))
    if is_text(t) and as_type != "text":
        ordered = test != "eq"
        if as_type == "date" or (as_type is None and ordered and wanted is None):
            moment = dates.user_stamp(value)
            if moment is not None:
                typed = dates.stamp_any(c)
                return _time_test(typed, T.TimestampNTZType(), test, value, whole_day=dialect == "token")
        if wanted is not None and (ordered or as_type == "number"):
            return _COMPARE[test](to_number(c), F.lit(float(wanted)))
    return _text_test(c, t, test, value, insensitive, False)


def predicate(
    df: DataFrame,
    column: str,
    operator: str,
    value: object = None,
    dialect: str = "token",
    regex: bool | None = None,
    as_type: str | None = None,
) -> Column:
    """Boolean column of ``column operator value``.

    ``regex`` makes "contains" a regular expression (default: in the word dialect only).
    ``as_type`` ("number", "date", "text") fixes how a text column is compared.
    """
    words = DIALECTS[dialect]
    if operator not in words:
        raise ValueError(f"unsupported operator: {operator!r}")
    require(df, [column])
    test = words[operator]
    c, t = col(column), field_type(df, column)
    if test == "null":
        return c.isNull()
    if test == "not null":
        return c.isNotNull()
    if test == "ne":
        return ~F.coalesce(_compare_ne(c, t, value, dialect, as_type), F.lit(False))
    negated = test.startswith("not ")
    test = test.removeprefix("not ")
    if test in _COMPARE:
        return _compare(c, t, test, value, dialect, as_type)
    pattern = dialect == "word" if regex is None else regex
    if test == "has" and pattern:
        re.compile(str(value))
    found = _text_test(c, t, test, value, dialect != "word", pattern)
    return ~F.coalesce(found, F.lit(False)) if negated else found


def _compare_ne(c: Column, t: T.DataType, value: object, dialect: str, as_type: str | None) -> Column:
    """Equality as "not equals" negates it: an exact instant, and numbers inside text count."""
    if is_time(t):
        moment = dates.user_stamp(value)
        if moment is not None:
            return c == _moment(moment, t)
    if is_text(t) and as_type is None and number(value) is not None and dialect == "token":
        same_text = _text_test(c, t, "eq", value, True, False)
        return same_text | F.coalesce(to_number(c) == F.lit(float(number(value))), F.lit(False))
    return _compare(c, t, "eq", value, dialect, as_type)


def rule_predicate(df: DataFrame, rule: dict, dialect: str = "token") -> Column:
    operator = rule.get("operator") or rule.get("criteria")
    return predicate(
        df, rule["column"], operator, rule.get("value"), dialect, rule.get("regex"), rule.get("as_type")
    )


def filter_rows(df: DataFrame, rules: list[dict], dialect: str = "token") -> DataFrame:
    """Rows that pass every rule; one combined condition, so one pushed-down filter."""
    if not rules:
        return df
    return df.filter(all_of(rule_predicate(df, r, dialect) for r in rules))
