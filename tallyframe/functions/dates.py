"""Date text: partial dates, known formats, inference and strict or lenient parsing."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display formats users may choose, in the order in which inference tries them.
# Each has the strict shape of its text and the Spark pattern that reads it.
DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-M-d",
    "DD/MM/YYYY": "d/M/yyyy",
    "MM/DD/YYYY": "M/d/yyyy",
    "YYYY/MM/DD": "yyyy/M/d",
    "DD-MM-YYYY": "d-M-yyyy",
    "MM-DD-YYYY": "M-d-yyyy",
    "YYYYMMDD": "yyyyMMdd",
    "DD.MM.YYYY": "d.M.yyyy",
    "YYYY.MM.DD": "yyyy.M.d",
}
DEFAULT_FORMAT = "YYYY-MM-DD"

# Text shapes that count as date-like when a column is profiled.
DATE_SHAPES = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{8}",
    r"\d{2}\.\d{2}\.\d{4}",
    r"\d{4}\.\d{2}\.\d{2}",
]
DATE_SHAPE = "^(?:" + "|".join(DATE_SHAPES) + ")$"

# Formats tried for a date the user types into a filter, day first.
USER_FORMATS = ["%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d", "%Y/%m/%d"]
USER_TIME_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%d"]

# Lenient readings of free date text, besides the display formats.
_STAMP_PATTERNS = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m"]


def spark_pattern(fmt: str | None) -> str | None:
    """Spark pattern of a display format or of a ``%Y-%m-%d`` style format."""
    if fmt is None:
        return None
    if fmt in DATE_FORMATS:
        return DATE_FORMATS[fmt]
    if "%" in fmt:
        codes = {"%Y": "yyyy", "%m": "M", "%d": "d", "%y": "yy", "%H": "H", "%M": "m", "%S": "s",
                 "%b": "MMM", "%B": "MMMM"}
        if fmt == "%Y%m%d":
            return "yyyyMMdd"
        for code, letters in codes.items():
            fmt = fmt.replace(code, letters)
    return fmt


def _shape(pattern: str) -> str:
    """Regular expression of the texts a numeric pattern can read."""
    pieces = re.findall(r"y+|M+|d+|H|m|s|'T'|.", pattern)
    digits = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}"}
    return "^" + "".join(
        digits.get(p, r"\d{1,2}" if p in ("M", "d", "H", "m", "s") else "T" if p == "'T'" else re.escape(p)) for p in pieces
    ) + "$"


_SHAPES = {p: _shape(p) for p in [*DATE_FORMATS.values(), *_STAMP_PATTERNS]}


def _stamp(c: Column, pattern: str) -> Column:
    """Timestamp of a text, NULL when it does not fit; the cheap shape test spares failing parses."""
    read = F.try_to_timestamp(c, F.lit(pattern))
    return F.when(c.rlike(_SHAPES[pattern]), read) if pattern in _SHAPES else read


def parse_with(c: Column, pattern: str) -> Column:
    return F.to_date(_stamp(c, pattern))


def parse_any(c: Column, first: str | None = None, day_first: bool = True) -> Column:
    """Date of a text in any known format, NULL when none fits."""
    patterns = list(DATE_FORMATS.values())
    if not day_first:
        patterns = sorted(patterns, key=lambda p: (p.startswith("d"), patterns.index(p)))
    if first:
        patterns = [first] + [p for p in patterns if p != first]
    read = F.coalesce(*[parse_with(c, p) for p in patterns + _STAMP_PATTERNS])
    return read if first and first not in _SHAPES else F.when(_may_be_date(c), read)


def _may_be_date(c: Column) -> Column:
    """Every known date form starts with a digit and has at least eight characters."""
    return (F.length(c) >= 8) & c.rlike(r"^\d")


def stamp_any(c: Column, day_first: bool = True) -> Column:
    """Timestamp without zone of a text in any known format, NULL when none fits."""
    with_time = [_stamp(c, p).cast("timestamp_ntz") for p in _STAMP_PATTERNS]
    timed = F.when(F.length(c) > 10, F.coalesce(*with_time))
    return F.when(_may_be_date(c), F.coalesce(timed, parse_any(c, day_first=day_first).cast("timestamp_ntz")))


def complete_partial(c: Column) -> Column:
    """``2020`` -> ``2020-01-01``, ``20231201`` -> ``2023-12-01``, ``2020-05`` -> ``2020-05-01``."""
    text = F.trim(c)
    eight = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    valid_eight = text.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$")
    return (
        F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
        .when(valid_eight, eight)
        .when(text.rlike(r"^\d+-\d+$"), F.concat(text, F.lit("-01")))
        .otherwise(text)
    )


def user_stamp(value: object) -> datetime | None:
    """Read a date typed by the user; day comes first when the order is open."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = str(value).strip()
    for fmt in USER_FORMATS + USER_TIME_FORMATS + ["%m/%d/%Y", "%m-%d-%Y"]:
        try:
            return datetime.strptime(text, fmt)
        except ValueError:
            continue
    return None
