"""Text forms of values and key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import is_fraction

# Fixed value: characters kept when special characters are ignored.
NOT_ALPHANUMERIC = "[^a-zA-Z0-9]"
# Fixed value: text that reads as a number.
NUMBER_SHAPE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# Fixed value: sign, whole digits, fraction digits and exponent of such a text.
NUMBER_PARTS = r"^\s*([-+]?)(\d*)\.?(\d*)(?:[eE]([-+]?\d+))?\s*$"


def as_text(c: Column, t: T.DataType) -> Column:
    """Text of a value; fractions keep plain decimals (``10000000.0``), not ``1.0E7``."""
    if is_fraction(t):
        size = F.abs(c)
        plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
        in_short_range = (size >= F.lit(1e-3)) & (size < F.lit(1e7)) | (size == F.lit(0.0))
        in_plain_range = (size >= F.lit(1e-4)) & (size < F.lit(1e16))
        return (
            F.when(in_short_range, c.cast("string"))
            .when(in_plain_range, plain)
            .otherwise(c.cast("string"))
        )
    if isinstance(t, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def exact_text(c: Column, t: T.DataType) -> Column:
    """Text that only equal values of one type share: all digits of a fraction, and one zero."""
    return F.when(c == 0, "0.0").otherwise(c.cast("string")) if is_fraction(t) else as_text(c, t)


def number_key(text: Column) -> Column:
    """One text per number, whatever its type, length or notation: sign, digits and power of ten; NULL for other texts.

    Digits are moved as text, so ``1200``, ``1.2E3`` and ``01200.0`` agree and numbers of any length keep every digit.
    """
    part = lambda i: F.regexp_extract(text, NUMBER_PARTS, i)
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    shown = F.rtrim(digits, F.lit("0"))
    power = F.when(part(4) == "", 0).otherwise(part(4).try_cast("long")) - F.length(part(3)) + F.length(digits) - F.length(shown)
    key = F.when(shown == "", "0").otherwise(F.concat(F.when(part(1) == "-", "-").otherwise(""), shown, F.lit("e"), power.cast("string")))
    return F.when(text.rlike(NUMBER_SHAPE), key)


def to_number(text: Column) -> Column:
    """Number in a text, NULL for any other text; the shape test is cheaper than a failing cast."""
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def numeric_text(c: Column, t: T.DataType) -> Column:
    """Text under which ``1`` and ``1.0`` are the same key."""
    text = as_text(c, t)
    return F.regexp_replace(text, r"\.0$", "") if is_fraction(t) else text


def normalise_key(c: Column, case_sensitive: bool, ignore_special: bool) -> Column:
    if not case_sensitive:
        c = F.upper(c)
    if ignore_special:
        c = F.regexp_replace(c, NOT_ALPHANUMERIC, "")
    return c


def group_id(*columns: Column) -> Column:
    """One text per distinct key tuple; full text forms, so timestamps keep their microseconds."""
    return F.to_json(F.struct(*[c.cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))
