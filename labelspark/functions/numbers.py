"""Number helpers: rounding, lenient parsing and printing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: halves go up, also below zero."""
    factor = float(10**digits)
    return F.floor(value.cast("double") * factor + 0.5) / F.lit(factor)


def round_half_away(value: Column, digits: int = 2) -> Column:
    """Fixed-digit rounding that is symmetric around zero (as when a number is printed)."""
    factor = float(10**digits)
    magnitude = F.floor(F.abs(value.cast("double")) * factor + 0.5) / F.lit(factor)
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def fixed(value: Column, precision: int, scale: int) -> Column:
    """An exact decimal, zero where there is no value."""
    kind = f"decimal({precision},{scale})"
    return F.coalesce(value.cast(kind), F.lit(0).cast(kind))


def ratio_half_up(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` to ``digits`` digits, halves away from zero, exactly; NULL for a denominator of zero.

    Both are decimals of the same scale.  The quotient is never rounded twice: whole hundredths (say) are cut off by remainder, and
    half a denominator has been added before.
    """
    whole = "decimal(38,0)"
    top, bottom = F.abs(numerator).cast("decimal(38,6)"), F.nullif(F.abs(denominator).cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    million = F.lit(10**6).cast("decimal(7,0)")
    x = (2 * 10**digits * (top * million).cast(whole) + (bottom * million).cast(whole)).cast(whole)
    y = (2 * (bottom * million).cast(whole)).cast(whole)
    steps = ((x - x % y) / y).cast(whole)
    sign = F.when((numerator < 0) != (denominator < 0), -1).otherwise(1)
    return (sign * steps * F.lit(f"1e-{digits}").cast(f"decimal({digits + 1},{digits})")).cast(f"decimal({34},{digits})")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def leading_number(text: Column) -> Column:
    """The number a text starts with, else NULL: ``12abc`` gives 12."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def leading_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def plain_number(value: Column) -> Column:
    """A decimal printed without trailing zeros: 40.00 gives ``40``, 60.50 gives ``60.5``."""
    text = value.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
