"""Number coercion, unit conversion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_MB = 1048576.0

# Fixed value: text forms accepted as a number.
_NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_DOUBLE_SPLITTER = 134217729.0  # 2^27 + 1, splits a double into two halves with exact products


def finite(value: Column) -> Column:
    """The double itself, or null when it is null, NaN or infinite."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def text_to_number(text: Column) -> Column:
    """Number held by a text field; blank text is 0, anything unreadable or non-finite is null."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.lit(0.0)).when(
        trimmed.rlike(_NUMBER_TEXT), finite(trimmed.try_cast("double"))
    )


def mb(byte_count: Column) -> Column:
    return byte_count / F.lit(BYTES_PER_MB)


def when_positive(value: Column) -> Column:
    return F.when(value > 0, value)


def percent(part: Column, whole: Column) -> Column:
    """`part` as a percentage of `whole`; null unless `whole` is positive. May exceed 100."""
    return F.when(whole > 0, part * F.lit(100.0) / whole)


def fixed(value: Column, digits: int) -> Column:
    """Round to `digits` decimals by the exact binary value, ties away from zero.

    `round` works on the shortest decimal text instead, so it sends 1.005 to 1.01 although the stored number is
    below the tie. The product with 10^digits is formed exactly here as a rounded product plus its error term.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(value.cast("double"))
    product = size * scale
    high = size * F.lit(_DOUBLE_SPLITTER) - (size * F.lit(_DOUBLE_SPLITTER) - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product).cast("double")
    rounded = whole + F.when((product - whole - F.lit(0.5)) + error >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    # From 2^53 up neighbouring doubles are further apart than the rounding step, so the value is its own rounding.
    return F.signum(value.cast("double")) * F.when(product >= F.lit(2.0**53), size).otherwise(rounded / scale)


def round_half_up(value: Column) -> Column:
    """Nearest integer, ties towards positive infinity."""
    return F.floor(value.cast("double") + F.lit(0.5))


def plain_number_text(value: Column) -> Column:
    """Shortest decimal text: no fraction on whole numbers, exponent form only from 1e21 up or below 1e-6."""
    return place_digits(value.cast("double").cast("string"))


def place_digits(text: Column) -> Column:
    """The same from Spark's own double text, which uses exponent form outside [1e-3, 1e7).

    The digits are re-placed around the point. (Before Java 19 that text can carry a surplus digit from 1e16 up.)
    `text` is used many times: pass a column, not an expression, in hot paths.
    """
    exponent = F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    mantissa = F.regexp_extract(text, "^-?([0-9]+(?:[.][0-9]*[1-9])?)", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    shift = exponent + 1
    large = F.concat(
        F.rpad(F.substring(digits, F.lit(1), shift), shift, "0"),
        F.when(
            F.length(digits) > shift, F.concat(F.lit("."), F.substring(digits, shift + 1, F.length(digits)))
        ).otherwise(""),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(mantissa, F.when(exponent > 0, "e+").otherwise("e-"), F.abs(exponent).cast("string"))
    placed = F.when((exponent >= 21) | (exponent < -6), scientific).when(exponent > 0, large).otherwise(small)
    return F.when(
        F.contains(text, F.lit("E")), F.concat(F.when(text.startswith("-"), "-").otherwise(""), placed)
    ).otherwise(F.regexp_replace(text, "[.]0$", ""))
