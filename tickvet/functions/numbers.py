"""Numbers as text: the shortest decimal that reads back as the same double, and rounding of the exact binary value.

Column expressions only. Spark's round and format_string look at a double's decimal text (2.675 becomes 2.68); fixed_text
looks at the binary value (2.674999..., so 2.67). null stays null; NaN and infinities are `NaN`, `Infinity`, `-Infinity`;
minus zero is `0` as a number, and `-0.00` never occurs. Below 2.3e-308 a text may have more digits than it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134_217_729.0  # 2^27 + 1: cuts a double's 53 bits into halves whose products are exact
MOST_DIGITS = 7  # 10^7 has fewer than 26 bits, so half a double times it is exact


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _special(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")


def _plain(parts: Column) -> Column:
    """Digits and exponent (of the first digit) as text: plain from 1e-6 to below 1e21, else with an exponent."""
    digits, k = parts["digits"], parts["exponent"] + 1
    m, tail = F.length(digits), lambda start: F.substr(digits, start, F.lit(40))
    power = F.concat(F.when(k > 0, "e+").otherwise("e-"), F.abs(k - 1).cast("string"))
    return (
        F.when(m == 0, "0")
        .when((k >= m) & (k <= 21), F.concat(digits, F.repeat(F.lit("0"), k - m)))
        .when((k > 0) & (k <= 21), F.concat(F.substr(digits, F.lit(1), k), F.lit("."), tail(k + 1)))
        .when((k > -6) & (k <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -k), digits))
        .when(m == 1, F.concat(digits, power))
        .otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), tail(F.lit(2)), power))
    )


def number_text(x: Column | str) -> Column:
    """The shortest text of a double, `100` rather than `100.0`."""

    def shortest(v: Column) -> Column:
        # Older Java prints a digit too many at times; 15 or 16 digits are taken if they read back as the same number.
        tries = [F.format_string(f"%.{n}e", v) for n in (14, 15, 16)]
        return F.when(tries[0].cast("double") == v, tries[0]).when(tries[1].cast("double") == v, tries[1]).otherwise(tries[2])

    def text(v: Column) -> Column:
        cut = lambda s: F.struct(F.rtrim(F.regexp_replace(F.substring_index(s, "e", 1), "[.]", ""), F.lit("0")).alias("digits"), F.substring_index(s, "e", -1).cast("int").alias("exponent"))
        return F.coalesce(_special(v), F.concat(F.when(v < 0, "-").otherwise(""), let(shortest(F.abs(v)), lambda s: let(cut(s), _plain))))

    return let(_double(x), lambda v: F.when(v.isNotNull(), text(v)))


def _double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _nearest(a: Column, scale: Column) -> Column:
    """The whole number nearest to a * scale, the larger of two as near; a is not negative, the product below 2^53."""
    # a * scale is p + error exactly: the product of halves.
    high = _SPLIT * a - (_SPLIT * a - a)
    p = a * scale
    error = (high * scale - p) + (a - high) * scale
    return F.floor(p) + F.when(((p - F.floor(p)) - 0.5) + error >= 0, 1).otherwise(0)


def fixed_text(x: Column | str, digits: Column | int) -> Column:
    """x with so many digits (0 to 7) after the point: the nearest to the exact binary value, the larger amount of two as near.

    From 1e18 on it is the number's shortest text.
    """
    n = F.lit(digits) if isinstance(digits, int) else digits

    def text(v: Column, scale: Column) -> Column:
        whole = F.floor(F.abs(v))

        def joined(f: Column) -> Column:
            over = f >= scale
            body = F.concat((whole + F.when(over, 1).otherwise(0)).cast("string"), F.when(n > 0, F.concat(F.lit("."), F.lpad(F.when(over, 0).otherwise(f).cast("string"), n, F.lit("0")))).otherwise(""))
            return F.concat(F.when((v < 0) & ((whole > 0) | (f > 0)), "-").otherwise(""), body)

        return let(_nearest(F.abs(v) - whole, scale), joined)

    big = lambda v: F.isnan(v) | (F.abs(v) >= 1e18)
    return let(_double(x), lambda v: F.when(v.isNull(), None).when(big(v), number_text(v)).otherwise(text(v, F.pow(F.lit(10.0), n))))


def scaled(x: Column | str, digits: int) -> Column:
    """x rounded as DuckDB's round(): the product with 10^digits, as a double, to the nearest whole number, halves away from zero.

    Spark's round looks at the decimal text instead: of 32.3 / 64.0 (0.5046875, the product 504687.49999999994) it makes 0.504688.
    """
    scale = F.lit(10.0**digits)
    # From 2^53 on doubles are whole, so a product that overflows belongs to a number that stays.
    return let(_double(x), lambda v: F.when(F.abs(v * scale) < float("inf"), F.round(v * scale) / scale).otherwise(v))


def fixed(x: Column | str, digits: int) -> Column:
    """The double next to fixed_text()."""
    scale = F.lit(10.0**digits)

    def rounded(v: Column) -> Column:
        near = _nearest(F.abs(v), scale) / scale
        # Doubles from 2^53 / scale on are so far apart that they are their own nearest; so are NaN and infinities.
        return F.when(F.abs(v) < 9e15 / 10.0**digits, F.when(v < 0, F.lit(0.0) - near).otherwise(near)).otherwise(v)

    return let(_double(x), rounded)
