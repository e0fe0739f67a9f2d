"""Canonical JSON as columns: compact, fields in their order, absent ones left out, numbers as short as they can be read back, few escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exponents at which a number is written with one.
LEAST_PLAIN, LEAST_LARGE = -6, 21


def text(s: Column) -> Column:
    """A string in quotes. Of control characters the five with a letter have theirs, the others four lower-case digits; the two separators that
    end lines in scripts are escaped; bytes that aren't UTF-8 become the replacement character."""
    valid = F.make_valid_utf8(s)
    quoted = F.to_json(F.array(valid))
    quoted = F.substring(quoted, 2, F.length(quoted) - 2)
    lower = quoted
    for digit in "ABCDEF":
        # An escape begins after an even number of backslashes.
        lower = F.regexp_replace(lower, rf"((?<!\\)(?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    odd = valid.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f]")
    out = F.when(odd, lower).otherwise(quoted)
    return F.replace(F.replace(out, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def number(x: Column) -> Column:
    """A whole number as it is; of a double the fewest digits that read back as it, written out between 1e-6 and 1e21."""
    x = x.cast("double")
    tries = F.filter(F.transform(F.array(*(F.format_string(f"%.{p}e", F.abs(x)) for p in range(17))), lambda s: F.when(s.cast("double") == F.abs(x), s)), lambda s: s.isNotNull())
    return F.transform(F.array(F.get(tries, F.lit(0))), lambda s: _laid_out(s, x < 0))[0]


def _laid_out(s: Column, negative: Column) -> Column:
    digits = F.replace(F.substring_index(s, "e", 1), F.lit("."), F.lit(""))
    e = F.substring_index(s, "e", -1).cast("int")
    n = F.length(digits)
    zeros = lambda k: F.expr("''") if k is None else F.repeat(F.lit("0"), k)
    whole = F.when(n <= e + 1, F.concat(digits, zeros(e + 1 - n))).otherwise(F.concat(F.left(digits, e + 1), F.lit("."), F.substring(digits, e + 2, n)))
    small = F.concat(F.lit("0."), zeros(-e - 1), digits)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n)))
    scaled = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.abs(e).cast("string"))
    plain = F.when((e < LEAST_PLAIN) | (e >= LEAST_LARGE), scaled).when(e >= 0, whole).otherwise(small)
    return F.concat(F.when(negative & (digits != "0"), "-").otherwise(""), plain)


def integer(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def flag(x: Column) -> Column:
    return x.cast("string")


def listed(values: Column, one: Callable[[Column], Column]) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ","), F.lit("]"))


def unless(absent: Column, value: Column) -> Column:
    """A field's value, null, which leaves it out, where it is absent."""
    return F.when(~F.coalesce(absent, F.lit(True)), value)


def record(*fields: tuple[str, Column]) -> Column:
    """An object of (name, JSON) in order; fields whose JSON is null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields)), F.lit("}"))


def optional(s: Column) -> Column:
    """text() of a string that is left out where it is empty."""
    return unless(s == "", text(s))


def some(values: Column, one: Callable[[Column], Column]) -> Column:
    """listed() of an array that is left out where it is empty."""
    return unless(F.size(values) == 0, listed(values, one))
