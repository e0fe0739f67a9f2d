"""Text helpers whose rules differ between engines, pinned down once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming; \s in Java is another set.
_WS = r"\p{IsWhite_Space}"


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_WS}+|{_WS}+\z", "")


def empty_to_null(s: Column) -> Column:
    return F.when(s != "", s)


def first_match(s: Column, pattern: str, group: int = 1) -> Column:
    """Null, not '', where nothing matches."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def head_bytes(content: Column, n: int) -> Column:
    return F.substring(content.cast("binary"), 1, n)


def is_usable_identifier(s: Column) -> Column:
    """Not blank, no control characters, no white space."""
    return s.isNotNull() & (s != "") & ~s.rlike(rf"[\p{{Cc}}{_WS}]")
