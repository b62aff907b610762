"""Regular expressions with Unicode classes and line ends at ``\\n`` only, and empty matches as nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    return f"(?{flags}Ud){pattern}"


def found(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The group of the first match; null where nothing matched or the group is empty."""
    return F.nullif(F.regexp_extract(text, rx(pattern, flags), group), F.lit(""))


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def sub(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), replacement)


#: The characters that Unicode calls white space, as ``\s`` of ``rx`` matches them.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def number(text: Column) -> Column:
    return text.try_cast("int")


#: More items than an array can hold.
ALL = (1 << 31) - 100


def rest(items: Column, start: int = 2) -> Column:
    """The items from the ``start``-th on, however many there are."""
    return F.slice(items, start, ALL)


def one(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nothing(kind: str) -> Column:
    return F.expr("array()").cast(f"array<{kind}>")
