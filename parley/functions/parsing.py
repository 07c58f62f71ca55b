"""Raw text to typed settings: the number and boolean spellings that count as valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings. Digits may carry single underscores between them.
INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
DOUBLE = (
    r"^\s*[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")


def parse_bool(raw: Column) -> Column:
    """True, false, or NULL for anything else. Blanks are not trimmed."""
    word = F.lower(raw)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[_\s]", "")


def parse_integer(raw: Column) -> Column:
    """64-bit integer, or NULL; '5.0' and numbers out of range are refused."""
    return F.when(raw.rlike(INTEGER), _digits(raw).try_cast("bigint"))


def parse_double(raw: Column) -> Column:
    """Double, NaN included, or NULL; '1d' is refused."""
    return F.when(raw.rlike(DOUBLE), _digits(raw).try_cast("double"))


def stored_double(value: Column) -> Column:
    """What the store keeps of a valid double: NaN becomes NULL."""
    return F.when(~F.isnan(value), value)
