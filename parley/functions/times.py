"""ISO-8601 text to naive timestamps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Dates and times in the extended and the basic form, hours and below optional, no offset.
DATE, BASIC_DATE = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})(\d{2})(\d{2})"
TIME, BASIC_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?", r"(\d{2})(\d{2})(\d{2}(?:\.\d{1,6})?)?"


def from_iso(text: Column) -> Column:
    """Naive timestamp, or NULL when the text is not one.

    The forms are a whole date, alone or with a time behind ``T`` or a blank. Shortened dates,
    padded texts and times with an offset, which are not naive, are NULL.
    """
    spread = F.regexp_replace(text, rf"^{BASIC_DATE}(?=$|[T ])", "$1-$2-$3")
    spread = F.regexp_replace(spread, rf"(?<=[T ]){BASIC_TIME}$", "$1:$2:$3")
    spread = F.regexp_replace(spread, r":$", "")
    # The cast wants minutes behind an hour.
    spread = F.regexp_replace(spread, r"([T ]\d{2})$", "$1:00")
    whole = spread.rlike(rf"^{DATE}(?:[T ]{TIME})?$") & ~text.rlike(r"[:\s]$")
    return F.when(whole, spread.try_cast("timestamp_ntz"))


def to_iso(timestamp: Column) -> Column:
    """ISO text; the fraction appears only when there is one, always with six digits."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(timestamp, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
