"""Finding and making cuts in long text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
# Where to cut, best first, and how much of the separator stays visible.
SEPARATORS = ("\n", ". ", " ")
KEPT = {"\n": 0, ". ": 1, " ": 0}
SMALLEST_LIMIT = 8


def check_limit(limit: int) -> int:
    if limit < SMALLEST_LIMIT:
        raise ValueError(f"a segment limit below {SMALLEST_LIMIT} cannot hold a fence")
    return limit


def last_index(text: Column, wanted: str) -> Column:
    """0-based index of the last occurrence, NULL if there is none."""
    back = F.instr(F.reverse(text), wanted[::-1])
    return F.when(back > 0, F.length(text) - back - len(wanted) + 1)


def last_separator(
    text: Column, separators: Sequence[str] = SEPARATORS, first: Column | None = None
) -> Column:
    """Struct (position, separator) of the first separator, by priority, that occurs after index 0.

    With ``first``, those that begin before that index do not count.
    """
    found = None
    for separator in separators:
        at = last_index(text, separator)
        here = F.struct(at.cast("bigint").alias("position"), F.lit(separator).alias("separator"))
        counts = at > 0 if first is None else (at > 0) & (at >= first)
        found = F.when(counts, here) if found is None else found.when(counts, here)
    return found


def fence_line_end(text: Column) -> Column:
    """Index behind the fence line a text begins with; 0 if there is none or no end of it."""
    return F.when(F.startswith(text, F.lit(FENCE)), F.instr(text, "\n")).otherwise(0)


def fence_open(text: Column) -> Column:
    """Whether a code fence is opened in the text and not closed again."""
    without = F.replace(text, F.lit(FENCE), F.lit(""))
    return (F.length(text) - F.length(without)) % (2 * len(FENCE)) != 0


def plain_cut_pattern(limit: int) -> str:
    """One pattern whose consecutive matches are the segments of a text without fences.

    Alternatives in order: a rest shorter than the limit; up to the last newline,
    sentence end or space of the first ``limit`` characters; a hard cut.
    """
    inner = [rf".{{1,{limit - len(s)}}}{s.replace('.', chr(92) + '.')}" for s in SEPARATORS]
    return "|".join([rf"(?s)(?!.{{{limit}}}).+", *inner, rf".{{{limit}}}"])


def cut(text: str, limit: int, start: int = 0, opening: str = "") -> tuple[str, int, str] | None:
    """Cut one segment off ``opening + text[start:]``, or None if it is short enough.

    Returns the segment, where the rest starts in ``text``, and the fence line
    that reopens a code block in front of that rest. Only ``limit`` characters
    are looked at, so cutting a whole text takes time linear in its length.
    """
    if len(opening) + len(text) - start < limit:
        return None
    window = opening + text[start : start + limit - len(opening)]
    # A fence line in front stays whole, as a cut in it would leave an empty block.
    first = window.find("\n") + 1 if window.startswith(FENCE) else 0
    head, used = window, len(window)
    for separator in SEPARATORS:
        at = window.rfind(separator, first)
        if at > 0:
            head, used = window[: at + KEPT[separator]], at + len(separator)
            break
    reopening = _reopening(head)
    # A cut that gives back as much as it took would never end.
    if reopening is not None and len(reopening) >= used:
        head, used = window, len(window)
        reopening = None if head.count(FENCE) % 2 == 0 else f"{FENCE}\n"
    closed = head if reopening is None else f"{head}\n{FENCE}"
    return closed, start + used - len(opening), reopening or ""


def _reopening(head: str) -> str | None:
    if head.count(FENCE) % 2 == 0:
        return None
    after = head.rfind(FENCE) + len(FENCE)
    end = head.find("\n", after)
    tag = head[after:end] if end >= 0 else ""
    return f"{FENCE}{tag}\n"


def segments(text: str, limit: int) -> list[str]:
    """All segments of a text, fences closed and reopened at every cut."""
    done, start, opening = [], 0, ""
    while (step := cut(text, limit, start, opening)) is not None:
        segment, start, opening = step
        done.append(segment)
    rest = opening + text[start:]
    return [*done, rest] if rest or not done else done
