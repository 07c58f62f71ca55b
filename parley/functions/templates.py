"""Chat templates: how one message is rendered, and what is measured on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A prompt is ``start`` + rendered messages + ``generation`` if a user spoke last.

    ``before`` and ``after`` surround a message and may name its role as ``{role}``.
    """

    start: str
    before: str
    after: str
    generation: str

    def render(self, role: Column, message: Column) -> Column:
        return F.concat(_with_role(self.before, role), message, _with_role(self.after, role))


# Two public prompt formats.
CHATML = ChatTemplate("", "<|im_start|>{role}\n", "<|im_end|>\n", "<|im_start|>assistant\n")
PLAIN = ChatTemplate("", "{role}: ", "\n", "assistant: ")

def _with_role(text: str, role: Column) -> Column:
    pieces = [F.lit(piece) for piece in text.split("{role}")]
    joined = pieces[0]
    for piece in pieces[1:]:
        joined = F.concat(joined, role, piece)
    return joined


def token_estimate(text: Column) -> Column:
    """Words and single symbols. An estimate, not any model's own count.

    Every word shrinks to one letter and blanks go, so the tokens are what is
    left to count; no array of tokens is built.
    """
    words = F.regexp_replace(text, "[A-Za-z0-9_]++", "w")
    return F.length(F.translate(words, " \t\n\r", "")).cast("bigint")
