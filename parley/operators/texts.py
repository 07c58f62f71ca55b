"""Splitting long texts into segments of bounded length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import (
    FENCE,
    KEPT,
    SEPARATORS,
    check_limit,
    fence_line_end,
    fence_open,
    last_index,
    last_separator,
    plain_cut_pattern,
    segments,
)
from parley.schemas import LENGTH_LIMIT


def split_texts(df: DataFrame, text: str, limit: int = LENGTH_LIMIT) -> DataFrame:
    """One row per segment of the column ``text``, with ``segment_no`` and ``segment``.

    Texts without a code fence are cut by one regular expression inside the JVM.
    Fence repair needs state from cut to cut, so only fenced texts cross to
    Python; both ways take time linear in the text.
    """
    check_limit(limit)
    fenced = F.contains(F.col(text), F.lit(FENCE))
    pieces = df.withColumn("_fenced", _fenced_segments(limit)(F.when(fenced, F.col(text))))
    unfenced = F.when(F.col("_fenced").isNull(), F.col(text))
    matches = F.regexp_extract_all(unfenced, F.lit(plain_cut_pattern(limit)), F.lit(0))
    raw = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(matches)
    both = F.coalesce("_fenced", _visible("_raw", limit))
    pieces = pieces.withColumn("_raw", raw)
    kept = [name for name in df.columns if name != text]
    # The outer form, because Spark guards the inner one by a filter that would
    # cut every text a second time.
    found = pieces.select(*kept, F.posexplode_outer(both).alias("number", "segment"))
    number = F.col("number").cast("bigint").alias("segment_no")
    return found.filter("segment IS NOT NULL").select(*kept, number, "segment")


def _visible(raw: str, limit: int) -> Column:
    """Drop the newline or space a cut was made at; a short last piece was not cut."""

    def trim(piece: Column, index: Column) -> Column:
        is_rest = (index == F.size(raw) - 1) & (F.length(piece) < limit)
        cut_at = piece.endswith("\n") | piece.endswith(" ")
        return F.when(~is_rest & cut_at, F.left(piece, F.length(piece) - 1)).otherwise(piece)

    return F.transform(raw, trim)


def _fenced_segments(limit: int):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else segments(text, limit))

    return split


def split_once(df: DataFrame, text: str, limit: int = LENGTH_LIMIT) -> DataFrame:
    """Cut one segment off each text: ``first``, and ``rest`` or NULL if it is short enough."""
    check_limit(limit)
    head, body = F.col("_head"), F.col(text)
    long = F.length(body) >= limit
    found = df.withColumn("_window", F.left(body, F.lit(limit))).withColumn(
        "_at", last_separator(F.col("_window"), SEPARATORS, fence_line_end(F.col("_window")))
    )
    position, separator = F.col("_at.position").cast("int"), F.col("_at.separator")
    shown = F.lit(0)
    for name, count in KEPT.items():
        shown = F.when(separator == name, count).otherwise(shown)
    found = found.select(
        *df.columns,
        "_window",
        F.coalesce(F.left("_window", position + shown), "_window").alias("_head"),
        F.coalesce(position + F.length(separator), F.lit(limit)).alias("_used"),
    )
    after = last_index(head, FENCE) + len(FENCE)
    line = F.substring(head, after + 1, F.length(head))
    end = F.instr(line, "\n")
    tag = F.when(end > 0, F.left(line, end - 1)).otherwise("")
    found = found.withColumn(
        "_open", F.when(fence_open(head), F.concat(F.lit(FENCE), tag, F.lit("\n")))
    )
    stuck = F.coalesce(F.length("_open") >= F.col("_used"), F.lit(False))
    bare = F.when(fence_open(F.col("_window")), F.lit(f"{FENCE}\n"))
    found = found.select(
        *df.columns,
        F.when(stuck, F.col("_window")).otherwise(head).alias("_head"),
        F.when(stuck, F.lit(limit)).otherwise(F.col("_used")).alias("_used"),
        F.when(stuck, bare).otherwise(F.col("_open")).alias("_open"),
    )
    closing = F.when(F.col("_open").isNotNull(), F.lit(f"\n{FENCE}")).otherwise("")
    left_over = F.substring(body, F.col("_used") + 1, F.length(body))
    return found.select(
        *df.columns,
        F.when(long, F.concat(head, closing)).otherwise(body).alias("first"),
        F.when(long, F.concat(F.coalesce("_open", F.lit("")), left_over)).alias("rest"),
    )
