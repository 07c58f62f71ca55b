"""Streamed answers as tables: whole and running text from chunks, and display updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.skew import BLOCK, MAX_GROUP_ROWS, largest_group, range_blocks
from parley.schemas import COOLDOWN_MS

CHUNKS_PER_PART = 65_536


def with_part(chunks: DataFrame, chunks_per_part: int) -> DataFrame:
    return chunks.withColumn("part", F.expr(f"seq div {chunks_per_part}"))


def assemble_responses(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """The text of each response, with chunk count and whether its last chunk has arrived.

    Chunks are joined within parts first and the parts then, so a response of very many
    chunks is sorted by many tasks; only its finished text meets in one row.
    """
    parts = (
        with_part(chunks, chunks_per_part)
        .groupBy("response_id", "part")
        .agg(
            joined("seq", "content").alias("text"),
            F.count(F.lit(1)).alias("chunks"),
            F.bool_or("stop").alias("complete"),
        )
    )
    return parts.groupBy("response_id").agg(
        joined("part", "text").alias("response"),
        F.sum("chunks").alias("chunks"),
        F.bool_or("complete").alias("complete"),
    )


def joined(order: str, text: str) -> Column:
    """Aggregate: the texts of a group joined in order."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(text).alias("text"))))
    return F.array_join(F.transform(pieces, lambda piece: piece["text"]), "")


def text_ends(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Each chunk with ``end``: how long its response's text is up to and including it.

    Linear in the chunks. Lengths are summed within parts, and each part is lifted by the
    parts before it, so no task walks a whole response.
    """
    parted = with_part(chunks, chunks_per_part).withColumn("size", F.length("content").cast("bigint"))
    parts = parted.groupBy("response_id", "part").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("response_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = parts.select("response_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("lift"))
    within = Window.partitionBy("response_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = parted.withColumn("within", F.sum("size").over(within)).join(lifts, ["response_id", "part"])
    return ends.select("response_id", "seq", "content", (F.col("lift") + F.col("within")).alias("end"))


def running_responses(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Each chunk with the response text up to and including it, from the first chunk on."""
    whole = assemble_responses(chunks, chunks_per_part).select("response_id", F.col("response").alias("whole"))
    found = text_ends(chunks, chunks_per_part).join(whole, "response_id")
    return found.select("response_id", "seq", "content", F.left("whole", F.col("end").cast("int")).alias("response"))


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """The raw chunks passed through. Works on streams too."""
    return chunks.select("response_id", "seq", "content")


def throttle_updates(
    updates: DataFrame, cooldown_ms: int = COOLDOWN_MS, max_group: int = MAX_GROUP_ROWS
) -> DataFrame:
    """The display actions for ``updates``, at most one edit per cooldown and reply chain.

    Input: reply_id, ts, seq, message, new_message, end_of_message,
    end_of_response, and started_ts (when the placeholder was shown, or NULL). A
    new message is always a reply. Other updates become an edit if their text is
    not blank and the message ends or the cooldown since the last edit is over.
    The end of the response is always one more, final edit.

    Whether a row is an edit depends on the last edit before it, which no window
    frame expresses, so rows pass through a sorted scan that keeps one time per
    reply. A reply with more than ``max_group`` rows is cut into blocks: each
    block first reports which last edit it would leave behind, the reports are
    chained, and then all blocks are scanned at once.
    """
    updates = updates.withColumn("may_edit", may_edit())
    if largest_group(updates, ["reply_id"]) <= max_group:
        group = ["reply_id"]
        placed = updates.withColumn("entry_us", micros("started_ts"))
        placed = placed.repartition(*group)
    else:
        group = ["reply_id", BLOCK]
        ranged = range_blocks(updates, ["reply_id"], ["ts", "seq"])
        # Only the first and last reply of a block can reach into another one, so
        # there are at most two entries per block.
        entries = F.broadcast(_block_entries(ranged, cooldown_ms))
        start = F.when(F.col("chained"), F.col("entry")).otherwise(micros("started_ts"))
        placed = ranged.join(entries, group, "left").withColumn("entry_us", start)
        placed = placed.repartition(*group)
    shown = ["reply_id", "seq", "ts", "message", "new_message", "end_of_response"]
    scanned = placed.sortWithinPartitions(*group, "ts", "seq").select(
        *shown, *group[1:], "end_of_message", "may_edit", "entry_us", micros("ts").alias("ts_us")
    )
    schema = scanned.select(*shown, F.lit(True).alias("edit")).schema
    return display_actions(
        scanned.mapInPandas(_edit_marker(group, cooldown_ms * 1000, shown), schema)
    )


def display_actions(marked: DataFrame) -> DataFrame:
    """One row per action of an update: reply, edit and final, as far as they apply."""
    return marked.select("reply_id", "seq", "ts", "message", F.explode(action_list()).alias("action"))


def action_list() -> Column:
    """The actions of an update whose edits have been marked."""
    return F.array_compact(
        F.array(
            F.when(F.col("new_message"), "reply"),
            F.when(F.col("edit"), "edit"),
            F.when(F.col("end_of_response"), "final"),
        )
    )


def may_edit() -> Column:
    return ~F.col("new_message") & (F.length(F.regexp_replace("message", r"\s", "")) > 0)


def micros(column: str) -> Column:
    """Microseconds of a naive time, for exact differences."""
    time = F.col(column)
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    micros = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    days = F.unix_date(time.cast("date")).cast("bigint")
    return days * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + micros


def mark_edits(
    may: list[bool], ends: list[bool], times: list[int], last: int | None, cooldown: int
) -> tuple[list[bool], int | None]:
    """Which updates of one reply, in order, become edits, and when the last one was."""
    edits = []
    for allowed, end, time in zip(may, ends, times):
        edit = allowed and (end or last is None or time - last >= cooldown)
        edits.append(edit)
        last = time if edit else last
    return edits, last


def _edit_marker(group: list[str], cooldown: int, shown: list[str]):
    """Scan sorted rows, carrying the last edit of a reply from batch to batch."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            keys = batch[group].to_numpy()
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            may, ends, times = [batch[n].tolist() for n in ("may_edit", "end_of_message", "ts_us")]
            entries, edits = batch["entry_us"].tolist(), []
            for start, stop in zip(starts, [*starts[1:], len(batch)] if len(batch) else []):
                if current is None or (keys[start] != current).any():
                    current, entry = keys[start], entries[start]
                    last = None if pd.isna(entry) else int(entry)
                part = slice(start, stop)
                found, last = mark_edits(may[part], ends[part], times[part], last, cooldown)
                edits += found
            yield batch[shown].assign(edit=edits)

    return mark


def _block_entries(ranged: DataFrame, cooldown_ms: int) -> DataFrame:
    """For replies in several blocks: per block the time of the last edit before it, or NULL."""
    cooldown = cooldown_ms * 1000
    spanning = (
        ranged.select("reply_id", BLOCK)
        .distinct()
        .groupBy("reply_id")
        .agg(F.count(F.lit(1)).alias("blocks"))
        .filter("blocks > 1")
    )
    narrow = ranged.join(F.broadcast(spanning), "reply_id", "left_semi").select(
        "reply_id",
        BLOCK,
        micros("ts").alias("us"),
        "seq",
        "may_edit",
        "end_of_message",
        micros("started_ts").alias("started"),
    )
    exits = narrow.groupBy("reply_id", BLOCK).applyInPandas(
        lambda rows: _exits(rows, cooldown),
        f"reply_id bigint, {BLOCK} int, started bigint, upto bigint, leaves bigint",
    )
    chained = exits.repartition("reply_id").sortWithinPartitions("reply_id", BLOCK, "upto")
    return chained.mapInPandas(
        lambda batches: _chain(batches, cooldown),
        f"reply_id bigint, {BLOCK} int, entry bigint, chained boolean",
    )


FOREVER, NEVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _exits(rows: pd.DataFrame, cooldown: int) -> pd.DataFrame:
    """What a block leaves behind: if edits are due from ``upto`` or earlier, ``leaves``.

    Rows are in rising order of ``upto``; later due times pass the block unchanged.
    """
    first = rows.iloc[0]
    rows = rows[rows["may_edit"]].sort_values(["us", "seq"])
    times, forced = rows["us"].to_numpy(), rows["end_of_message"].to_numpy(dtype=bool)
    count = len(times)
    leaves = times.copy()
    following = np.searchsorted(times, times + cooldown, side="left")
    next_forced = np.full(count, count)
    ahead = count
    for at in range(count - 1, -1, -1):
        next_forced[at] = ahead
        if forced[at]:
            ahead = at
    # With cooldown 0 the next edit may share the time, but it is always a later row.
    following = np.minimum(np.maximum(following, np.arange(count) + 1), next_forced)
    for at in range(count - 1, -1, -1):
        if following[at] < count:
            leaves[at] = leaves[following[at]]
    upto = times.copy()
    if ahead < count:
        times, leaves, upto = times[: ahead + 1], leaves[: ahead + 1], upto[: ahead + 1]
        upto[-1] = FOREVER
    started = None if pd.isna(first["started"]) else int(first["started"])
    pieces = pd.DataFrame({"upto": upto, "leaves": leaves}).drop_duplicates("upto")
    # Of a run that leaves the same time behind, the last says it all.
    pieces = pieces[pieces["leaves"].ne(pieces["leaves"].shift(-1))]
    if pieces.empty:
        pieces = pd.DataFrame({"upto": [NEVER], "leaves": [0]})
    return pd.DataFrame(
        {
            "reply_id": first["reply_id"],
            BLOCK: first[BLOCK],
            "started": pd.array([started] * len(pieces), "Int64"),
            "upto": pieces["upto"].to_numpy(),
            "leaves": pieces["leaves"].to_numpy(),
        }
    )


def _chain(batches: Iterator[pd.DataFrame], cooldown: int) -> Iterator[pd.DataFrame]:
    """Walk the blocks of each reply in order, keeping one time, and report each entry."""
    reply, block, last, found = None, None, None, True
    for batch in batches:
        out = []
        columns = [batch[name].tolist() for name in ("reply_id", BLOCK, "started", "upto", "leaves")]
        for reply_id, number, started, upto, leaves in zip(*columns):
            if reply_id != reply:
                reply, block = reply_id, None
                last = None if pd.isna(started) else int(started)
            if number != block:
                block, found = number, False
                out.append((reply_id, number, last))
                due = None if last is None else last + cooldown
            if not found and upto != NEVER and (due is None or upto >= due):
                found, last = True, leaves
        frame = pd.DataFrame(out, columns=["reply_id", BLOCK, "entry"])
        yield frame.astype({"entry": "Int64"}).assign(chained=True)
