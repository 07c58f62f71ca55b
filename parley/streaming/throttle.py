"""Display updates of a stream, limited to one edit per cooldown."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.responses import display_actions, mark_edits, may_edit, micros
from parley.schemas import COOLDOWN_MS
from parley.session import use_rocksdb_state


SHOWN = ["reply_id", "seq", "ts", "message", "new_message", "end_of_response"]


def throttle_stream(
    updates: DataFrame, cooldown_ms: int = COOLDOWN_MS, ttl_ms: int | None = None
) -> DataFrame:
    """The streaming form of ``throttle_updates``; state is the time of a reply's last edit.

    Updates of one reply must arrive in order from batch to batch; inside a batch
    they are sorted, so the size of a micro-batch bounds what is held of a reply.
    State goes with the batch that has the end of the response, as nothing follows
    it. With ``ttl_ms`` a reply without updates for that long is forgotten too.
    """
    return display_actions(mark_stream(updates, cooldown_ms, ttl_ms))


def mark_stream(
    updates: DataFrame, cooldown_ms: int = COOLDOWN_MS, ttl_ms: int | None = None, more: Sequence[str] = ()
) -> DataFrame:
    """The updates with ``edit``, and the columns ``more`` as they came."""
    use_rocksdb_state(updates.sparkSession)
    shown = [*SHOWN, *more]
    prepared = updates.select(
        *shown,
        "end_of_message",
        may_edit().alias("may_edit"),
        micros("started_ts").alias("entry_us"),
        micros("ts").alias("ts_us"),
    )
    schema = T.StructType([prepared.schema[name] for name in shown]).add("edit", T.BooleanType())
    return prepared.groupBy("reply_id").transformWithState(
        ThrottleProcessor(cooldown_ms * 1000, shown, ttl_ms),
        schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


class ThrottleProcessor(StatefulProcessor):
    def __init__(self, cooldown: int, shown: list[str], ttl_ms: int | None) -> None:
        self.cooldown, self.shown, self.ttl_ms = cooldown, shown, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint", self.ttl_ms)
        self.row = Row(*self.shown, "edit")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # Updates without a reply's id are no group: each is judged as it comes.
        for some in ([row] for row in rows) if key[0] is None else [rows]:
            yield from self._judged(some)

    def _judged(self, rows: Iterable[Row]) -> Iterator[Row]:
        # A row without a time comes last, and no cooldown is over for it.
        arrived = sorted(rows, key=lambda r: (r.ts_us is None, r.ts_us or 0, r.seq))
        known = self.last.get()
        last = known[0] if known else arrived[0].entry_us
        times = [math.nan if r.ts_us is None else r.ts_us for r in arrived]
        edit, last = mark_edits([r.may_edit for r in arrived], [r.end_of_message for r in arrived], times, last, self.cooldown)
        if any(r.end_of_response for r in arrived):
            if known:
                self.last.clear()
        elif last is not None and last == last:
            if not known or known[0] != last or self.ttl_ms:
                self.last.update((int(last),))
        places = [arrived[0].__fields__.index(name) for name in self.shown]
        for row, edited in zip(arrived, edit):
            yield self.row(*[row[place] for place in places], edited)

    def close(self) -> None:
        pass
