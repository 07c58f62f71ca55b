"""Response chunks to bounded messages, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import check_limit, cut
from parley.operators.responses import micros
from parley.schemas import LENGTH_LIMIT
from parley.session import use_rocksdb_state

TIME = "_time"
#: Chunks that came early are held in blocks of so many numbers: one look at the state for a block, not for a chunk.
BLOCK = 256
#: Rows of one response that are taken up at a time.
PIECE = 10_000
OUTPUT = T.StructType(
    [
        T.StructField("response_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("started_ts", T.TimestampNTZType()),
        T.StructField("length", T.LongType()),
        T.StructField("message_no", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("end_of_message", T.BooleanType()),
        T.StructField("end_of_response", T.BooleanType()),
        T.StructField("new_message", T.BooleanType()),
        T.StructField("incomplete", T.BooleanType()),
    ]
)


def segment_stream(
    chunks: DataFrame, limit: int = LENGTH_LIMIT, ttl_ms: int | None = None, late_ms: int | None = None
) -> DataFrame:
    """One row per chunk, and one per message it closes, for a stream of chunks.

    A chunk that does not fill the message yields the message so far. One that
    does closes it (``end_of_message``, no chunk) and starts the next
    (``new_message``). When ``stop`` arrives, what is left is cut to the end.
    ``step`` numbers a response's rows, ``length`` is that of the whole response
    so far, ``ts`` the latest time so far and ``started_ts`` the first chunk's.
    State per response is the open message and any chunks that came early, in blocks
    of ``BLOCK`` numbers, never the whole response, and goes with the last chunk.
    Chunks must not be repeated after the stop.

    With ``ttl_ms``, a response that has not stopped is ended once the stream's time
    is that long past its last chunk: chunks held for a missing one are put out in
    order, then a last row with an empty chunk, all of them ``incomplete``. Time is
    that of the chunks, so a replay ends the same responses. Chunks may be late by
    ``late_ms`` (``ttl_ms`` by default), as the stream's time follows that far behind.
    """
    check_limit(limit)
    use_rocksdb_state(chunks.sparkSession)
    narrow = chunks.select("response_id", "seq", "ts", "content", "stop")
    if not ttl_ms:
        return narrow.groupBy("response_id").transformWithState(
            SegmentProcessor(limit, None), OUTPUT, outputMode="Append", timeMode="None"
        )
    # Watermarks need an instant; naive times are taken as UTC.
    timed = narrow.withColumn(TIME, F.timestamp_micros(micros("ts")))
    timed = timed.withWatermark(TIME, f"{ttl_ms if late_ms is None else late_ms} milliseconds")
    found = timed.groupBy("response_id").transformWithState(
        SegmentProcessor(limit, ttl_ms),
        T.StructType([*OUTPUT.fields, T.StructField(TIME, T.TimestampType())]),
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName=TIME,
    )
    return found.drop(TIME)


class OpenMessage:
    """The message being filled, how far the response is, and the rows each chunk gives rise to."""

    def __init__(self, limit: int, text: str, number: int, step: int, length: int, times: tuple) -> None:
        self.limit, self.text, self.number, self.step, self.length = limit, text, number, step, length
        self.ts, self.started = times

    def add(self, seq: int, ts: datetime | None, content: str, stop: bool) -> Iterator[tuple]:
        self.text += content
        self.length += len(content)
        if ts is not None:
            self.ts = ts if self.ts is None else max(self.ts, ts)
            self.started = self.started or ts
        fresh = False
        cutting = cut(self.text, self.limit)
        while cutting is not None:
            yield self._row(seq, cutting[0], None, True, False, fresh)
            self.text, fresh = cutting[2] + self.text[cutting[1] :], True
            self.number += 1
            # One cut per chunk, but the last chunk leaves nothing over the limit.
            cutting = cut(self.text, self.limit) if stop else None
        yield self._row(seq, self.text, content, False, stop, fresh)

    def _row(self, seq: int, message: str, chunk: str | None, ends: bool, stop: bool, fresh: bool) -> tuple:
        self.step += 1
        return seq, self.step - 1, self.ts, self.started, self.length, self.number, message, chunk, ends, stop, fresh


class SegmentProcessor(StatefulProcessor):
    def __init__(self, limit: int, ttl_ms: int | None) -> None:
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState(
            "open",
            "text string, number bigint, step bigint, length bigint, ts timestamp_ntz, started timestamp_ntz, "
            "expected bigint, held bigint, timer bigint",
        )
        self.early = handle.getMapState(
            "early", "block bigint", "chunks array<struct<seq:bigint,ts:timestamp_ntz,content:string,stop:boolean>>"
        )
        self.handle = handle
        self.row = Row(*OUTPUT.names, TIME) if self.ttl_ms else Row(*OUTPUT.names)

    def _stored(self) -> tuple[OpenMessage, int, int, int | None]:
        stored = self.open.get()
        if stored is None:
            return OpenMessage(self.limit, "", 0, 0, 0, (None, None)), 0, 0, None
        text, number, step, length, ts, started, expected, held, timer = stored
        return OpenMessage(self.limit, text, number, step, length, (ts, started)), expected, held, timer

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # Chunks without a response's id are no group: each is taken as it comes.
        for some in ([row] for row in rows) if key[0] is None else [rows]:
            yield from self._arrived(key, iter(some), timerValues)

    def _arrived(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        message, expected, held, timer = self._stored()
        done, latest = False, None
        early = EarlyChunks(self.early, held)
        while piece := list(islice(rows, PIECE)):
            arrived = sorted(((r.seq, r.ts, r.content, r.stop) for r in piece), key=itemgetter(0))
            produced = []
            for seq, ts, content, stop in arrived:
                if ts is not None:
                    latest = ts if latest is None else max(latest, ts)
                if seq > expected:
                    early.hold(seq, ts, content, stop)
                while seq == expected:
                    produced += message.add(seq, ts, content, stop)
                    expected, done = expected + 1, done or stop
                    following = early.take(expected)
                    if following is None:
                        break
                    seq, ts, content, stop = following
            early.store()
            yield from self._rows(key, produced, False, timerValues)
        if done:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.open.clear()
            if early.held:
                self.early.clear()
            return
        if self.ttl_ms and latest is not None:
            due = int(latest.replace(tzinfo=timezone.utc).timestamp() * 1000) + self.ttl_ms
            # Never before what is expected next, as late chunks do not bring the end nearer.
            due = max(due, timerValues.getCurrentWatermarkInMs() + 1, timer or 0)
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            timer = due
        m = message
        self.open.update((m.text, m.number, m.step, m.length, m.ts, m.started, expected, early.held, timer))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        message, expected, held, _ = self._stored()
        produced, last = [], expected - 1
        if held:
            for _, (chunks,) in sorted(self.early.iterator(), key=itemgetter(0)):
                for last, ts, content, _ in chunks:
                    produced += message.add(last, ts, content, False)
            self.early.clear()
        produced += message.add(last, None, "", True)
        self.open.clear()
        # What is put out has the time of the end.
        due = _naive(expiredTimerInfo.getExpiryTimeInMs())
        late = [(seq, step, max(ts or due, due), *rest) for seq, step, ts, *rest in produced]
        yield from self._rows(key, late, True, timerValues)

    def _rows(self, key: tuple, produced: list[tuple], incomplete: bool, timerValues: object) -> Iterator[Row]:
        """Rows with the time that the stream goes by, if it does, which is never behind its watermark."""
        if not self.ttl_ms:
            for one in produced:
                yield self.row(key[0], *one, incomplete)
            return
        now = _naive(timerValues.getCurrentWatermarkInMs())
        for one in produced:
            yield self.row(key[0], *one, incomplete, max(one[2] or now, now).replace(tzinfo=timezone.utc))

    def close(self) -> None:
        pass


class EarlyChunks:
    """The chunks of one response that came before those they follow.

    Blocks are read when a chunk of theirs is asked for or comes, and written once by ``store``, so a
    response costs what its blocks in this batch cost, however its chunks are mixed.
    """

    def __init__(self, state: object, held: int) -> None:
        self.state, self.held = state, held
        self.blocks, self.changed, self.stored = {}, set(), held

    def _block(self, seq: int) -> dict[int, tuple]:
        number = seq // BLOCK
        if number not in self.blocks:
            found = self.state.getValue((number,)) if self.stored else None
            self.blocks[number] = {one[0]: tuple(one) for one in found[0]} if found else {}
        return self.blocks[number]

    def hold(self, seq: int, ts: datetime | None, content: str, stop: bool) -> None:
        block = self._block(seq)
        self.held += seq not in block
        block[seq] = (seq, ts, content, stop)
        self.changed.add(seq // BLOCK)

    def take(self, seq: int) -> tuple | None:
        """The chunk of this number, which is held no longer."""
        found = self._block(seq).pop(seq, None) if self.held else None
        if found is not None:
            self.held -= 1
            self.changed.add(seq // BLOCK)
        return found

    def store(self) -> None:
        for number in self.changed:
            block = self.blocks[number]
            if block:
                self.state.updateValue((number,), ([block[seq] for seq in sorted(block)],))
            elif self.stored:
                self.state.removeKey((number,))
        self.blocks, self.changed, self.stored = {}, set(), self.held


def _naive(ms: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(milliseconds=ms)
