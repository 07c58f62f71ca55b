"""Delivery of streams: batches that may be replayed must not be applied twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def foreach_batch_sink(
    stream: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to ``apply(batch, batch_id)``.

    Runs until the input is used up, or for good in intervals of ``every`` ('10 seconds').
    """
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def to_batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder named by its id; a replay overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
