"""Appending and deleting messages while each user's positions stay 0..n-1."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.lookups import is_known_role, next_positions
from parley.operators.skew import MAX_GROUP_ROWS, global_sequence, largest_group, ordered_positions
from parley.operators.users import create_missing
from parley.session import durable

# Deleted positions are kept per run of this many positions, so no array or
# group grows beyond it however long a history is.
BLOCK_POSITIONS = 1024
# Position requests of one user that are resolved in one scan.
REQUESTS_PER_ROUND = 5_000_000


class Appended(NamedTuple):
    users: DataFrame
    messages: DataFrame
    added: DataFrame
    rejected: DataFrame


class Deleted(NamedTuple):
    messages: DataFrame
    status: DataFrame


def append_messages(
    users: DataFrame,
    messages: DataFrame,
    new: DataFrame,
    create_users: bool = True,
    default_prompt: str = "",
    max_group: int = MAX_GROUP_ROWS,
) -> Appended:
    """Append ``new(user_id, role, message, timestamp, arrival[, id])`` in order of arrival.

    ``arrival`` is unique. A NULL timestamp becomes the load time. Without an
    ``id`` column, ids continue behind the largest stored one. Unknown users are
    created, or their rows rejected, like rows with an unknown role.
    """
    user_ids = users.select(F.col("id").alias("user_id"))
    known = is_known_role(F.col("role"))
    good, rejected = new.filter(known), new.filter(~known)
    if create_users:
        users = create_missing(users, good.select(F.col("user_id").alias("id")), default_prompt)
    else:
        rejected = rejected.unionByName(good.join(user_ids, "user_id", "left_anti"))
        good = good.join(user_ids, "user_id", "left_semi")
    added = place_messages(messages, good, max_group)
    return Appended(users, messages.unionByName(added), added, rejected)


def place_messages(
    messages: DataFrame,
    new: DataFrame,
    max_group: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Give ``new`` rows their positions behind the stored ones, and ids if they have none."""
    if "id" not in new.columns:
        # Ids below zero are those of turns.
        highest = messages.agg(F.greatest(F.max("id"), F.lit(0))).scalar()
        numbered = global_sequence(new, ["arrival"], "_number")
        new = numbered.withColumn("id", highest + F.col("_number") + 1)
    ranked = ordered_positions(new, ["user_id"], ["arrival"], "_rank", max_group, largest)
    starts = next_positions(messages, new.select("user_id").distinct())
    return (
        ranked.join(starts, "user_id")
        .withColumn("position", F.col("next_position") + F.col("_rank"))
        .withColumn("timestamp", F.coalesce("timestamp", F.localtimestamp()))
        .select(*messages.columns)
    )


def delete_messages(messages: DataFrame, requests: DataFrame) -> Deleted:
    """Delete the messages of ``requests(id, arrival)`` and close the gaps.

    ``deleted`` is true for the first request of an existing message only.
    """
    # Narrow, at most one row per request, and read for the status, the blocks and the users.
    doomed = durable(
        messages.select("id", "user_id", "position").join(
            requests.select("id"), "id", "left_semi"
        )
    )
    first = (
        requests.groupBy("id")
        .agg(F.min("arrival").alias("arrival"))
        .join(doomed.select("id"), "id", "left_semi")
        .withColumn("deleted", F.lit(True))
    )
    status = (
        requests.select("id", "arrival")
        .join(first, ["id", "arrival"], "left")
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    )
    return Deleted(close_gaps(messages, doomed), status)


def close_gaps(messages: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop the rows of ``doomed(id, user_id, position)`` and renumber what follows them.

    The messages themselves are neither sorted nor windowed. Each is joined, on
    user and block of positions, to the deletions in its block and the count of
    earlier ones: a broadcast when few users are touched, else a shuffle in which
    a long history spreads over its blocks.
    """
    by_block = (
        doomed.withColumn("block", _block())
        .groupBy("user_id", "block")
        .agg(F.collect_list(F.struct("position", "id")).alias("gone"))
    )
    last_blocks = (
        messages.select("user_id", "position")
        .join(doomed.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.max(_block()).alias("last_block"))
    )
    return (
        messages.withColumn("block", _block())
        .join(_shifts(by_block, last_blocks), ["user_id", "block"], "left")
        .filter(~F.coalesce(F.exists("gone", lambda d: d["id"] == F.col("id")), F.lit(False)))
        .withColumn("position", F.col("position") - F.coalesce(_gone_before(), F.lit(0)))
        .select(*messages.columns)
    )


def _block() -> Column:
    return F.expr(f"position div {BLOCK_POSITIONS}")


def _gone_before() -> Column:
    here = F.size(F.filter("gone", lambda d: d["position"] < F.col("position")))
    return F.col("before") + F.when(F.col("gone").isNotNull(), here).otherwise(0)


def _shifts(by_block: DataFrame, last_blocks: DataFrame) -> DataFrame:
    """One row per touched block or later one of the same user.

    The running count is over blocks, a thousandth of the rows of a history.
    """
    order = Window.partitionBy("user_id").orderBy("block")
    counted = (
        by_block.withColumn("total", F.sum(F.size("gone")).over(order))
        .withColumn("next_block", F.lead("block").over(order))
        .join(last_blocks, "user_id")
    )
    until = F.coalesce(F.col("next_block") - 1, F.col("last_block"))
    reach = F.sequence(F.col("block"), F.greatest(until, F.col("block")))
    spread = counted.select("user_id", "gone", "total", "block", F.explode(reach).alias("b"))
    own = F.col("b") == F.col("block")
    return spread.select(
        "user_id",
        F.col("b").alias("block"),
        F.when(own, F.col("gone")).alias("gone"),
        F.when(own, F.col("total") - F.size("gone")).otherwise(F.col("total")).alias("before"),
    )


def delete_by_position(
    messages: DataFrame,
    requests: DataFrame,
    per_round: int = REQUESTS_PER_ROUND,
    max_group: int = MAX_GROUP_ROWS,
) -> Deleted:
    """Delete by ``requests(user_id, position, arrival)``, each seeing the effect of earlier ones.

    The requests, three numbers each, are scanned in order; the messages are
    only read for their count and rewritten once. A user with more than
    ``per_round`` requests is served in rounds, each on the outcome of the last.
    """
    largest = largest_group(requests, ["user_id"])
    if largest <= per_round:
        return _delete_round(messages, requests)
    ranked = ordered_positions(requests, ["user_id"], ["arrival"], "_rank", max_group, largest)
    ranked = durable(ranked.withColumn("_round", F.expr(f"_rank div {per_round}")))
    statuses = []
    for number in range(-(-largest // per_round)):
        step = _delete_round(messages, ranked.filter(F.col("_round") == number))
        messages = durable(step.messages)
        statuses.append(step.status)
    return Deleted(messages, reduce(DataFrame.unionByName, statuses))


def _delete_round(messages: DataFrame, requests: DataFrame) -> Deleted:
    lengths = next_positions(messages, requests.select("user_id").distinct())
    scanned = (
        requests.join(lengths, "user_id")
        .repartition("user_id")
        .sortWithinPartitions("user_id", "arrival")
        .select("user_id", "arrival", "position", "next_position")
    )
    resolved = durable(
        scanned.mapInPandas(
            _resolve, "user_id bigint, arrival bigint, position bigint, original bigint"
        )
    )
    hits = resolved.filter("original IS NOT NULL")
    hits = hits.select("user_id", F.col("original").alias("position"))
    narrow = messages.select("id", "user_id", "position")
    doomed = durable(narrow.join(hits, ["user_id", "position"], "left_semi"))
    deleted = F.col("original").isNotNull().alias("deleted")
    status = resolved.select("user_id", "arrival", "position", deleted)
    return Deleted(close_gaps(messages, doomed), status)


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Find the original position each request hits, for rows sorted by user and arrival."""
    user, removals = None, None
    for batch in batches:
        users = batch["user_id"].to_numpy()
        starts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist()]
        found = []
        for start, stop in zip(starts, [*starts[1:], len(batch)] if len(batch) else []):
            if users[start] != user:
                user, removals = users[start], Removals(int(batch["next_position"].iloc[start]))
            found += removals.resolve(batch["position"].iloc[start:stop].tolist())
        batch = batch[["user_id", "arrival", "position"]]
        yield batch.assign(original=pd.array(found, "Int64"))


class Removals:
    """Original places of the items removed from a list, one after the other.

    Recent removals are kept in a short sorted list, in the coordinates the list
    had when that began; older ones in a sorted array it is merged into.
    """

    RECENT = 4096

    def __init__(self, length: int) -> None:
        self.length = length
        self.older = np.empty(0, dtype=np.int64)
        self.recent: list[int] = []

    def resolve(self, positions: list[int]) -> list[int | None]:
        """The original place of each position removed in turn; None where there is none."""
        found: list[int | None] = []
        for start in range(0, len(positions), self.RECENT):
            places = [self._remove(p) for p in positions[start : start + self.RECENT]]
            found += self._original(places)
            if len(self.recent) >= self.RECENT:
                merged = [*self.older.tolist(), *self._original(self.recent)]
                self.older, self.recent = np.sort(np.array(merged, dtype=np.int64)), []
        return found

    def _remove(self, position: int) -> int | None:
        if not 0 <= position < self.length:
            return None
        low, high = 0, len(self.recent)
        while low < high:
            middle = (low + high) // 2
            if self.recent[middle] - middle <= position:
                low = middle + 1
            else:
                high = middle
        self.recent.insert(low, position + low)
        self.length -= 1
        return position + low

    def _original(self, places: list[int | None]) -> list[int | None]:
        if not len(self.older):
            return places
        hits = np.array([place for place in places if place is not None], dtype=np.int64)
        gaps = self.older - np.arange(len(self.older))
        moved = iter((hits + np.searchsorted(gaps, hits, side="right")).tolist())
        return [None if place is None else next(moved) for place in places]


def clear_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages without the histories of ``users(user_id)``."""
    return messages.join(users.select("user_id"), "user_id", "left_anti")
