"""Nearest neighbours by collision counting over single projections (C2LSH and QALSH style).

Vectors are projected on random lines. A block of rows keeps one sorted array per line. A
query opens a window around its own projection on every line; virtual rehashing widens the
windows step by step, and only the newly covered part of an array is counted. A vector that
lies in the windows of enough lines is verified by its exact distance. The search of a block
ends when it holds enough verified neighbours closer than the windows' radius.

Rows and queries are cut into blocks of bounded size, and each pair of blocks is one task's
work, so neither side grows beyond memory; the best of all blocks meet at the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = 96
#: Half width of a window, in units of the radius.
HALF = 1.0
#: Share of a radius's expected collisions that makes a vector a candidate: the lines' chance
#: of a collision at the radius, less this many standard deviations.
SLACK = 1.7
GROWTH = 1.08
ROW_BLOCK, QUERY_BLOCK = 16_384, 1024
SEED = 8


def neighbours(vectors: DataFrame, count: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each query by Euclidean distance.

    ``vectors`` has vec_id and embedding. Queries are the rows whose vec_id is divisible by
    ``every``; a query's own id is no candidate. Ties go to the smaller vec_id. Vectors that
    are null, zero, empty or hold a null or non-finite component, and rows without an id, take
    no part; vectors of different lengths are not compared. Of rows that repeat an id, the
    nearest one counts; a repeated query id searches once, with its least vector.
    """
    usable = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).filter(_usable("vector") & F.col("vec_id").isNotNull())
    usable = usable.withColumn("size", F.size("vector"))
    queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "size").agg(F.min("vector").alias("vector"))
    sizes = usable.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    row_blocks, query_blocks = -(-sizes[0] // ROW_BLOCK) or 1, -(-sizes[1] // QUERY_BLOCK) or 1
    pair = ["size", "row_block", "query_block"]
    rows = usable.withColumn("row_block", _block("vec_id", row_blocks)).withColumn("query_block", _each(query_blocks))
    asked = queries.withColumn("query_block", _block("vec_id", query_blocks)).withColumn("row_block", _each(row_blocks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _searched(_matrix(left), _ids(left), _matrix(right), _ids(right), count)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(NAMES, found, KINDS)})

    near = rows.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = near.withColumn("rank", rank).filter(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")


NAMES, KINDS = ("query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.float64())


def _usable(vector: str):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def _block(key: str, count: int):
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _each(count: int):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _ids(table: pa.Table) -> np.ndarray:
    return table["vec_id"].to_numpy()


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vector"].combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1) if len(table) else np.empty((0, 0))


def _searched(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, count: int):
    """(query ids, vec ids, distances) of the nearest rows of one block for each query."""
    if not len(rows) or not len(queries):
        return [], [], []
    lines = np.random.default_rng(SEED).standard_normal((rows.shape[1], LINES))
    projected = rows @ lines
    order = np.argsort(projected, axis=0, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=0)
    out: list[list] = [[], [], []]
    for query, own, places in zip(queries, query_ids, queries @ lines):
        near, distance = _nearest(rows, row_ids, query, own, places, order, arrays, count)
        out[0] += [own] * len(near)
        out[1] += row_ids[near].tolist()
        out[2] += distance.tolist()
    return out


def _chance(half: float) -> float:
    """The chance that two vectors at the radius fall within ``half`` radii of each other on a line."""
    from math import erf, sqrt

    return erf(half / sqrt(2))


def _nearest(rows, row_ids, query, own, places, order, arrays, count):
    chance = _chance(HALF)
    needed = LINES * chance - SLACK * (LINES * chance * (1 - chance)) ** 0.5
    others = row_ids != own
    total = int(others.sum())
    hits = np.zeros(len(rows), np.int32)
    distance = np.full(len(rows), np.inf)
    verified = ~others
    low = np.array([np.searchsorted(arrays[:, j], places[j]) for j in range(LINES)])
    high = low.copy()
    radius = _first_radius(arrays, places)
    while True:
        fresh = []
        for j in range(LINES):
            left = np.searchsorted(arrays[:, j], places[j] - HALF * radius)
            right = np.searchsorted(arrays[:, j], places[j] + HALF * radius, side="right")
            fresh += [order[left : low[j], j], order[high[j] : right, j]]
            low[j], high[j] = min(left, low[j]), max(right, high[j])
        hits += np.bincount(np.concatenate(fresh), minlength=len(rows)).astype(np.int32)
        new = np.flatnonzero((hits >= needed) & ~verified)
        if len(new):
            distance[new] = np.sqrt(((rows[new] - query) ** 2).sum(axis=1))
            verified[new] = True
        close = int((distance <= radius).sum())
        if close >= min(count, total) or (low == 0).all() and (high == len(rows)).all():
            break
        radius *= GROWTH
    near = np.lexsort((row_ids, distance))
    near = near[np.isfinite(distance[near])][:count]
    return near, distance[near]


def _first_radius(arrays: np.ndarray, places: np.ndarray) -> float:
    """A radius below which hardly any row can collide often enough."""
    spread = np.abs(arrays[[0, len(arrays) // 2, -1]] - places).max()
    return max(float(spread) / 16, 1e-12)
