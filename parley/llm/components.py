"""Connected components of a link table by alternating stars, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root being its component's smallest.

    Large-star and small-star steps (Kiveris et al., 2014): each step moves links to the
    smallest known neighbour until every node points at its root. The minimum of a node is an
    aggregate that combines before its shuffle; the join back splits a hot node's links.
    Each round is written out, so the plan stays short and a lost executor costs one round.
    """
    now = written(_downward(links), "links")
    mark = _mark(now)
    while True:
        now = written(_small_star(_large_star(now)), "links")
        previous, mark = mark, _mark(now)
        if mark == previous:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _downward(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.filter("a > b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return _downward(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _downward(moved.union(least.select("a", F.col("least").alias("b"))))


def _mark(links: DataFrame) -> tuple:
    """Equal for equal link tables: their number and a sum over their hashes."""
    half = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(half)).first())
