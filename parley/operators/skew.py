"""Ordered per-group work that stays parallel when one group holds a large share of the rows.

A window partitioned by a key puts each group into one task. These functions
first measure the largest group (one aggregation with map-side combine). Small
groups take the plain window. Otherwise the rows are range-partitioned by
(key, order), which splits a big group into consecutive blocks, and every step
works on (key, block) plus one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import durable

MAX_GROUP_ROWS = 1_000_000
BLOCK = "_block"
#: Rows of a few numbers or words that are sent to every task; measured before, never assumed.
MOST_BROADCAST = 100_000


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else joins choose their own way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; one number reaches the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.agg(F.max("rows")).first()[0] or 0


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a block number that rises with (keys, order); a big group spans many blocks.

    The result is materialised, because the block limits come from sampling and
    all later reads must see the same ones.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(blocks, *keys, *order)
    return durable(ranged.withColumn(BLOCK, F.spark_partition_id()))


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    max_group: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row in its group; ``largest`` saves measuring again."""
    if (largest_group(df, keys) if largest is None else largest) <= max_group:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    ranged = range_blocks(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        ranged.withColumn("_within", F.row_number().over(inside) - 1)
        .join(starts, [*keys, BLOCK])
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("bigint"))
        .drop(BLOCK, "_within", "_start")
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the closest earlier non-null ``value`` of the group (the row itself excluded)."""
    if largest_group(df, keys) <= max_group:
        return df.withColumn(name, _previous(value, Window.partitionBy(*keys).orderBy(*order)))
    ranged = range_blocks(df, keys, order)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = (
        ranged.groupBy(*keys, BLOCK)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
        .withColumn("_carried", _previous("_last", by_block))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        ranged.withColumn("_near", _previous(value, inside))
        .join(carried, [*keys, BLOCK])
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop(BLOCK, "_near", "_carried")
    )


def global_sequence(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add 0, 1, 2, ... over the whole frame without gathering it in one partition."""
    ranged = range_blocks(df, [], order)
    # One row per block: as many as there are shuffle partitions.
    earlier = Window.partitionBy(F.lit(0)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(BLOCK).orderBy(*order)
    return (
        ranged.withColumn("_within", F.row_number().over(inside) - 1)
        .join(starts, BLOCK)
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("bigint"))
        .drop(BLOCK, "_within", "_start")
    )


def _previous(value: str, window: Window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(frame)
