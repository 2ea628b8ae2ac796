"""Ordering and running totals within groups of any size: work inside blocks of time, then over one row per block.

A group that holds a third of all rows is never sorted in one task. ``block`` must not fall as the order rises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_US = 6 * 3600 * 1_000_000


def time_block(us: Column, block_us: int = BLOCK_US) -> Column:
    return F.floor(us / block_us)


def _meet(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, _block) with the columns of ``blocks`` (keys, _block, ...); null keys meet."""
    other = blocks.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, "_block"]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_block"]])
    return rows.join(other, same).drop(*[f"_k_{c}" for c in [*keys, "_block"]])


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to and with this one by (``block``, ``order``)."""
    df = df.withColumn("_block", block).withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = df.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _meet(df.withColumn("_inside", inside), sums.withColumn("_before", before).drop("_sum"), keys)
    return rows.withColumn(name, F.coalesce("_inside", F.lit(0)) + F.col("_before")).drop("_block", "_v", "_inside", "_before")


def row_numbers(df: DataFrame, keys: list[str], block: Column, order: list, name: str) -> DataFrame:
    """Add ``name``: the 1-based row number within ``keys``."""
    return running_sum(df, keys, block, order, F.lit(1).cast("long"), name)


def neighbours(df: DataFrame, keys: list[str], block: Column, order: list, values: list[str], before: bool = True, after: bool = False) -> DataFrame:
    """Add prev / next: structs of ``values`` of the row before and after in the group, null at its ends.

    Inside a block a window sees them; at a block's edge they come from the nearest other block's edge, found over one row per block.
    """
    df = df.withColumn("_block", block).withColumn("_s", F.struct(*values))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = df
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    edges = df.groupBy(*keys, "_block").agg(F.min_by("_s", at).alias("_first"), F.max_by("_s", at).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(*keys, "_block", F.lag("_last").over(over).alias("_from"), F.lead("_first").over(over).alias("_to"))
    if before:
        rows = rows.withColumn("_p", F.lag("_s").over(w))
    if after:
        rows = rows.withColumn("_n", F.lead("_s").over(w))
    rows = _meet(rows, edges, keys)
    if before:
        rows = rows.withColumn("prev", F.coalesce("_p", "_from"))
    if after:
        rows = rows.withColumn("next", F.coalesce("_n", "_to"))
    return rows.drop("_block", "_s", "_p", "_n", "_from", "_to")
