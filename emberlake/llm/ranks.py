"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[Column | str], name: str) -> DataFrame:
    """Add ``name``, the 1-based row number within ``keys`` by (``block``, ``order``).

    ``block`` must not fall as ``order`` rises. Only a block of a group is ever sorted in one task; a second
    window runs over one row per block to add up the rows of the earlier ones.
    """
    df = df.withColumn("_block", block)
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), before.alias("_before"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(starts, same).withColumn(name, F.col("_inside") + F.col("_before")).select(*[c for c in df.columns if c != "_block"], name)
