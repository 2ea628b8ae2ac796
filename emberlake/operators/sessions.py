"""Sessions of a keyed event stream, by merging interval state.

Every event opens an interval that stays open for its key's gap; intervals that touch merge. Merging
is associative, so it runs in two steps. Step one merges within blocks of time, which spreads a key
that holds a third of all rows over as many tasks as it has blocks. Step two sees, of each block, only
the first and the last interval, since no other can touch another block's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.tables import distinct_items

BLOCK_US = 6 * 3600 * 1_000_000


def _merge(df: DataFrame, within: list[str]) -> DataFrame:
    """Number the merged intervals of rows (keys, start_us, end_us, gap_us, n) inside each ``within`` group."""
    w = Window.partitionBy(*within).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_us") - reach > F.col("gap_us")), 1).otherwise(0)
    return (
        df.withColumn("_opens", opens)
        .withColumn("_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*within, "_no")
        .agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
            F.sum("n").alias("n"), F.first("gap_us").alias("gap_us"),
        )
    )


def merge_intervals(events: DataFrame, keys: list[str], block_us: int = BLOCK_US) -> DataFrame:
    """Sessions of ``events(keys..., at_us, gap_us, n)`` as (keys..., start_us, end_us, n_items).

    ``n`` events happened at ``at_us``. An event more than ``gap_us`` after the one before starts a
    session; exactly ``gap_us`` does not. Null ``at_us`` or ``gap_us``: the row has no session. Null key
    values group together. ``gap_us`` must be one value for each key. Rows of any order, ties included.
    """
    events = events.where(F.col("at_us").isNotNull() & F.col("gap_us").isNotNull())
    at_once = (
        events.groupBy(*keys, "at_us").agg(F.sum("n").alias("n"), F.max("gap_us").alias("gap_us"))
        .select(*keys, F.floor(F.col("at_us") / block_us).alias("_block"), F.col("at_us").alias("start_us"), F.col("at_us").alias("end_us"), "gap_us", "n")
    )
    partial = _merge(at_once, [*keys, "_block"])
    in_block = Window.partitionBy(*keys, "_block")
    partial = partial.withColumn("_edge", (F.col("_no") == 1) | (F.col("_no") == F.max("_no").over(in_block)))
    whole = _merge(partial.where("_edge"), keys)
    inner = partial.where(~F.col("_edge"))
    out = [*keys, "start_us", "end_us", F.col("n").alias("n_items")]
    return inner.select(*out).unionByName(whole.select(*out))


def sessionize_items(items: DataFrame, config: DataFrame, block_us: int = BLOCK_US) -> DataFrame:
    """Sessions of the distinct items of each source in ``config(source, gap_minutes)`` and thread.

    Returns (source, thread_key, start_us, end_us, duration_us, n_items). thread_key is thread_id with
    null read as ''. Items without timestamp have no session; sources without a gap in ``config`` or with
    a null gap give none; a source listed twice takes its smallest gap. ``config`` has one row per source
    and is small by definition, but is joined without a hint, so its size decides the strategy.
    """
    gaps = config.where("gap_minutes IS NOT NULL").groupBy("source").agg((F.min("gap_minutes").cast("long") * 60_000_000).alias("gap_us"))
    events = (
        distinct_items(items.join(gaps.select("source"), "source", "left_semi"), "source", "thread_id", "timestamp")
        .join(gaps, "source")
        .select("source", F.coalesce("thread_id", F.lit("")).alias("thread_key"), F.unix_micros("timestamp").alias("at_us"), "gap_us", F.lit(1).cast("long").alias("n"))
    )
    return merge_intervals(events, ["source", "thread_key"], block_us).select(
        "source", "thread_key", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_items"
    )
