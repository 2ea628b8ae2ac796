"""Annotating messages that carry nothing, and the size of what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.blocks import neighbours, time_block

# How reactions that arrive as text begin.
REACTIONS = ["Liked ", "Loved ", "Emphasized ", "Laughed at ", "Questioned ", "Disliked "]
SHORT = 10


def is_message(source: Column) -> Column:
    return source.isin("imessage", "signal") | source.startswith("teams")


def is_reaction(content: Column) -> Column:
    return F.coalesce(F.lower(content).rlike("^(" + "|".join(r.lower() for r in REACTIONS) + ")"), F.lit(False))


def is_short(content: Column) -> Column:
    return F.coalesce((F.length(F.trim(content)) < SHORT) & ~is_reaction(content), F.lit(False))


def same_day_copies(items: DataFrame) -> DataFrame:
    """The ids of rows but the smallest id of each (content, thread, sender, day); nulls equal nulls, null contents never count.

    The smallest id per group comes from a map-side combined aggregate, then a null-safe join finds the rest.
    """
    rows = items.where(F.col("content").isNotNull()).select("id", "content", "thread_id", "sender", F.to_date("timestamp").alias("day"))
    key = ["content", "thread_id", "sender", "day"]
    keep = rows.groupBy(*key).agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    return rows.alias("r").join(keep.alias("k"), same).where("r.id <> k.keep").select("r.id").distinct()


def annotate(items: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(id, junk_reason) of every row that gets one: short, reaction, then copy of what is left.

    ``items(id, source, timestamp, sender, content, thread_id, junk_reason)``, one row per id. Reasons already given stay and
    are not returned; ``protected(id)`` rows get none.
    """
    open_ = items.where(F.col("junk_reason").isNull() & is_message(F.col("source")))
    if protected is not None:
        open_ = open_.join(protected.select("id").distinct(), "id", "left_anti")
    first = F.when(is_short(F.col("content")), "mech:short").when((F.col("source") == "imessage") & is_reaction(F.col("content")), "mech:reaction")
    marked = open_.withColumn("reason", first)
    copies = same_day_copies(marked.where("reason IS NULL")).withColumn("reason", F.lit("mech:dup"))
    return marked.where("reason IS NOT NULL").select("id", F.col("reason").alias("junk_reason")).unionByName(copies.select("id", F.col("reason").alias("junk_reason")))


def context(items: DataFrame, chars: int = 120) -> DataFrame:
    """(id, prev, next): the nearest strictly earlier and later content of the thread, cut to ``chars``.

    Rows without thread have no context. Of equal neighbours the smallest id speaks.
    """
    micros = F.unix_micros("timestamp")
    rows = items.where("thread_id IS NOT NULL").select("id", "thread_id", micros.alias("us"), "content")
    said = rows.groupBy("thread_id", "us").agg(F.min_by("content", "id").alias("said"))
    near = neighbours(said, ["thread_id"], time_block(F.col("us")), ["us"], ["said"], after=True)
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, chars)
    near = near.select("thread_id", "us", cut("prev.said").alias("prev"), cut("next.said").alias("next"))
    return rows.select("id", "thread_id", "us").join(near, ["thread_id", "us"]).select("id", "prev", "next")
