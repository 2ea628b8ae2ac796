"""Sessions with a cap on their items, their members and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.blocks import neighbours, row_numbers, running_sum, time_block


def capped_sessions(items: DataFrame, gap_minutes: int = 240, cap: int = 50) -> DataFrame:
    """``items`` with thread_key, us, session_no and place: a session ends after a gap or after ``cap`` items.

    Items are ordered by timestamp and id in their source and thread; null threads of a source are one; items
    without timestamp are in no session. Only a block of hours of a thread is ever ordered in one task.
    """
    thread, order, block = ["source", "thread_key"], ["us", "id"], time_block(F.col("us"))
    rows = items.where("timestamp IS NOT NULL").withColumn("thread_key", F.coalesce("thread_id", F.lit(""))).withColumn("us", F.unix_micros("timestamp"))
    small = neighbours(rows.select(*thread, *order), thread, block, order, ["us"])
    opens = F.when(F.col("us") - F.col("prev.us") > gap_minutes * 60_000_000, 1).otherwise(0)
    small = running_sum(small.withColumn("_opens", opens), thread, block, order, F.col("_opens"), "_gap")
    small = row_numbers(small, [*thread, "_gap"], block, order, "_n").withColumn("place", (F.pmod(F.col("_n") - 1, F.lit(cap)) + 1).cast("long"))
    small = running_sum(small, thread, block, order, F.when(F.col("place") == 1, 1).otherwise(0), "session_no")
    # Texts stay out of the windows.
    return rows.join(small.select("id", "place", "session_no"), "id")


def consolidations(members: DataFrame, least: int = 3) -> DataFrame:
    """One row per session of at least ``least`` items: id, bounds, count, participants in order of appearance, member ids."""
    key = ["source", "thread_key", "session_no"]
    out = members.groupBy(*key).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("item_count"),
        F.array_sort(F.collect_list(F.struct("us", "id", "sender"))).alias("m"),
    ).where(F.col("item_count") >= least)
    people = F.array_distinct(F.filter(F.col("m.sender"), lambda s: s.isNotNull() & (s != "")))
    ids = F.col("m.id")
    cid = F.concat(F.lit("cons:"), F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 32))
    return out.select(cid.alias("consolidation_id"), *key, "start_us", "end_us", "item_count", people.alias("participants"), ids.alias("raw_item_ids"))


def summaries(members: DataFrame, least: int = 3, most_chars: int = 8000) -> DataFrame:
    """A header and one line per item while the budget lasts, then how many more there are."""
    key = ["source", "thread_key", "session_no"]
    stamp = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm")
    line = F.concat(F.lit("["), stamp(F.col("us")), F.lit("] "), F.coalesce(F.when(F.col("sender") != "", F.col("sender")), F.lit("unknown")), F.lit(": "), F.replace(F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(" ")))
    heads = consolidations(members, least)
    first, last = (F.date_format(F.timestamp_micros(c), "yyyy-MM-dd") for c in ("start_us", "end_us"))
    days = F.when(first == last, first).otherwise(F.concat(first, F.lit(" to "), last))
    people = F.when(F.size("participants") > 0, F.array_join("participants", ", ")).otherwise("unknown")
    heads = heads.withColumn("header", F.concat(F.col("source"), F.lit(" session "), days, F.lit(" with "), people, F.lit(":")))
    lines = members.select(*key, "place", line.alias("line")).join(heads.select(*key, "header", "item_count"), key)
    w = Window.partitionBy(*key).orderBy("place")
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fits = lines.withColumn("fits", used <= F.greatest(F.lit(0), most_chars - F.length("header") - 1))
    # Once a line does not fit, no later one is taken.
    kept = fits.groupBy(*key, "header", "item_count").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", "line")))).alias("k"))
    more = F.col("item_count") - F.size("k")
    tail = F.when(more > 0, F.array(F.concat(F.lit("... and "), more.cast("string"), F.lit(" more messages")))).otherwise(F.array().cast("array<string>"))
    return kept.select(*key, F.array_join(F.concat(F.array("header"), F.col("k.line"), tail), "\n").alias("summary"))


def folded_turns(items: DataFrame) -> DataFrame:
    """Neighbouring messages of one sender in a thread as one turn: (source, thread_key, turn_no, sender, n, chars).

    Null senders are one sender. A thread of any length is worked on by blocks of hours.
    """
    thread, order, block = ["source", "thread_key"], ["us", "id"], time_block(F.col("us"))
    rows = items.where("timestamp IS NOT NULL").select("source", F.coalesce("thread_id", F.lit("")).alias("thread_key"), F.unix_micros("timestamp").alias("us"), "id", "sender", F.length(F.coalesce("content", F.lit(""))).alias("chars"))
    rows = neighbours(rows, thread, block, order, ["sender"])
    changes = F.when(F.col("prev").isNotNull() & F.col("prev.sender").eqNullSafe(F.col("sender")), 0).otherwise(1)
    rows = running_sum(rows.withColumn("_c", changes), thread, block, order, F.col("_c"), "turn_no")
    return rows.groupBy(*thread, "turn_no").agg(F.min("sender").alias("sender"), F.count("*").alias("n"), F.sum("chars").alias("chars"))


def overlapping(sessions: DataFrame, since_us: int, until_us: int) -> DataFrame:
    """Sessions that touch a time window, both ends inclusive."""
    return sessions.where((F.col("end_us") >= since_us) & (F.col("start_us") <= until_us))
