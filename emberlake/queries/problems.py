"""The numbered queries of the general operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators import instants, sessions
from emberlake.session import shared_dir
from emberlake.streaming import sessions as stream
from emberlake.streaming.ingest import read_stream
from emberlake.tables import table

#: The items arrive in so many parts, in the order in which they were ingested, and events may be so late.
ARRIVALS, LATENESS_US = 4, 60 * 86_400_000_000


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessionize_items(table(spark, sf_dir, "items"), table(spark, sf_dir, "session_config"))
    return found.select("source", "thread_key", "start_us", "end_us", "n_items")


def p3_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessionize_items(table(spark, sf_dir, "items"), table(spark, sf_dir, "session_config"))
    return found.groupBy("source").agg(F.count("*").alias("n_sessions"), F.max("duration_us").alias("longest_us"), F.sum("n_items").alias("n_items"))


def p3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items replayed as a stream by the time they were ingested, late ones and second deliveries among them, into merged interval state."""
    home = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    items = table(spark, sf_dir, "items").select("id", "source", "thread_id", "timestamp", "ingested_at")
    at = F.unix_micros("ingested_at")
    cuts = items.agg(F.percentile_approx(at, [k / ARRIVALS for k in range(1, ARRIVALS)], 1000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0)
    for k in range(len(cuts) + 1):
        items.where(part == k).write.mode("append").parquet(f"{home}/in")
    gaps = table(spark, sf_dir, "session_config").where("gap_minutes IS NOT NULL").groupBy("source").agg((F.min("gap_minutes").cast("long") * 60_000_000).alias("gap_us"))
    stream.session_state(read_stream(spark, f"{home}/in", 8), gaps, f"{home}/state", f"{home}/checkpoint", LATENESS_US).awaitTermination()
    return stream.sessions_at(spark, f"{home}/state")


def p7_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary kept as a table over two loads: the second parses only what the first did not bring."""
    path = f"{shared_dir(spark)}/instants-{uuid.uuid4().hex}"
    rows = instants.timestamp_rows(table(spark, sf_dir, "raw_items"), table(spark, sf_dir, "chat_facts"), table(spark, sf_dir, "source_profiles"))
    instants.update_dictionary(spark, rows.where("rec_table = 'raw_items'"), path)
    return instants.update_dictionary(spark, rows, path).select(*instants.DICTIONARY_KEY, "utc_micros")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instants.timestamp_rows(table(spark, sf_dir, "raw_items"), table(spark, sf_dir, "chat_facts"), table(spark, sf_dir, "source_profiles"))
    return instants.normalise(rows, instants.parse_dictionary(rows)).select("rec_table", "rec_key", "utc_micros")


QUERIES = {"p3_found": p3_found, "p3_durations": p3_durations, "p3_stream": p3_stream, "p7_found": p7_found, "p7_dictionary": p7_dictionary}

_SESSIONS = """
WITH d AS (SELECT DISTINCT ON (id) id, source, coalesce(thread_id, '') AS thread_key, epoch_us(timestamp) AS us
           FROM items WHERE timestamp IS NOT NULL ORDER BY id, ingested_at),
g AS (SELECT d.*, CASE WHEN us - lag(us) OVER w > c.gap_minutes::BIGINT * 60000000 THEN 1 ELSE 0 END AS opens
      FROM d JOIN session_config c USING (source) WINDOW w AS (PARTITION BY source, thread_key ORDER BY us)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY source, thread_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT source, thread_key, min(us)::BIGINT AS start_us, max(us)::BIGINT AS end_us, count(*)::BIGINT AS n_items
      FROM n GROUP BY source, thread_key, no)
"""
SQL = {
    "p3_found": _SESSIONS + "SELECT * FROM s",
    "p3_stream": _SESSIONS + "SELECT * FROM s",
    "p3_durations": _SESSIONS + "SELECT source, count(*)::BIGINT AS n_sessions, max(end_us - start_us)::BIGINT AS longest_us, sum(n_items)::BIGINT AS n_items FROM s GROUP BY source",
}
