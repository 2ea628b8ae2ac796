"""A query log read from the event stream: a user's day is a query, what they saw its results, what they did its feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _events(events: DataFrame) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events.withColumn("query_id", F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string"))).withColumn("k", k)


def queries(events: DataFrame) -> DataFrame:
    """(id, ts, text, results_returned, confidence, provenance)."""
    rows = _events(events).groupBy("query_id").agg(
        F.max("ts").alias("ts"), F.min("k").alias("k"), F.count_if(F.col("event_type") == "view").alias("results_returned"), F.sum("k").alias("sum_k"), F.min("user_id").alias("user_id")
    )
    return rows.select(
        F.col("query_id").alias("id"), "ts", F.concat(F.lit("Topic "), (F.col("k") % 40).cast("string")).alias("text"), "results_returned",
        F.when(F.col("sum_k") % 5 == 0, "low").when(F.col("sum_k") % 5 == 1, "medium").when(F.col("sum_k") % 5 == 2, "unknown").otherwise("high").alias("confidence"),
        F.when(F.col("user_id") % 6 == 0, "test").when(F.col("user_id") % 6 == 1, "mcp").when(F.col("user_id") % 6 < 5, "cli").alias("provenance"),
    )


def results(events: DataFrame) -> DataFrame:
    """(query_id, rank, result_id, source, cited)."""
    rows = _events(events).where(F.col("event_type").isin("view", "click"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "event_id"))
    return rows.select("query_id", rank.alias("rank"), F.concat(F.lit("doc-"), F.col("k").cast("string")).alias("result_id"), F.concat(F.lit("src-"), (F.col("k") % 5).cast("string")).alias("source"), (F.col("event_type") == "click").alias("cited"))


def feedback(events: DataFrame) -> DataFrame:
    """(id, query_id, kind, result_id, ts)."""
    k, kind = F.col("k"), F.col("event_type")
    verdict = (
        F.when(k % 11 == 0, "deferred")
        .when(kind == "purchase", F.when(k % 3 == 0, "correction").otherwise("hit"))
        .when(kind == "error", F.when(k % 4 == 0, "bad_result").otherwise("miss"))
        .otherwise(F.when(k % 3 == 0, "noise").when(k % 3 == 1, "relevant").otherwise("thin"))
    )
    rows = _events(events).where(kind.isin("purchase", "error", "signup"))
    return rows.select(F.col("event_id").alias("id"), "query_id", verdict.alias("kind"), F.concat(F.lit("doc-"), k.cast("string")).alias("result_id"), "ts")
