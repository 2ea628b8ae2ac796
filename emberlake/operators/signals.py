"""Query log, results and feedback: usage, boosts, gaps, review order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["hit", "miss", "correction", "noise", "relevant", "thin", "bad_result"]


def latest_verdicts(feedback: DataFrame, leave_out: tuple[str, ...] = ("deferred",)) -> DataFrame:
    """(query_id, kind): the last verdict of each query by feedback id; combined before the shuffle."""
    return feedback.where(~F.col("kind").isin(*leave_out) & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.max_by("kind", "id").alias("kind"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(result_id, validations, contradictions) of results with feedback."""
    kind = F.col("kind")
    return feedback.where("result_id IS NOT NULL").groupBy("result_id").agg(F.count_if(kind.isin("hit", "relevant")).alias("validations"), F.count_if(kind == "correction").alias("contradictions"))


def boost_counts(results: DataFrame, feedback: DataFrame, without_query: str | None = None) -> DataFrame:
    """(result_id, n): citations and corrections less the queries that call the result bad, 0 at least."""
    if without_query is not None:
        results, feedback = (df.where(F.col("query_id") != without_query) for df in (results, feedback))
    up = results.where("cited").select("result_id").unionByName(feedback.where("kind = 'correction'").select("result_id"))
    up = up.where("result_id IS NOT NULL").groupBy("result_id").agg(F.count("*").alias("up"))
    down = feedback.where("kind = 'bad_result' AND result_id IS NOT NULL").groupBy("result_id").agg(F.count_distinct("query_id").alias("down"))
    return up.join(down, "result_id", "left").select("result_id", F.greatest(F.lit(0), F.col("up") - F.coalesce("down", F.lit(0))).alias("n"))


def boost_factor(n, per: float = 0.03, cap: float = 0.15):
    return 1 + F.least(n * per, F.lit(cap))


def coverage_gaps(queries: DataFrame) -> DataFrame:
    """(query, n, last_ts, zero_results) of questions answered poorly, by lower-case text."""
    poor = F.col("confidence").isin("low", "unknown") | (F.col("results_returned") == 0)
    return queries.where(poor & F.col("text").isNotNull()).groupBy(F.lower("text").alias("query")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.count_if(F.col("results_returned") == 0).alias("zero_results"))


def item_usage(queries: DataFrame, results: DataFrame, feedback: DataFrame, leave_out: tuple[str, ...] = ("test",)) -> DataFrame:
    """(result_id, surfaced, cited, last_ts) over real traffic: no left-out provenance, no query last judged noise."""
    real = queries.where(~F.coalesce("provenance", F.lit("")).isin(*leave_out)).select(F.col("id").alias("query_id"), "ts")
    noise = latest_verdicts(feedback).where("kind = 'noise'").select("query_id")
    return results.join(real, "query_id").join(noise, "query_id", "left_anti").groupBy("result_id").agg(F.count("*").alias("surfaced"), F.count_if("cited").alias("cited"), F.max("ts").alias("last_ts"))


def stale(items: DataFrame, usage: DataFrame, since) -> DataFrame:
    """(id, source_id) of items never surfaced, or not since ``since``."""
    seen = usage.where(F.col("last_ts") >= since).select(F.col("result_id").alias("id"))
    return items.select("id", "source_id").join(seen, "id", "left_anti")


def review_queue(queries: DataFrame, results: DataFrame, feedback: DataFrame, now) -> DataFrame:
    """(query_id, priority): how much a query deserves a look; judged ones lose the largest part."""
    judged = feedback.where(F.col("kind").isin(*VERDICTS)).select("query_id").distinct().withColumn("judged", F.lit(True))
    cited = results.groupBy("query_id").agg(F.count_if("cited").alias("cited"))
    rows = queries.withColumnRenamed("id", "query_id").join(judged, "query_id", "left").join(cited, "query_id", "left")
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")) / 86_400_000_000
    n = F.coalesce("results_returned", F.lit(0))
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    priority = (
        one(F.col("judged").isNull(), 1.0) + one(F.lower("confidence") == "low", 0.5) + F.when(n >= 5, 0.3).when(n == 0, 0.4).otherwise(0.0)
        + one((F.coalesce("cited", F.lit(0)) == 0) & (n > 0), 0.2) + F.when(days < 1, 0.4).when(days < 7, 0.2).otherwise(0.0)
    )
    return rows.select("query_id", "ts", F.round(priority, 6).alias("priority"))


def dashboard(queries: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: totals, coverage, hit rate and usefulness; rates are 0 where nothing was graded."""
    f = feedback.agg(
        F.count_distinct(F.when(F.col("kind").isin(*VERDICTS), F.col("query_id"))).alias("judged"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("hit", "miss", "correction", "noise", "relevant", "thin")],
    )
    q = queries.agg(F.count("*").alias("total"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return q.join(F.broadcast(f)).select(  # one row each
        "total", "judged", "hit", "miss", "correction", "noise", "relevant", "thin",
        rate(c("judged"), c("total")).alias("coverage"), rate(c("hit"), c("hit") + c("miss") + c("correction")).alias("hit_rate"), rate(c("relevant"), c("relevant") + c("thin")).alias("usefulness"),
    )


def miss_sources(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """(source, n): where the first result of missed queries came from."""
    missed = feedback.where("kind = 'miss'").select("query_id")
    return missed.join(results.where("rank = 1 AND source IS NOT NULL").select("query_id", "source"), "query_id").groupBy("source").agg(F.count("*").alias("n"))


def noise_cascade(queries: DataFrame, feedback: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id) of the unjudged queries that share a seed's text, and the seeds themselves."""
    judged = feedback.where(F.col("kind").isin(*VERDICTS)).select("query_id").distinct()
    text = queries.join(seeds.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select("text").distinct()
    same = queries.join(text, "text", "left_semi").select(F.col("id").alias("query_id")).join(judged, "query_id", "left_anti")
    return same.unionByName(seeds.select("query_id")).distinct()


def usage_rollup(log: DataFrame, tag: str, value: str) -> DataFrame:
    """(tag, n, total, p50, p95): percentiles by index int(n * p) of the ordered values.

    Ranks are taken over the distinct values of a tag with their counts, so a hot tag's rows combine first.
    """
    counts = log.where(F.col(value).isNotNull()).groupBy(F.col(tag).alias("tag"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("tag").orderBy("v")
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("tag")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v")))
    return rows.groupBy("tag").agg(F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"))
