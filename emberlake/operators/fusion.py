"""Fusing ranked lanes, and the credits, boosts and orders that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 30
SESSION_FACTOR, AGREEMENT_FACTOR, AGREEMENT_RANK = 1.05, 1.05, 2
THREAD_CREDIT, CREDIT_SESSIONS = 0.15, 3


def lane(df: DataFrame, name: str, kind: str, index: str, weight: float = 1.0) -> DataFrame:
    """A ranked list (query_id, id, rank from 1) as a lane; index: fts or vector."""
    return df.select("query_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(name).alias("lane"), F.lit(index).alias("index"), F.lit(float(weight)).alias("weight"), (F.col("rank") - 1).alias("rank0"))


def rrf(lanes: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, kind, id, score, fts_rank, vector_rank): weighted reciprocal ranks summed over the lanes.

    Ranks count from 0. Sessions weigh a little more, and so does what both indexes have among their first three.
    """
    rows = reduce(DataFrame.unionByName, lanes)
    part = F.col("weight") / (k + F.col("rank0") + 1) * F.when(F.col("kind") == "session", SESSION_FACTOR).otherwise(1.0)
    best = lambda i: F.min(F.when(F.col("index") == i, F.col("rank0")))
    out = rows.groupBy("query_id", "kind", "id").agg(F.sum(part).alias("s"), best("fts").alias("fts_rank"), best("vector").alias("vector_rank"))
    both = (F.col("fts_rank") <= AGREEMENT_RANK) & (F.col("vector_rank") <= AGREEMENT_RANK)
    return out.select("query_id", "kind", "id", F.round(F.col("s") * F.when(both, AGREEMENT_FACTOR).otherwise(1.0), 9).alias("score"), "fts_rank", "vector_rank")


def thread_credit(fused: DataFrame, items: DataFrame, sessions: DataFrame) -> DataFrame:
    """``fused`` with a share of a leading session's score added to the items of its thread that matched in words.

    ``items(id, thread_id)``, ``sessions(id, thread_id)``. Sessions lead if they are among the first three.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id"))
    top = fused.withColumn("place", place).where((F.col("place") <= CREDIT_SESSIONS) & (F.col("kind") == "session"))
    best = top.join(sessions.select("id", "thread_id"), "id").where("thread_id IS NOT NULL AND thread_id <> ''").groupBy("query_id", "thread_id").agg(F.max("score").alias("lead"))
    own = fused.where("kind = 'item' AND fts_rank IS NOT NULL").select("query_id", "id").join(items.select("id", "thread_id"), "id").join(best, ["query_id", "thread_id"]).select("query_id", "id", "lead")
    rows = fused.join(own.withColumn("kind", F.lit("item")), ["query_id", "kind", "id"], "left")
    return rows.withColumn("score", F.round(F.col("score") + THREAD_CREDIT * F.coalesce("lead", F.lit(0.0)), 9)).select(*fused.columns)


def recency_decay(score: Column, age_days: Column, tau_days: float, floor: float = 0.0) -> Column:
    return score * F.greatest(F.lit(floor), F.exp(-F.greatest(F.lit(0.0), age_days) / tau_days))


def relevance_floor(rows: DataFrame, share: float, group: str = "query_id", keep: Column | None = None) -> DataFrame:
    """Rows of at least ``share`` of their group's best score, and those ``keep`` marks; all where the best is not positive."""
    best = rows.groupBy(group).agg(F.max("score").alias("_best"))
    ok = (F.col("_best") <= 0) | (F.col("score") >= share * F.col("_best"))
    return rows.join(best, group).where(ok if keep is None else ok | keep).drop("_best")


def time_order(rows: DataFrame, at: str, newest: bool, group: str = "query_id") -> DataFrame:
    """``rows`` with place by time; at equal times the better score comes first whichever way time runs."""
    first = F.col(at).desc() if newest else F.col(at).asc()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(first, F.desc("score"), "id")))


def exact_before_associated(rows: DataFrame, weight: str, group: str = "query_id") -> DataFrame:
    """``rows`` with place: those of weight 1 first, by score inside both parts."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(weight) < 1, F.desc("score"), "id")))


def token_budget(rows: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """Ranked rows (rank, content) while their quarter lengths add up to no more than ``budget``; the first is always kept."""
    cost = F.floor(F.length(F.coalesce("content", F.lit(""))) / 4).cast("long")
    upto = F.sum("cost").over(Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cost", cost).withColumn("upto", upto).where((F.col("upto") <= budget) | (F.col("rank") == 1))
