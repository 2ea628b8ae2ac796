"""Sessions of a stream as merged interval state: late events join, lengthen or bridge the sessions they belong to.

Each micro-batch becomes intervals, by blocks of time, so a hot key fills many tasks. They merge with the sessions that
are still open in the state, which are few per key: a session closes once the watermark, the latest event
less the allowed lateness, has passed its end by more than its gap. State and closed sessions are written per batch,
so a batch that runs again after a failure writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlake.operators.sessions import merge_intervals

KEYS = ["source", "thread_key"]
SESSION = "source string, thread_key string, start_us long, end_us long, gap_us long, n_items long"


def _versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows under ``path`` with the batch that wrote them; empty where nothing was written yet."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of ``spans(keys, start_us, end_us, gap_us, n_items)`` as one, with their items added up."""
    w = Window.partitionBy(*KEYS).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_us") - reach > F.col("gap_us")), 1).otherwise(0)
    rows = spans.withColumn("_opens", opens).withColumn("_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*KEYS, "_no").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("gap_us").alias("gap_us"), F.sum("n_items").alias("n_items")).drop("_no")


def session_state(stream: DataFrame, gaps: DataFrame, path: str, checkpoint: str, lateness_us: int) -> StreamingQuery:
    """Keep the sessions of ``stream(id, source, thread_id, timestamp)`` under ``path``; ``sessions_at`` reads them.

    ``gaps(source, gap_us)``: sources without one have no sessions. Each id counts once, whatever batch brings it again. Events older than the
    watermark of the batch before come too late to change what is closed: they are kept under ``path``/late, not counted.
    """

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        before = lambda name, schema: _versions(spark, f"{path}/{name}", schema).where(F.col("batch") < no)
        out = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={no}")
        rows = batch.where("id IS NOT NULL AND timestamp IS NOT NULL").join(gaps, "source").join(before("ids", "id string").select("id"), "id", "left_anti").dropDuplicates(["id"])
        out(rows.select("id", "source", F.coalesce("thread_id", F.lit("")).alias("thread_key"), F.unix_micros("timestamp").alias("at_us"), "gap_us"), "ids")
        new = spark.read.parquet(f"{path}/ids/batch={no}")
        mark = before("marks", "mark_us long").agg(F.max("mark_us").alias("m")).first()["m"]
        latest = new.agg(F.max("at_us").alias("m")).first()["m"]
        on_time = F.lit(True) if mark is None else F.col("at_us") >= mark
        out(new.where(~on_time), "late")
        marks = [x for x in (mark, None if latest is None else latest - lateness_us) if x is not None]
        next_mark = max(marks) if marks else None
        fresh = merge_intervals(new.where(on_time).withColumn("n", F.lit(1).cast("long")), KEYS).join(gaps, "source")
        last = before("open", SESSION).agg(F.max("batch").alias("b")).first()["b"]
        old = before("open", SESSION).where(F.col("batch") == F.lit(last)).drop("batch")
        now = merged(old.unionByName(fresh.select(*old.columns)))
        done = F.lit(False) if next_mark is None else F.col("end_us") + F.col("gap_us") < next_mark
        now.withColumn("state", F.when(done, "closed").otherwise("open")).write.mode("overwrite").parquet(f"{path}/now/batch={no}")
        now = spark.read.parquet(f"{path}/now/batch={no}")
        out(now.where("state = 'closed'").drop("state"), "closed")
        out(now.where("state = 'open'").drop("state"), "open")
        out(spark.createDataFrame([(next_mark,)], "mark_us long"), "marks")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_at(spark: SparkSession, path: str) -> DataFrame:
    """(source, thread_key, start_us, end_us, n_items): closed sessions and those open after the last batch."""
    open_ = _versions(spark, f"{path}/open", SESSION)
    last = open_.agg(F.max("batch").alias("b")).first()["b"]
    rows = _versions(spark, f"{path}/closed", SESSION).unionByName(open_.where(F.col("batch") == F.lit(last)))
    return rows.select(*KEYS, "start_us", "end_us", "n_items")
