"""Ingest as a stream: micro-batches append to the store by id, sources keep marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlake.sources.store import advance, not_stored


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's items that the store at ``path`` lacks, one row per id, and move the sources' marks.

    A batch that runs again after a failure finds its ids stored and adds none. Late items are accepted: an id
    decides, not a time. Marks go to ``path``-marks, one file set per batch; the latest per source holds.
    """

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        items = f"{path}/items"
        new = not_stored(batch, _known(spark, items, batch.schema.simpleString()[7:-1].replace(":", " ")))
        new.write.mode("append").parquet(items)
        old = _known(spark, f"{path}/marks", "source string, last_us long, batch long")
        advance(old, batch).withColumn("batch", F.lit(no)).write.mode("append").parquet(f"{path}/marks")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, key: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream by inactivity gap: (key, start, end, n_items), each sent once no event can still extend it.

    ``end`` is the last event's time: Spark's window ends a gap later. Events later than ``lateness`` are dropped.
    """
    rows = events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n_items"), F.max(at).alias("last"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("last").alias("end"), "n_items")
