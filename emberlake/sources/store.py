"""The item store: upserts by id, watermarks, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = ["ingested_at", "consolidated_into", "promoted_to", "junk_reason"]


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after ``incoming``: new ids are added, known ones refreshed but for when they came in and what was made of them.

    Of several incoming rows of one id the last ingested counts. Both sides have the store's columns.
    """
    cols = stored.columns
    last = incoming.groupBy("id").agg(F.max_by(F.struct(*[c for c in cols if c != "id"]), F.coalesce(F.col("ingested_at"), F.lit("1970-01-01").cast("timestamp"))).alias("v")).select("id", "v.*")
    kept = [c for c in KEPT if c in cols]
    old = stored.select("id", *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_known"))
    fresh = last.join(old, "id", "left").withColumns({c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)) for c in kept})
    return stored.join(last.select("id"), "id", "left_anti").select(*cols).unionByName(fresh.select(*cols))


def not_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What still needs enriching: one row per id that the store lacks."""
    return incoming.join(stored.select("id"), "id", "left_anti").dropDuplicates(["id"])


def advance(watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, last_us): per source the later of the old mark and the latest item seen; never back."""
    new = seen.where("timestamp IS NOT NULL").groupBy("source").agg(F.max(F.unix_micros("timestamp")).alias("last_us"))
    return watermarks.select("source", "last_us").unionByName(new).groupBy("source").agg(F.max("last_us").alias("last_us"))


def late(items: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Items behind their source's mark; a full run accepts them, ids tell repeats."""
    return items.join(watermarks.select("source", "last_us"), "source").where(F.unix_micros("timestamp") < F.col("last_us"))


def mark_consolidated(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """``items`` with consolidated_into set for the members of ``sessions(consolidation_id, raw_item_ids)``."""
    member = sessions.select(F.col("consolidation_id").alias("_c"), F.explode("raw_item_ids").alias("id")).groupBy("id").agg(F.min("_c").alias("_c"))
    return items.join(member, "id", "left").withColumn("consolidated_into", F.coalesce("_c", "consolidated_into")).drop("_c").select(*items.columns)


def run_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, seen, new, skipped) of an ingest run."""
    known = stored.select("id", F.lit(True).alias("known"))
    return batch.join(known, "id", "left").groupBy("source").agg(F.count("*").alias("seen"), F.count_distinct(F.when(F.col("known").isNull(), F.col("id"))).alias("new")).withColumn("skipped", F.col("seen") - F.col("new"))


def prune(items: DataFrame) -> DataFrame:
    """Without rows that are annotated as junk and stand in no session."""
    return items.where("junk_reason IS NULL OR consolidated_into IS NOT NULL")


def bundles(candidates: DataFrame) -> DataFrame:
    """(run_id, bundle): one JSON text per run with its candidates by id. For runs whose candidates fit a row."""
    rows = F.array_sort(F.collect_list(F.struct(*candidates.columns)))
    return candidates.groupBy("run_id").agg(F.to_json(F.struct(F.lit("1").alias("version"), rows.alias("candidates"))).alias("bundle"))


def note_files(notes: DataFrame) -> DataFrame:
    """(value) texts of notes with front matter, for a text sink; contradicted ones carry a mark."""
    tags = F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]"))
    return notes.select(F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("tags: "), tags), F.concat(F.lit("conflict: "), F.col("contradicted").cast("string")), F.lit("---"), F.lit(""), "statement").alias("value"))


def read_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def newest_first(items: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows, oldest of them first."""
    return items.orderBy(F.desc("timestamp"), "id").limit(n).orderBy("timestamp", "id")


def longest_prefix(keys: DataFrame, notes: DataFrame) -> DataFrame:
    """(key, note) by ``notes(prefix, note)``: the exact key, else the key shortened at underscores until one matches."""
    parts = F.split("key", "_")
    tries = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "_").alias("prefix")))).alias("t"))
    met = tries.select("key", "t.n", "t.prefix").join(notes, "prefix")
    return met.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n")))).where("k = 1").select("key", "note")
