"""Merging entities, building labelled sets, comparing judges and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.blocks import neighbours, time_block
from emberlake.operators.evaluate import hash_bucket, range_block, split_name


def merged_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """(item_id, entity_id, confidence) after ``merges(entity_id, survivor)``: repointed, the best confidence per pair kept."""
    to = merges.where("entity_id <> survivor").groupBy("entity_id").agg(F.min("survivor").alias("survivor"))
    rows = links.join(to, "entity_id", "left").select("item_id", F.coalesce("survivor", "entity_id").alias("entity_id"), "confidence")
    return rows.groupBy("item_id", "entity_id").agg(F.max("confidence").alias("confidence"))


def merged_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """(entity_a, entity_b, weight) after ``merges``: both ends repointed, loops dropped, the heaviest edge kept."""
    to = merges.groupBy("entity_id").agg(F.min("survivor").alias("survivor"))
    rows = relations
    for end in ("entity_a", "entity_b"):
        rows = rows.join(to.select(F.col("entity_id").alias(end), F.col("survivor").alias("_s")), end, "left").withColumn(end, F.coalesce("_s", end)).drop("_s")
    return rows.where("entity_a <> entity_b").groupBy("entity_a", "entity_b").agg(F.max("weight").alias("weight"))


def without_neighbours(rows: DataFrame, labelled: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """``rows`` that are neither labelled nor the next or previous of a labelled one in their group by ``at``, a time or a number: a split must not leak context."""
    small = rows.select(group, at, key)
    if dict(rows.dtypes)[at].startswith("timestamp"):
        block = time_block(F.unix_micros(at))
    else:
        small, block = range_block(small, [group], at, "_range"), F.col("_range")
    near = neighbours(small, [group], block, [at, key], [key], after=True)
    near = near.select(key, F.col(f"prev.{key}").alias("p"), F.col(f"next.{key}").alias("n")).join(labelled.select(key).distinct(), key, "left_semi")
    out = near.select(F.explode(F.array_compact(F.array(key, "p", "n"))).alias(key)).distinct()
    return rows.join(out, key, "left_anti")


def training_rows(rows: DataFrame, group: str, label: str, times: int) -> DataFrame:
    """``rows`` with fold by the hash of their group, and copy: training rows whose ``label`` holds stand ``times`` times."""
    fold = split_name(F.col(group).cast("string"))
    copies = F.when((fold == "train") & F.col(label), times).otherwise(1)
    return rows.withColumn("fold", fold).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def consensus(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n, agree, both_true) over two judges' (id, verdict): rows both judged, rows of one verdict, rows both call true."""
    rows = a.select("id", F.col("verdict").alias("x")).join(b.select("id", F.col("verdict").alias("y")), "id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if(F.col("x") & F.col("y")).alias("both_true"))


def hits_before(queries: DataFrame, hits: DataFrame, days: int, top: int) -> DataFrame:
    """(query_id, place, hit_id): the best ``top`` hits of each query among those within ``days`` before it, bounds included."""
    span = days * 86_400_000_000
    rows = hits.join(queries.select("query_id", F.col("us").alias("q_us")), "query_id").where((F.col("us") <= F.col("q_us")) & (F.col("us") >= F.col("q_us") - span))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", "place", "hit_id")


def earliest_per_text(queries: DataFrame, most_words: int = 3) -> DataFrame:
    """(text, id) of the first query of each lower-case text of at most ``most_words`` words."""
    rows = queries.withColumn("text", F.lower(F.trim("text"))).where((F.col("text") != "") & (F.size(F.split("text", r"\s+")) <= most_words))
    return rows.groupBy("text").agg(F.min_by("id", F.struct("ts", "id")).alias("id"))


def knee(sweep: DataFrame, share: float = 0.01) -> DataFrame:
    """One row: the smallest k whose score is within ``share`` of the best in ``sweep(k, score)``."""
    best = sweep.agg(F.max("score").alias("best"))
    return sweep.join(F.broadcast(best)).where(F.col("score") >= F.col("best") * (1 - share)).agg(F.min("k").alias("k"))  # one row


def movement(ranks: DataFrame) -> DataFrame:
    """One row of how ranks changed in ``ranks(before, after)``: up, down, same, from five and below into the first three."""
    b, a = F.col("before"), F.col("after")
    return ranks.where("before IS NOT NULL AND after IS NOT NULL").agg(F.count_if(a < b).alias("up"), F.count_if(a > b).alias("down"), F.count_if(a == b).alias("same"), F.count_if((b >= 5) & (a <= 3)).alias("into_top3"))


def votes(judged: DataFrame) -> DataFrame:
    """(id, n, relevant): majority of the votes per id; half is no majority."""
    return judged.where("vote IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), (F.count_if("vote") * 2 > F.count("*")).alias("relevant"))


def run_window(items: DataFrame) -> DataFrame:
    """One row: first and last (ingested_at, id) of a run's items, their number, and a sum that tells item sets apart whatever their order."""
    at = F.struct(F.unix_micros("ingested_at").alias("us"), "id")
    c = items.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.sum(hash_bucket(F.col("id"), 1 << 31)).alias("checksum"))
    return c.select(F.col("a.us").alias("first_us"), F.col("a.id").alias("first_id"), F.col("b.us").alias("last_us"), F.col("b.id").alias("last_id"), "n", "checksum")
