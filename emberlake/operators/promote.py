"""Candidates for a curated tier: bands of similarity, admission, rejection, event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of where an item comes from, and of the admission score's parts.
PROVENANCE = {"curated": 1.00, "authored": 0.92, "structured": 0.90, "conversational": 0.82, "imported": 0.80, "inferred": 0.70}
FLOOR = 0.70
ADMISSION = {"novelty": 0.35, "utility": 0.25, "confidence": 0.20, "trust": 0.20}
ENOUGH_SOURCES = 6


def provenance_class(source: Column, inferred: Column, promoted: Column) -> Column:
    s = F.lower(F.trim(source))
    return (
        F.when(promoted, "curated").when(s == "tier2_ledger", "curated").when(s.isin("email", "calendar"), "authored").when(s == "github", "structured")
        .when(s.isin("imessage", "signal", "teams"), "conversational").when(s.isin("obsidian", "folder"), "imported").when(inferred, "inferred").otherwise("conversational")
    )


def provenance_weight(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in PROVENANCE.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(kind))), F.lit(FLOOR))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def effective_confidence(base: Column, kind: Column, validations: Column) -> Column:
    return clamp(clamp(base) * provenance_weight(kind) + F.least(0.03 * F.greatest(F.lit(0), validations), F.lit(0.15)))


def trust_level(confidence: Column, contradicted: Column, superseded: Column) -> Column:
    return F.when(superseded | contradicted, "low").when(confidence >= 0.85, "high").when(confidence >= 0.60, "medium").otherwise("low")


def band(similarity: Column, same: float = 0.92, near: float = 0.80) -> Column:
    """duplicate, merge or new by the best similarity to what is known; null: new."""
    return F.when(similarity >= same, "duplicate").when(similarity >= near, "merge").otherwise("new")


def admission(similarity: Column, terms: Column, known_terms: Column, trust: Column, sources: Column) -> Column:
    """The admission score from novelty, containment of terms in known ones, corroboration and trust."""
    novelty = 1 - clamp(F.coalesce(similarity, F.lit(0.0)))
    utility = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, known_terms)) / F.size(F.array_distinct(terms))).otherwise(0.0)
    return clamp(ADMISSION["novelty"] * novelty + ADMISSION["utility"] * utility + ADMISSION["confidence"] * clamp(sources / ENOUGH_SOURCES) + ADMISSION["trust"] * trust)


def newest_per_entity(links: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(entity_id, place, item_id): the ``k`` newest items of each entity, ties by id.

    Only ids and times travel; a hot entity's rows are cut to ``k`` per hash block before they meet.
    """
    rows = links.join(items.select(F.col("id").alias("item_id"), "timestamp"), "item_id").where("timestamp IS NOT NULL")
    order = [F.desc("timestamp"), "item_id"]
    part = rows.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(32)))
    part = part.withColumn("_k", F.row_number().over(Window.partitionBy("entity_id", "_b").orderBy(*order))).where(F.col("_k") <= k)
    return part.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where(F.col("place") <= k).select("entity_id", "place", "item_id")


def event_times(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(candidate_id, event_ts, inferred): earliest timestamp of a candidate's items, inferred if any is; none known: no row."""
    rows = candidates.select("candidate_id", F.explode("source_item_ids").alias("id")).join(items.select("id", "timestamp", "timestamp_inferred"), "id")
    return rows.groupBy("candidate_id").agg(F.min("timestamp").alias("event_ts"), F.bool_or(F.coalesce("timestamp_inferred", F.lit(False))).alias("inferred"))


def not_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates without a rejected one of their id or sharing an item with one of the same entity."""
    by_id = candidates.join(rejected.select("candidate_id").distinct(), "candidate_id", "left_anti")
    used = rejected.select("entity_id", F.explode("source_item_ids").alias("item")).distinct()
    hit = by_id.select("candidate_id", "entity_id", F.explode("source_item_ids").alias("item")).join(used, ["entity_id", "item"]).select("candidate_id").distinct()
    return by_id.join(hit, "candidate_id", "left_anti")
