"""Tagging texts with entities, their association, and keeping the entity table clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import junk_reasons, merge_key, tidy_name, tokens

def name_table(entities: DataFrame) -> DataFrame:
    """(entity_id, name, first, k): canonical names and aliases of entities that are not denied, as token strings of k tokens."""
    names = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.where("coalesce(pending_review, 0) <> 2").select(F.col("id").alias("entity_id"), F.explode(names).alias("n"))
    t = rows.select("entity_id", tokens(F.col("n")).alias("t")).where(F.size("t") > 0)
    return t.select("entity_id", F.array_join("t", " ").alias("name"), F.col("t")[0].alias("first"), F.size("t").alias("k")).distinct()


def dictionary_tags(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id, n): how often each entity's name or alias stands in ``texts(id, text)``, as whole tokens.

    A run of tokens is built only where a name's first token stands, and only as long as a name that begins
    so; the runs join the names on their text. Names may have any number of tokens. A name
    inside a longer match of the same text does not count. ``id`` is unique; null and empty texts hold nothing.
    """
    names = name_table(entities)
    rows = texts.select("id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    begin = names.groupBy("first").agg(F.collect_set("k").alias("ks"))  # few lengths a token
    hits = rows.select("id", F.posexplode("t").alias("at", "first")).join(begin, "first").groupBy("id").agg(F.collect_list(F.struct("at", "ks")).alias("hits"))
    runs = rows.join(hits, "id").select("id", "t", F.explode("hits").alias("h")).select("id", "t", "h.at", F.explode("h.ks").alias("k")).where(F.col("at") + F.col("k") <= F.size("t"))
    runs = runs.select("id", "at", "k", F.array_join(F.slice("t", F.col("at") + 1, F.col("k")), " ").alias("name"))
    met = runs.join(names.select("name").distinct(), "name")
    # Inside a longer one: an earlier start, or the same one with more tokens, that ends no sooner.
    reach = F.max(F.col("at") + F.col("k")).over(Window.partitionBy("id").orderBy("at", F.desc("k")).rowsBetween(Window.unboundedPreceding, -1))
    whole = met.withColumn("reach", reach).where((F.col("reach") < F.col("at") + F.col("k")) | F.col("reach").isNull())
    return whole.select("id", "name").join(names.select("name", "entity_id"), "name").groupBy("id", "entity_id").agg(F.count("*").alias("n"))


def npmi(links: DataFrame, item: str, entity: str, least_together: int = 3, least_score: float = 0.15) -> DataFrame:
    """(entity_a, entity_b, score, cooccur), both directions: normalised pointwise mutual information.

    Entities below ``least_together`` items can be in no pair, so they are dropped before the self-join.
    """
    links = links.select(F.col(item).alias("item"), F.col(entity).alias("entity")).where("item IS NOT NULL AND entity IS NOT NULL").distinct()
    total = links.agg(F.count_distinct("item").cast("double").alias("total"))
    counts = links.groupBy("entity").agg(F.count("*").alias("c"))
    often = links.join(counts.where(F.col("c") >= least_together).select("entity"), "entity", "left_semi")
    pairs = often.select("item", F.col("entity").alias("entity_a")).join(often.select("item", F.col("entity").alias("entity_b")), "item").where("entity_a < entity_b")
    pairs = pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("cooccur")).where(F.col("cooccur") >= least_together)
    pairs = pairs.join(counts.withColumnsRenamed({"entity": "entity_a", "c": "ca"}), "entity_a").join(counts.withColumnsRenamed({"entity": "entity_b", "c": "cb"}), "entity_b")
    pairs = pairs.join(F.broadcast(total))  # one row
    p = F.col("cooccur") / F.col("total")
    pmi = F.log(p / (F.col("ca") / F.col("total") * F.col("cb") / F.col("total")))
    score = F.when(p < 1, F.least(F.lit(1.0), pmi / -F.log(p))).otherwise(1.0)
    kept = pairs.withColumn("pmi", pmi).withColumn("score", score).where((F.col("pmi") > 0) & (F.col("score") >= least_score))
    out = ["entity_a", "entity_b", "score", "cooccur"]
    return kept.select(*out).unionByName(kept.select(F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b"), "score", "cooccur"))


def resolve_associations_of(learned: DataFrame, manual: DataFrame, wanted: DataFrame, least: float = 0.15) -> DataFrame:
    """(entity, weight) reached from ``wanted(entity)``: learned edges, replaced or suppressed by ``manual(entity_a, entity_b, weight, suppress)``.

    No entity of ``wanted`` is returned; of several edges to one entity the heaviest counts.
    """
    seed = wanted.select(F.col("entity").alias("entity_a")).distinct()
    edges = learned.where(F.col("score") >= least).join(seed, "entity_a", "left_semi").select("entity_a", "entity_b", F.col("score").alias("learned"))
    own = manual.join(seed, "entity_a", "left_semi").select("entity_a", "entity_b", "weight", "suppress")
    both = edges.join(own, ["entity_a", "entity_b"], "full_outer").where("NOT coalesce(suppress, false)")
    out = both.groupBy(F.col("entity_b").alias("entity")).agg(F.max(F.coalesce("weight", "learned")).alias("weight"))
    return out.join(wanted.select("entity"), "entity", "left_anti")


def weights_of_items(links: DataFrame, weights: DataFrame) -> DataFrame:
    """(item_id, weight): the best weight among an item's entities."""
    return links.join(weights.select(F.col("entity").alias("entity_id"), "weight"), "entity_id").groupBy("item_id").agg(F.max("weight").alias("weight"))


def normalised_groups(entities: DataFrame, uses: DataFrame) -> DataFrame:
    """(norm, entity_type, survivor, n): entities whose tidied names are equal but for case; the tidy, most used, shortest one survives.

    ``uses(entity_id, n)``: number of links.
    """
    rows = entities.where("coalesce(pending_review, 0) <> 2 AND canonical_name IS NOT NULL").join(uses.select(F.col("entity_id").alias("id"), F.col("n").alias("uses")), "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    tidy = tidy_name(F.col("canonical_name"), F.col("entity_type"))
    rows = rows.withColumn("tidy", tidy).withColumn("norm", F.lower(tidy)).where("norm <> ''")
    order = F.struct((F.col("canonical_name") != F.col("tidy")).alias("untidy"), -F.col("uses"), F.length("canonical_name"), "id")
    return rows.groupBy("norm", "entity_type").agg(F.min_by("id", order).alias("survivor"), F.count("*").alias("n")).where("n > 1")


def merge_suggestions(entities: DataFrame) -> DataFrame:
    """(key, entity_type, ids): entities not denied whose names agree but for case, signs and legal form."""
    rows = entities.where("coalesce(pending_review, 0) <> 2").select("id", "entity_type", merge_key(F.col("canonical_name")).alias("key")).where("key <> ''")
    return rows.groupBy("key", "entity_type").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def prune_candidates(entities: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, canonical_name, n, reasons) of pending entities that look like no entity."""
    rows = entities.where("pending_review = 1 AND canonical_name IS NOT NULL").withColumn("reasons", junk_reasons(F.col("canonical_name"))).where(F.size("reasons") > 0)
    return rows.join(uses.select(F.col("entity_id").alias("id"), "n"), "id", "left").select("id", "canonical_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "reasons")


def with_all(pairs: DataFrame, entity: str, constraint: str, wanted: list[str]) -> DataFrame:
    """(entity) that meet all ``wanted`` constraints."""
    return pairs.where(F.col(constraint).isin(wanted)).groupBy(entity).agg(F.count_distinct(constraint).alias("n")).where(F.col("n") == len(set(wanted))).select(entity)


def orphans(links: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of ``links`` whose entity is gone; rows with a null key are orphans too."""
    return links.join(entities.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def alias_inventory(origins: dict[str, DataFrame]) -> DataFrame:
    """(alias, canonical, origins): aliases from several tables (canonical, aliases), with where each is found."""
    rows = [df.select(F.explode("aliases").alias("alias"), "canonical", F.lit(name).alias("origin")) for name, df in origins.items()]
    return reduce(DataFrame.unionByName, rows).where("trim(alias) <> ''").groupBy("alias", "canonical").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))


def any_of(column: Column, wanted: list[str] | None) -> Column:
    """A filter that is off where nothing is wanted."""
    return F.lit(True) if not wanted else column.isin(wanted)
