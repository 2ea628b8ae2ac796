"""Who took part: links from senders and recipients to people, allow lists, exchanges, the cases that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import identity_key
from emberlake.operators.blocks import BLOCK_US


def identity_map(entities: DataFrame) -> DataFrame:
    """(key, entity_id): canonical names of people not denied, and aliases that only one of them has."""
    people = entities.where("entity_type = 'person' AND coalesce(pending_review, 0) <> 2")
    named = people.select(identity_key(F.col("canonical_name")).alias("key"), F.col("id").alias("entity_id")).where("key <> ''").groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    other = people.select(F.explode("aliases").alias("a"), F.col("id").alias("entity_id")).select(identity_key(F.col("a")).alias("key"), "entity_id").where("key <> ''")
    single = other.groupBy("key").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1").select("key", "entity_id")
    return named.unionByName(single.join(named, "key", "left_anti"))


def participant_links(items: DataFrame, entities: DataFrame, own: tuple[str, ...] = ("me",)) -> DataFrame:
    """(item_id, entity_id): each item's sender and recipients that name one person. ``own`` identities link nobody."""
    people = F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>")))
    said = items.select(F.col("id").alias("item_id"), F.explode(people).alias("p")).select("item_id", identity_key(F.col("p")).alias("key"))
    said = said.where((F.col("key") != "") & ~F.col("key").isin(*own)).distinct()
    return said.join(identity_map(entities), "key").select("item_id", "entity_id").distinct()


def items_of_participants(items: DataFrame, identities: list[str]) -> DataFrame:
    """(id) of items that one of ``identities`` sent or received, by exact text."""
    got = F.exists(F.coalesce("recipients", F.array().cast("array<string>")), lambda r: r.isin(*identities))
    return items.where(F.col("sender").isin(*identities) | got).select("id")


def exchanges(items: DataFrame, person: list[str], own: list[str], window_hours: float = 2) -> DataFrame:
    """(id) of messages that one of two parties sent and that are part of an exchange between them.

    Direct to the other party alone, or the other party wrote in the same thread within ``window_hours``,
    bounds included. Items without thread stand alone. ``person`` and ``own``: identities in any spelling of case.
    """
    p, o = ([x.strip().lower() for x in xs] for xs in (person, own))
    key = identity_key(F.col("sender"))
    role = F.when(key.isin(*o), "o").when(key.isin(*p), "p")
    rows = items.where("timestamp IS NOT NULL").select("id", F.coalesce("thread_id", "id").alias("thread"), F.unix_micros("timestamp").alias("us"), role.alias("role"), "recipients").where("role IS NOT NULL")
    only = identity_key(F.get("recipients", F.lit(0)))
    direct = F.coalesce((F.size("recipients") == 1) & F.when(F.col("role") == "o", only.isin(*p)).otherwise(only.isin(*o)), F.lit(False))
    span = int(window_hours * 3600 * 1_000_000)
    # A row counts in its own block of time and, for the rows there, in the next one it reaches.
    block = max(BLOCK_US, span)
    at = lambda us: F.floor(us / block)
    reached = F.array_distinct(F.array(at(F.col("us")), at(F.col("us") - span), at(F.col("us") + span)))
    rows = rows.withColumn("direct", direct).withColumn("_own", at(F.col("us"))).withColumn("_block", F.explode(reached))
    w = Window.partitionBy("thread", "_block").orderBy("us").rangeBetween(-span, span)
    near = {r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).over(w) for r in ("o", "p")}
    met = F.when(F.col("role") == "o", near["p"]).otherwise(near["o"]) > 0
    return rows.withColumn("met", met).where("_block = _own AND (direct OR met)").select("id")


def talks(items: DataFrame, entities: DataFrame, own: list[str], window_hours: float = 2) -> DataFrame:
    """(entity_id, item_id, thread, us, talk) for each person and item that they sent or got: whether it is part of an exchange with the owner.

    The rule of ``exchanges`` for all people at once. Items without time are left out; those that a third party sent are no talk. A thread's rows
    meet in blocks of time, the owner's once for all people and a person's own with those the owner sent to them.
    """
    mine = [x.strip().lower() for x in own]
    span = int(window_hours * 3600 * 1_000_000)
    block = max(BLOCK_US, span)
    at = lambda us: F.floor(us / block)
    reached = F.array_distinct(F.array(at(F.col("us")), at(F.col("us") - span), at(F.col("us") + span)))
    by = identity_key(F.col("sender"))
    rows = items.where("timestamp IS NOT NULL").select(
        F.col("id").alias("item_id"), F.coalesce("thread_id", "id").alias("thread"), F.unix_micros("timestamp").alias("us"), by.alias("by"), by.isin(*mine).alias("sent"),
        F.when(F.size("recipients") == 1, identity_key(F.get("recipients", F.lit(0)))).alias("only"), F.coalesce("recipients", F.array().cast("array<string>")).alias("recipients"),
    )
    keys = F.array_distinct(F.concat(F.array("by"), F.transform("recipients", identity_key)))
    said = rows.select("item_id", "thread", "us", "by", "sent", "only", F.explode(keys).alias("key")).where((F.col("key") != "") & ~F.col("key").isin(*mine))
    said = said.join(identity_map(entities), "key")
    role = F.when(F.col("sent"), "o").when(F.col("by") == F.col("key"), "p")
    direct = F.when(F.col("sent"), F.col("only").isNotNull()).otherwise(F.col("only").isin(*mine))
    # A person may stand in one item under two keys.
    links = said.groupBy("entity_id", "item_id").agg(F.first("thread").alias("thread"), F.first("us").alias("us"), F.max(role).alias("role"), F.max(F.coalesce(direct, F.lit(False))).alias("direct"))
    near = lambda part, who: F.sum(F.when(F.col("role") == who, 1).otherwise(0)).over(Window.partitionBy(*part).orderBy("us").rangeBetween(-span, span))
    spread = lambda df: df.withColumn("_own", at(F.col("us"))).withColumn("_block", F.explode(reached))
    # Where the person wrote: has the owner, in the thread at all?
    theirs = spread(links.where("role = 'p'").select("thread", "us", "item_id", "role").distinct().unionByName(rows.where("sent").select("thread", "us", "item_id", F.lit("o").alias("role"))))
    answered = theirs.withColumn("n", near(["thread", "_block"], "o")).where("role = 'p' AND _block = _own AND n > 0").select("item_id")
    # Where the owner wrote to the person: has the person?
    both = spread(links.where("role IS NOT NULL").select("entity_id", "item_id", "thread", "us", "role"))
    heard = both.withColumn("n", near(["entity_id", "thread", "_block"], "p")).where("role = 'o' AND _block = _own AND n > 0").select("entity_id", "item_id")
    met = links.where("role = 'p'").select("entity_id", "item_id").join(answered, "item_id", "left_semi").select("entity_id", "item_id").unionByName(heard).withColumn("met", F.lit(True))
    out = links.join(met, ["entity_id", "item_id"], "left")
    talk = F.col("role").isNotNull() & (F.col("direct") | F.coalesce("met", F.lit(False)))
    return out.select("entity_id", "item_id", "thread", "us", talk.alias("talk"))


def contact_cases(talked: DataFrame, least: int, first: bool = False, window_hours: float = 2) -> DataFrame:
    """(entity_id, item_id, anchor): the items that answer when the owner last (or ``first``) spoke with each person of at least ``least`` items.

    ``talked``: of ``talks``. The anchor is the latest (earliest) item of an exchange, of equal times the one with the smaller id; the answers are the exchange's
    items in its thread within ``window_hours`` of it. People without an exchange have no case.
    """
    span = int(window_hours * 3600 * 1_000_000)
    key = F.struct(F.when(F.lit(first), F.col("us")).otherwise(-F.col("us")).alias("t"), F.col("item_id").alias("i"), F.col("thread").alias("thread"))
    people = talked.groupBy("entity_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("talk"), key)).alias("a")).where((F.col("n") >= least) & F.col("a").isNotNull())
    people = people.select("entity_id", F.col("a.i").alias("anchor"), F.col("a.thread").alias("thread"), F.abs("a.t").alias("_at"))
    rows = talked.where("talk").join(people, ["entity_id", "thread"])
    return rows.where(F.abs(F.col("us") - F.col("_at")) <= span).select("entity_id", "item_id", "anchor")
