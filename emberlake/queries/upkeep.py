"""Queries that keep the store in order or report on it, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import abbreviations
from emberlake.operators import consolidate, evaluate, lexical, people, signals, upkeep
from emberlake.plans import retrieve
from emberlake.queries.relational import _CAPPED, _KEY, _LINKS, _USAGE, ITEMS, _items, _log, _members
from emberlake.session import stage
from emberlake.sources import store
from emberlake.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, d: str) -> DataFrame:
    return people.participant_links(_items(spark, d), table(spark, d, "entities"))


# Links of two kinds: those of every fifth entity come from tagging, the rest from taking part.
_SOURCED = f"""{_LINKS}, sl AS (SELECT item_id, entity_id, 1.0::DOUBLE AS confidence, CASE WHEN entity_id % 5 = 0 THEN 'dictionary' ELSE 'participant' END AS source FROM links),
tg AS (SELECT item_id, entity_id + 1 AS entity_id, 0.5::DOUBLE AS confidence, 'ner' AS source FROM sl WHERE entity_id % 5 < 2)"""


def _sourced(spark, d):
    links = _links(spark, d).select("item_id", "entity_id", F.lit(1.0).alias("confidence"), F.when(F.col("entity_id") % 5 == 0, "dictionary").otherwise("participant").alias("source"))
    tags = links.where("entity_id % 5 < 2").select("item_id", (F.col("entity_id") + 1).alias("entity_id"), F.lit(0.5).alias("confidence"), F.lit("ner").alias("source"))
    return links, tags


@query(f"""WITH {_SOURCED}, k AS (SELECT * FROM sl WHERE source = 'participant' OR item_id NOT IN (SELECT item_id FROM tg))
    SELECT * FROM k UNION ALL SELECT DISTINCT * FROM tg WHERE (item_id, entity_id) NOT IN (SELECT (item_id, entity_id) FROM k)""")
def links_replace(spark, d):
    links, tags = _sourced(spark, d)
    return upkeep.links_after_tagging(links, tags, tags)


@query(f"""WITH {_LINKS}, c AS (SELECT 'c' || entity_id % 500 AS id, entity_id AS run_id, min(item_id) AS statement FROM links GROUP BY entity_id),
    s AS (SELECT id, min(run_id) AS run_id, arg_min(statement, run_id) AS statement FROM c WHERE run_id % 2 = 0 GROUP BY id), n AS (SELECT id, min(run_id) AS run_id, arg_min(statement, run_id) AS statement FROM c WHERE id NOT IN (SELECT id FROM s) GROUP BY id)
    SELECT * FROM s UNION ALL SELECT * FROM n""")
def candidates_first_owner(spark, d):
    drafts = _links(spark, d).groupBy(F.col("entity_id").alias("run_id")).agg(F.min("item_id").alias("statement")).select(F.concat(F.lit("c"), (F.col("run_id") % 500).cast("string")).alias("id"), "run_id", "statement")
    none = drafts.limit(0)
    stored = upkeep.first_owner(none, drafts.where("run_id % 2 = 0"), "run_id")
    return upkeep.first_owner(stored, drafts, "run_id")


_MARKED = f"""{_CAPPED}, cs AS (SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS cid, source, ids, item_count FROM c)"""


@query(f"WITH {_MARKED} SELECT d.id, max(CASE WHEN cs.source = 'signal' THEN NULL ELSE cid END) AS consolidated_into FROM d LEFT JOIN (SELECT cid, source, unnest(ids) AS i FROM cs) cs ON cs.i = d.id GROUP BY d.id")
def sessions_cleared(spark, d):
    sessions = stage(consolidate.consolidations(_members(spark, d)), "sessions")
    items = stage(store.mark_consolidated(_items(spark, d).select("id", F.lit(None).cast("string").alias("consolidated_into")), sessions), "items")
    return upkeep.without_sessions(items, sessions, ["signal"])[0].select("id", "consolidated_into")


@query(f"WITH {_CAPPED} SELECT source, count(*)::BIGINT AS sessions, sum(item_count)::BIGINT AS items FROM c GROUP BY source")
def session_stats(spark, d):
    return consolidate.consolidations(_members(spark, d)).groupBy("source").agg(F.count("*").alias("sessions"), F.sum("item_count").alias("items"))


@query(f"WITH {_LINKS} SELECT DISTINCT item_id AS id FROM links JOIN entities e ON e.id = entity_id WHERE lower(canonical_name) LIKE 'a%'")
def entity_allowlist(spark, d):
    """Items linked to an entity of one of many names: here all that begin with an a."""
    entities = table(spark, d, "entities")
    names = entities.where("lower(canonical_name) LIKE 'a%'")
    return _links(spark, d).join(names.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("item_id").alias("id")).distinct()


@query(f"""WITH {_LINKS}, a AS (SELECT DISTINCT item_id AS id FROM links JOIN entities e ON e.id = entity_id WHERE lower(canonical_name) IN ('kerem yttereskvombek', 'mei tuvlgard'))
    SELECT id FROM a WHERE id IN (SELECT id FROM d WHERE sender = 'me' OR list_contains(coalesce(recipients, []), 'me'))""")
def allowlist_and(spark, d):
    ids, _ = retrieve.entity_allowlist(_links(spark, d), table(spark, d, "entities"), ["Kerem Yttereskvombek", "Mei Tuvlgard"])
    return ids.join(people.items_of_participants(_items(spark, d), ["me"]), "id", "left_semi")


@query(f"""WITH {_MARKED}, w AS (SELECT id FROM d WHERE sender = 'me' OR list_contains(coalesce(recipients, []), 'me'))
    SELECT DISTINCT cid AS id FROM (SELECT cid, unnest(ids) AS i FROM cs) WHERE i IN (SELECT id FROM w) UNION SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) FROM c WHERE list_contains(senders, 'me')""")
def participant_sessions(spark, d):
    sessions = stage(consolidate.consolidations(_members(spark, d)).withColumnRenamed("consolidation_id", "id"), "sessions")
    return retrieve.participant_sessions(sessions, ["me"], people.items_of_participants(_items(spark, d), ["me"]))


@query(f"""WITH {_LINKS}, a AS (SELECT DISTINCT item_id AS id FROM links WHERE entity_id % 10 = 0), r AS (SELECT d.id, epoch_us(timestamp) AS us FROM d JOIN a USING (id) WHERE NOT coalesce(timestamp_inferred, false) ORDER BY timestamp DESC, id LIMIT 20)
    SELECT id, row_number() OVER (ORDER BY us DESC, id)::BIGINT AS place FROM r""")
def browse_allowlist(spark, d):
    """The newest items of an allow list in order of time: a question for the last occurrence that no word matches."""
    items = stage(_items(spark, d), "items")
    allowed = _links(spark, d).where("entity_id % 10 = 0").select(F.col("item_id").alias("id"))
    cfg = retrieve.HybridConfig(sort="desc", allowed=allowed, occurrence_browse=True, top_k=20)
    return retrieve.hybrid(items, {"q": "zzzzunheardof"}, cfg).select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_LINKS}, u AS (SELECT entity_id FROM links WHERE entity_id % 3 > 0 UNION SELECT id FROM entities WHERE id % 7 = 0 UNION SELECT id + 1 FROM entities WHERE id % 11 = 0)
    SELECT id FROM entities WHERE pending_review = 1 AND id NOT IN (SELECT entity_id FROM u) AND lower(canonical_name) NOT IN (SELECT lower(canonical_name) FROM entities WHERE id % 13 = 0)""")
def vacuum_entities(spark, d):
    """Pending entities that nothing uses; links of a third of the entities, and some tags, relations and candidates, are planted away or in."""
    e = table(spark, d, "entities")
    links, tags = _links(spark, d).where("entity_id % 3 > 0"), e.where("id % 7 = 0").select(F.col("id").alias("entity_id"))
    relations = e.where("id % 11 = 0").select((F.col("id") + 1).alias("from_entity"), (F.col("id") + 1).alias("to_entity"))
    uses = [(links, "entity_id"), (tags, "entity_id"), (relations, "from_entity"), (relations, "to_entity")]
    return upkeep.unused_entities(e, uses, e.where("id % 13 = 0").select(F.col("canonical_name").alias("entity")))


@query("""WITH dic AS (SELECT upper(canonical_name) AS canonical_name, entity_type, aliases FROM entities WHERE id % 4 = 0), o AS (SELECT lower(canonical_name) AS k, min((canonical_name, entity_type)) AS x FROM dic GROUP BY 1)
    SELECT e.id, coalesce(x[1], e.canonical_name) AS canonical_name, coalesce(x[2], e.entity_type) AS entity_type, CASE WHEN k IS NULL THEN pending_review ELSE 0 END::INT AS pending_review FROM entities e LEFT JOIN o ON lower(e.canonical_name) = k""")
def entities_seeded(spark, d):
    e = table(spark, d, "entities")
    return upkeep.seeded(e, e.where("id % 4 = 0").withColumn("canonical_name", F.upper("canonical_name"))).select("id", "canonical_name", "entity_type", "pending_review")


@query("""WITH x AS (SELECT lower(canonical_name) AS k, id, canonical_name, unnest(list_concat([NULL], coalesce(aliases, []))) AS a, generate_subscripts(list_concat([NULL], coalesce(aliases, [])), 1) AS n FROM entities WHERE trim(canonical_name) <> '')
    SELECT arg_min(canonical_name, (id, n)) AS canonical, count(DISTINCT a)::BIGINT AS n_aliases FROM x GROUP BY k""")
def dictionary_dedupe(spark, d):
    rows = upkeep.dictionary_groups(table(spark, d, "entities").select(F.col("id").alias("place"), F.col("canonical_name").alias("canonical"), "aliases"))
    return rows.select("canonical", F.size(F.array_compact("aliases")).cast("long").alias("n_aliases"))


_IDENTITY = _KEY.format("name")


@query(f"""WITH n AS (SELECT id AS place, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS name, generate_subscripts(list_concat([canonical_name], coalesce(aliases, [])), 1) AS n, id % 2 = 0 AS dic FROM entities WHERE entity_type = 'person'),
    k AS (SELECT place, n, dic, {_IDENTITY} AS key FROM n WHERE name IS NOT NULL), o AS (SELECT key, min(place) AS owner FROM k WHERE dic AND key <> '' GROUP BY key)
    SELECT place, arg_min(owner, n) AS owner FROM k JOIN o USING (key) WHERE NOT dic GROUP BY place""")
def identity_owners(spark, d):
    """People of odd ids that entries of even ids know by a name or an alias."""
    rows = table(spark, d, "entities").where("entity_type = 'person'").select(F.col("id").alias("place"), F.col("canonical_name").alias("canonical"), "aliases")
    return upkeep.owners_of(rows.where("place % 2 <> 0"), rows.where("place % 2 = 0"))


@query("""WITH t AS (SELECT o_custkey AS item_id, 'P' || (o_orderkey % 3) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'dictionary' ELSE 'ner' END AS source, o_totalprice AS confidence FROM orders
      UNION ALL SELECT o_custkey, 'p' || (o_orderkey % 3), 'ner', o_totalprice FROM orders)
    SELECT item_id, name, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(name) ORDER BY source <> 'dictionary', confidence DESC, name) AS k FROM t) WHERE k = 1""")
def tag_dedupe(spark, d):
    o = table(spark, d, "orders")
    no = (F.col("o_orderkey") % 3).cast("string")
    rows = lambda head, source: o.select(F.col("o_custkey").alias("item_id"), F.concat(F.lit(head), no).alias("name"), source.alias("source"), F.col("o_totalprice").alias("confidence"))
    return upkeep.best_tags(rows("P", F.when(F.col("o_orderkey") % 2 == 0, "dictionary").otherwise("ner")).unionByName(rows("p", F.lit("ner"))))


_VERDICT = f"""{ITEMS}, i AS (SELECT id, CASE WHEN length(content) % 10 = 0 THEN 'mech:short' WHEN length(content) % 10 < 4 THEN 'old' END AS junk_reason, length(content) AS n FROM d),
v AS (SELECT id, CASE WHEN n % 4 = 0 THEN n % 3 = 0 ELSE n % 3 > 0 END AS junk FROM i WHERE n % 5 > 0), p AS (SELECT id FROM i WHERE n % 7 = 0)"""


def _judged(spark, d):
    items = _items(spark, d).select("id", F.length("content").alias("n"))
    items = items.select("id", "n", F.when(F.col("n") % 10 == 0, "mech:short").when(F.col("n") % 10 < 4, "old").alias("junk_reason"))
    files = items.where("n % 5 > 0").select("id", F.lit(1).alias("rank"), (F.col("n") % 3 > 0).alias("junk"))
    owner = items.where("n % 5 > 0 AND n % 4 = 0").select("id", F.lit(2).alias("rank"), (F.col("n") % 3 == 0).alias("junk"))
    return items, files.unionByName(owner), items.where("n % 7 = 0")


@query(f"""WITH {_VERDICT} SELECT id, junk_reason AS before, CASE WHEN junk THEN 'new' END AS after FROM i JOIN v USING (id)
    WHERE junk AND junk_reason IS NULL AND id NOT IN (SELECT id FROM p) OR NOT junk AND junk_reason = 'old'""")
def verdict_apply(spark, d):
    items, verdicts, protected = _judged(spark, d)
    return upkeep.verdict_changes(items, verdicts, protected, "old", "new")


@query(f"WITH {_VERDICT} SELECT id, junk_reason FROM i")
def verdict_undo(spark, d):
    """Applied and taken back: every item is as it was."""
    items, verdicts, protected = _judged(spark, d)
    changes = stage(upkeep.verdict_changes(items, verdicts, protected, "old", "new"), "changes")
    return upkeep.with_changes(upkeep.with_changes(items, changes), changes, undo=True).select("id", "junk_reason")


@query(f"WITH {ITEMS} SELECT id FROM entities WHERE lower(canonical_name) NOT IN (SELECT lower(subject) FROM d WHERE source = 'tier2_ledger' AND subject IS NOT NULL)")
def covered_titles(spark, d):
    return upkeep.open_names(table(spark, d, "entities"), _items(spark, d)).select("id")


@query(f"""WITH {ITEMS}, q AS (SELECT id AS query_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM d), tk AS (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM q),
    g AS (SELECT DISTINCT query_id, array_to_string(t[i:i + k - 1], ' ') AS name FROM tk, (SELECT unnest([2, 3, 4]) AS k) WHERE i + k - 1 <= len(t)),
    e AS (SELECT id AS entity_id, array_to_string(regexp_extract_all(lower(canonical_name), '[\\p{{L}}\\p{{N}}]+'), ' ') AS name FROM entities WHERE coalesce(pending_review, 0) <> 2)
    SELECT DISTINCT query_id, entity_id FROM g JOIN e USING (name)""")
def names_in_text(spark, d):
    return upkeep.names_in(_items(spark, d).select(F.col("id").alias("query_id"), F.col("content").alias("text")), table(spark, d, "entities"))


@query(f"WITH {_USAGE} SELECT result_id, cited, surfaced FROM usage ORDER BY cited DESC, surfaced DESC, result_id LIMIT 20")
def top_usage(spark, d):
    return signals.item_usage(*_log(spark, d)).orderBy(F.desc("cited"), F.desc("surfaced"), "result_id").limit(20).select("result_id", "cited", "surfaced")


@query("SELECT id, canonical_name, len(aliases)::BIGINT AS n FROM entities ORDER BY len(aliases) DESC NULLS LAST, id LIMIT 100")
def nulls_last_top(spark, d):
    n = F.when(F.col("aliases").isNotNull(), F.size("aliases")).cast("long")
    return table(spark, d, "entities").select("id", "canonical_name", n.alias("n")).orderBy(F.desc_nulls_last("n"), "id").limit(100)


@query("""WITH c AS (SELECT o_orderkey AS no, o_totalprice AS score, o_orderstatus = 'F' AS kept FROM orders), b AS (SELECT *, max(score) FILTER (kept) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (kept)::BIGINT AS kept, count(*) FILTER (score > best)::BIGINT AS improved, count(*) FILTER (score < best)::BIGINT AS fell, max(score) AS best, arg_max(no, (score, -no)) AS best_no, round(max(score) - arg_min(score, no), 4) AS gain FROM b""")
def campaign_summary(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("no"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("kept"))
    return upkeep.campaign(runs).withColumn("gain", F.round("gain", 4))


@query("""WITH g AS (SELECT l_orderkey, max(l_extendedprice) FILTER (l_linenumber = 1) AS g FROM lineitem GROUP BY 1) SELECT l_orderkey, count(*) FILTER (l_extendedprice >= g)::BIGINT AS n FROM lineitem JOIN g USING (l_orderkey) WHERE l_linenumber <> 1 AND g IS NOT NULL GROUP BY 1""")
def at_least_gold(spark, d):
    rows = table(spark, d, "lineitem").withColumn("gold", F.col("l_linenumber") == 1)
    return upkeep.at_least_gold(rows, "l_orderkey", "gold", "l_extendedprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resumable_pass(spark, d):
    return upkeep.still_open(table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey")


@query()
def fuzzy_names(spark, d):
    """How alike each sender and the recipient of its mail are, as texts."""
    rows = _items(spark, d).where("source = 'email' AND sender IS NOT NULL AND size(recipients) > 0").select("sender", F.element_at("recipients", 1).alias("to")).distinct()
    return rows.select("sender", "to", F.round(upkeep.similarity(F.lower("sender"), F.lower("to")), 6).alias("ratio"))


@query()
def request_batches(spark, d):
    return upkeep.bounded_batches(table(spark, d, "documents").select("doc_id", "text"), "text", 64, 20_000).select("doc_id", "batch")


@query()
def threshold_cv(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("score"), (F.col("o_orderstatus") == "F").alias("label"))
    return upkeep.median_threshold(rows, 0.8)


@query()
def alias_relations(spark, d):
    """How often the aliases of each type of entity are identifiers, initials, nicknames or contractions."""
    rows = table(spark, d, "entities").select("entity_type", "canonical_name", F.explode("aliases").alias("alias")).where("trim(alias) <> ''")
    return rows.groupBy("entity_type", abbreviations.relation_type(F.col("alias"), F.col("canonical_name"), F.col("entity_type")).alias("relation")).agg(F.count("*").alias("n"))


_EXPANDED = """m AS (SELECT canonical_name AS long_form, id::VARCHAR AS e, array_to_string([upper(w[1]) FOR w IN regexp_split_to_array(trim(canonical_name), '[\\s/-]+') IF w <> ''], '') AS short_form FROM entities),
f AS (SELECT *, lower(regexp_replace(short_form, '[^\\p{L}\\p{N}_]', '', 'g')) AS k FROM m WHERE length(short_form) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY long_form, short_form) AS r FROM f WHERE k <> ''),
g AS (SELECT k, min_by(long_form, r) AS long_form, string_agg(e, ';' ORDER BY r) AS evidence FROM r WHERE r <= 3 GROUP BY 1),
a AS (SELECT id, unnest(aliases) AS alias FROM entities)"""


@query(f"""WITH {_EXPANDED} SELECT a.id, alias, long_form, evidence FROM a LEFT JOIN g ON k = lower(regexp_replace(alias, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) WHERE trim(alias) <> ''""")
def alias_evidence(spark, d):
    """Every alias with the names that its letters are the initials of; the names stand in for mined long forms, which the test tables hardly have."""
    names = table(spark, d, "entities")
    short = F.upper(abbreviations.initials(F.col("canonical_name")))
    mined = names.select(short.alias("short_form"), F.col("canonical_name").alias("long_form"), F.lit(1).alias("n"), F.col("id").cast("string").alias("evidence")).where("length(short_form) >= 2")
    return abbreviations.with_evidence(names.select("id", F.explode("aliases").alias("alias")).where("trim(alias) <> ''"), mined).select("id", "alias", "long_form", "evidence")


_CASES = f"""{_LINKS}, l AS (SELECT entity_id, item_id, coalesce(thread_id, id) AS thread, epoch_us(timestamp) AS us, {_KEY.format("coalesce(sender, '')")} AS who,
    CASE WHEN len(recipients) = 1 THEN {_KEY.format("coalesce(recipients[1], '')")} END AS sole FROM links JOIN d ON id = item_id WHERE timestamp IS NOT NULL),
o AS (SELECT coalesce(thread_id, id) AS thread, epoch_us(timestamp) AS us FROM d WHERE trim(lower(sender), ' ') = 'me' AND timestamp IS NOT NULL),
rl AS (SELECT l.*, CASE WHEN who = 'me' THEN 'o' WHEN EXISTS (SELECT 1 FROM ids WHERE ids.key = who AND ids.entity_id = l.entity_id) THEN 'p' END AS role FROM l),
t AS (SELECT *, CASE WHEN role = 'o' THEN sole IS NOT NULL OR EXISTS (SELECT 1 FROM rl p WHERE p.entity_id = x.entity_id AND p.thread = x.thread AND p.role = 'p' AND p.us BETWEEN x.us - 7200000000 AND x.us + 7200000000)
    WHEN role = 'p' THEN coalesce(sole = 'me', false) OR EXISTS (SELECT 1 FROM o WHERE o.thread = x.thread AND o.us BETWEEN x.us - 7200000000 AND x.us + 7200000000) ELSE false END AS talk FROM rl x),
n AS (SELECT entity_id FROM t GROUP BY 1 HAVING count(*) >= 3),
a AS (SELECT DISTINCT ON (entity_id) entity_id, item_id AS anchor, thread, us FROM t WHERE talk AND entity_id IN (SELECT entity_id FROM n) ORDER BY entity_id, us DESC, item_id),
c AS (SELECT t.entity_id, t.item_id, anchor FROM t JOIN a ON a.entity_id = t.entity_id AND a.thread = t.thread WHERE talk AND abs(t.us - a.us) <= 7200000000)"""


def _talks(spark, d):
    return stage(people.talks(_items(spark, d), table(spark, d, "entities"), ["me"]), "talks")


@query(f"WITH {_CASES} SELECT * FROM c")
def contact_cases(spark, d):
    """When did I last speak with each person of three items or more: what answers it."""
    return people.contact_cases(_talks(spark, d), 3)


@query(f"""WITH {_CASES}, f AS (SELECT entity_id, item_id, row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, item_id) AS rank FROM t),
    b AS (SELECT c.entity_id, min(rank) FILTER (rank <= 20) AS rank FROM c JOIN f USING (entity_id, item_id) GROUP BY 1)
    SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_at_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_at_10, round(avg(coalesce(1.0 / rank, 0.0)), 6)::DOUBLE AS mrr FROM b""")
def contact_eval(spark, d):
    """How well the newest 20 items linked to a person, talk or not, answer when I last spoke with them."""
    talked = _talks(spark, d)
    found = lexical.top_k(talked.select(F.col("entity_id").alias("query_id"), F.col("item_id").alias("id"), F.col("us").alias("score")), 20)
    right = people.contact_cases(talked, 3).select(F.col("entity_id").alias("query_id"), F.col("item_id").alias("id"))
    m = evaluate.rank_metrics(evaluate.ranks_of(found, right))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "recall_at_10", "mrr")])
