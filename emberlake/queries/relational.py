"""Queries over items, entities and the query log, with the SQL they must equal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators import consolidate, entities as ent, evaluate, people, quality, signals
from emberlake.queries import querylog
from emberlake.tables import distinct_items, table

COLUMNS = ["source", "source_id", "timestamp", "sender", "recipients", "content", "subject", "thread_id", "lang", "raw_metadata", "timestamp_inferred", "junk_reason", "provenance"]
NOW, NOW_SQL = datetime(2024, 1, 31), "epoch_us(TIMESTAMP '2024-01-31')"
MESSAGES = "(source IN ('imessage', 'signal') OR source LIKE 'teams%')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return distinct_items(table(spark, d, "items"), *COLUMNS)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return distinct_items(table(spark, d, "items").where(quality.is_message(F.col("source"))), *COLUMNS)


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return querylog.queries(events), querylog.results(events), querylog.feedback(events)


def _us(c: str):
    return F.unix_micros(c)


ITEMS = "d AS (SELECT DISTINCT ON (id) * FROM items ORDER BY id, ingested_at)"
LOG = """
ev AS (SELECT *, user_id || ':' || (epoch_us(ts) // 86400000000) AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
queries AS (SELECT query_id AS id, max(ts) AS ts, 'Topic ' || (min(k) % 40) AS text, count(*) FILTER (event_type = 'view') AS results_returned,
  CASE sum(k) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'unknown' ELSE 'high' END AS confidence,
  CASE WHEN min(user_id) % 6 = 0 THEN 'test' WHEN min(user_id) % 6 = 1 THEN 'mcp' WHEN min(user_id) % 6 < 5 THEN 'cli' END AS provenance FROM ev GROUP BY query_id),
results AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ts, event_id) AS rank, 'doc-' || k AS result_id, 'src-' || (k % 5) AS source, event_type = 'click' AS cited
  FROM ev WHERE event_type IN ('view', 'click')),
feedback AS (SELECT event_id AS id, query_id, CASE WHEN k % 11 = 0 THEN 'deferred' WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'correction' ELSE 'hit' END
  WHEN event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'bad_result' ELSE 'miss' END ELSE CASE k % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'relevant' ELSE 'thin' END END AS kind,
  'doc-' || k AS result_id, ts FROM ev WHERE event_type IN ('purchase', 'error', 'signup')),
judged AS (SELECT DISTINCT query_id FROM feedback WHERE kind <> 'deferred')
"""


# --- items -----------------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT source, count(*)::BIGINT AS n, epoch_us(min(timestamp))::BIGINT AS first_us, epoch_us(max(timestamp))::BIGINT AS last_us FROM d GROUP BY source")
def source_stats(spark, d):
    return _items(spark, d).groupBy("source").agg(F.count("*").alias("n"), _us(F.min("timestamp")).alias("first_us"), _us(F.max("timestamp")).alias("last_us"))


@query(f"WITH {ITEMS} SELECT coalesce(junk_reason, '') AS junk_reason, count(*)::BIGINT AS n, sum(length(content))::BIGINT AS chars FROM d GROUP BY 1")
def corpus_size(spark, d):
    return _items(spark, d).groupBy(F.coalesce("junk_reason", F.lit("")).alias("junk_reason")).agg(F.count("*").alias("n"), F.sum(F.length("content").cast("long")).alias("chars"))


@query(f"""WITH {ITEMS} SELECT id FROM d WHERE {MESSAGES} AND junk_reason IS NULL AND length(trim(content, ' ')) < 10
    AND NOT regexp_matches(lower(content), '^(liked |loved |emphasized |laughed at |questioned |disliked )')""")
def junk_short(spark, d):
    return _messages(spark, d).where(F.col("junk_reason").isNull() & quality.is_short(F.col("content"))).select("id")


_DUP = """k AS (SELECT content, thread_id, sender, epoch_us(timestamp) // 86400000000 AS day, min(id) AS keep FROM {0} WHERE content IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
dup AS (SELECT r.id FROM {0} r JOIN k ON r.content = k.content AND r.thread_id IS NOT DISTINCT FROM k.thread_id AND r.sender IS NOT DISTINCT FROM k.sender
  AND epoch_us(r.timestamp) // 86400000000 = k.day WHERE r.id <> k.keep)"""


@query(f"WITH {ITEMS}, m AS (SELECT * FROM d WHERE {MESSAGES}), {_DUP.format('m')} SELECT DISTINCT id FROM dup")
def dup_same_day(spark, d):
    return quality.same_day_copies(_messages(spark, d))


@query(f"""WITH {ITEMS}, m AS (SELECT *, CASE WHEN length(trim(content, ' ')) < 10 AND NOT regexp_matches(lower(content), '^(liked |loved |emphasized |laughed at |questioned |disliked )') THEN 'mech:short'
    WHEN source = 'imessage' AND regexp_matches(lower(content), '^(liked |loved |emphasized |laughed at |questioned |disliked )') THEN 'mech:reaction' END AS reason
    FROM d WHERE {MESSAGES} AND junk_reason IS NULL), o AS (SELECT * FROM m WHERE reason IS NULL), {_DUP.format('o')}
    SELECT id, reason AS junk_reason FROM m WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT id, 'mech:dup' FROM dup""")
def junk_annotate(spark, d):
    return quality.annotate(_messages(spark, d))


@query(f"""WITH {ITEMS}, r AS (SELECT id, thread_id, epoch_us(timestamp) AS us, content FROM d WHERE {MESSAGES} AND thread_id IS NOT NULL),
    s AS (SELECT thread_id, us, arg_min(content, id) AS said FROM r GROUP BY ALL),
    n AS (SELECT thread_id, us, substr(coalesce(lag(said) OVER w, ''), 1, 120) AS prev, substr(coalesce(lead(said) OVER w, ''), 1, 120) AS next FROM s WINDOW w AS (PARTITION BY thread_id ORDER BY us))
    SELECT id, prev, next FROM r JOIN n USING (thread_id, us)""")
def context_asof(spark, d):
    return quality.context(_messages(spark, d))


_CAPPED = f"""{ITEMS}, o AS (SELECT *, coalesce(thread_id, '') AS thread_key, epoch_us(timestamp) AS us FROM d WHERE {MESSAGES} AND timestamp IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS opens FROM o WINDOW w AS (PARTITION BY source, thread_key ORDER BY us, id)),
h AS (SELECT *, sum(opens) OVER (PARTITION BY source, thread_key ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS gap FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY source, thread_key, gap ORDER BY us, id) - 1 AS n FROM h),
m AS (SELECT *, n % 5 + 1 AS place, sum(CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, thread_key ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS session_no FROM i),
c AS (SELECT source, thread_key, session_no, min(us)::BIGINT AS start_us, max(us)::BIGINT AS end_us, count(*)::BIGINT AS item_count, list(id ORDER BY us, id) AS ids, list(sender ORDER BY us, id) AS senders
  FROM m GROUP BY ALL HAVING count(*) >= 3)"""


def _members(spark, d):
    return consolidate.capped_sessions(_messages(spark, d), gap_minutes=1440, cap=5)


@query(f"WITH {_CAPPED} SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS consolidation_id, source, thread_key, session_no::BIGINT AS session_no, start_us, end_us, item_count FROM c")
def sessionize_cap(spark, d):
    return consolidate.consolidations(_members(spark, d)).select("consolidation_id", "source", "thread_key", "session_no", "start_us", "end_us", "item_count")


@query(f"""WITH {_CAPPED} SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS consolidation_id, end_us FROM c
    WHERE end_us >= epoch_us(TIMESTAMP '2026-03-20') AND start_us <= epoch_us(TIMESTAMP '2026-03-22 12:00:00')""")
def session_overlap_filter(spark, d):
    since, until = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2026-03-20", "2026-03-22 12:00:00"))
    c = consolidate.consolidations(_members(spark, d))
    return c.where((F.col("end_us") >= since) & (F.col("start_us") <= until)).select("consolidation_id", "end_us")


@query(f"""WITH {_CAPPED} SELECT DISTINCT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS consolidation_id FROM c, unnest(c.ids) AS t(i) JOIN d ON d.id = t.i WHERE d.lang = 'no'""")
def lang_session_exists(spark, d):
    c = consolidate.consolidations(_members(spark, d)).select("consolidation_id", F.explode("raw_item_ids").alias("id"))
    return c.join(_messages(spark, d).where("lang = 'no'").select("id"), "id", "left_semi").select("consolidation_id").distinct()


@query()
def session_summary(spark, d):
    return consolidate.summaries(_members(spark, d))


@query(f"""WITH {ITEMS}, o AS (SELECT *, coalesce(thread_id, '') AS thread_key FROM d WHERE {MESSAGES} AND timestamp IS NOT NULL),
    g AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(sender) OVER w IS NOT DISTINCT FROM sender THEN 0 ELSE 1 END AS c FROM o WINDOW w AS (PARTITION BY source, thread_key ORDER BY timestamp, id)),
    t AS (SELECT *, sum(c) OVER (PARTITION BY source, thread_key ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS turn_no FROM g)
    SELECT source, thread_key, turn_no::BIGINT AS turn_no, min(sender) AS sender, count(*)::BIGINT AS n, sum(length(coalesce(content, '')))::BIGINT AS chars FROM t GROUP BY source, thread_key, turn_no""")
def folded_turns(spark, d):
    return consolidate.folded_turns(_messages(spark, d))


@query(f"""WITH {ITEMS} SELECT id, json_extract_string(raw_metadata, '$.repo') AS repo FROM d WHERE json_extract_string(raw_metadata, '$.repo') IN ('acme/harbour', 'acme/lantern')
    AND timestamp BETWEEN TIMESTAMPTZ '2026-03-10 00:00:00+00' AND TIMESTAMPTZ '2026-04-10 00:00:00+00'""")
def repo_time_filter(spark, d):
    repo = F.get_json_object("raw_metadata", "$.repo")
    rows = _items(spark, d).where(ent.any_of(repo, ["acme/harbour", "acme/lantern"]))
    return rows.where(F.col("timestamp").between(F.lit("2026-03-10").cast("timestamp"), F.lit("2026-04-10").cast("timestamp"))).select("id", repo.alias("repo"))


# --- people and entities ---------------------------------------------------------------------------------------------

_KEY = "CASE WHEN regexp_full_match(trim(lower({0}), ' '), '\\+?[0-9 ()-]{{6,}}') THEN regexp_replace(trim(lower({0}), ' '), '[^0-9+]', '', 'g') ELSE trim(lower({0}), ' ') END"
_LINKS = f"""{ITEMS}, p AS (SELECT * FROM entities WHERE entity_type = 'person' AND coalesce(pending_review, 0) <> 2),
named AS (SELECT {_KEY.format('canonical_name')} AS key, min(id) AS entity_id FROM p WHERE canonical_name IS NOT NULL GROUP BY 1),
single AS (SELECT {_KEY.format('a')} AS key, min(id) AS entity_id FROM p, unnest(p.aliases) AS t(a) GROUP BY 1 HAVING count(DISTINCT id) = 1),
ids AS (SELECT * FROM named WHERE key <> '' UNION ALL SELECT * FROM single WHERE key <> '' AND key NOT IN (SELECT key FROM named)),
said AS (SELECT DISTINCT id AS item_id, {_KEY.format('x')} AS key FROM (SELECT id, unnest(list_concat([sender], coalesce(recipients, []))) AS x FROM d) WHERE x IS NOT NULL),
links AS (SELECT DISTINCT item_id, entity_id FROM said JOIN ids USING (key) WHERE key NOT IN ('', 'me'))"""


@query(f"WITH {_LINKS} SELECT * FROM links")
def participant_links(spark, d):
    return people.participant_links(_items(spark, d), table(spark, d, "entities"))


@query(f"WITH {_LINKS} SELECT e.id, e.canonical_name, count(links.item_id)::BIGINT AS n FROM entities e LEFT JOIN links ON links.entity_id = e.id GROUP BY ALL")
def link_counts(spark, d):
    links = people.participant_links(_items(spark, d), table(spark, d, "entities")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return table(spark, d, "entities").join(links.withColumnRenamed("entity_id", "id"), "id", "left").select("id", "canonical_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_LINKS} SELECT entity_id, count(DISTINCT item_id)::BIGINT AS n FROM links GROUP BY entity_id HAVING count(DISTINCT item_id) >= 3")
def entity_frequency(spark, d):
    links = people.participant_links(_items(spark, d), table(spark, d, "entities"))
    return links.groupBy("entity_id").agg(F.count_distinct("item_id").alias("n")).where("n >= 3")


PARTIES = ["Kerem Yttereskvombek", "KEREM YTTERESKVOMBEK", "Kerem  Yttereskvombek"]


@query(f"WITH {ITEMS} SELECT id FROM d WHERE sender IN ('me', 'Kerem Yttereskvombek') OR list_has_any(coalesce(recipients, []), ['me', 'Kerem Yttereskvombek'])")
def participant_allowlist(spark, d):
    return people.items_of_participants(_items(spark, d), ["me", "Kerem Yttereskvombek"])


@query(f"""WITH {ITEMS}, r AS (SELECT id, coalesce(thread_id, id) AS thread, epoch_us(timestamp) AS us, recipients, {_KEY.format('sender')} AS key FROM d WHERE {MESSAGES}),
    x AS (SELECT *, CASE WHEN key = 'me' THEN 'o' WHEN key IN ('kerem yttereskvombek', 'kerem  yttereskvombek') THEN 'p' END AS role FROM r),
    y AS (SELECT *, CASE WHEN len(recipients) = 1 AND CASE WHEN role = 'o' THEN {_KEY.format('recipients[1]')} IN ('kerem yttereskvombek', 'kerem  yttereskvombek') ELSE {_KEY.format('recipients[1]')} = 'me' END THEN true ELSE false END AS direct,
      count(*) FILTER (role = 'p') OVER w AS np, count(*) FILTER (role = 'o') OVER w AS no FROM x WHERE role IS NOT NULL
      WINDOW w AS (PARTITION BY thread ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND 7200000000 FOLLOWING))
    SELECT id FROM y WHERE direct OR CASE WHEN role = 'o' THEN np ELSE no END > 0""")
def conversation_range(spark, d):
    return people.exchanges(_messages(spark, d), PARTIES, ["me"])


_NPMI = """links AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS entity FROM lineitem), t AS (SELECT count(DISTINCT item)::DOUBLE AS total FROM links),
c AS (SELECT entity, count(*) AS c FROM links GROUP BY entity),
p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM links a JOIN links b ON a.item = b.item AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT a, b, n, ln(n / total / (ca.c / total * cb.c / total)) AS pmi, n / total AS pab FROM p JOIN c ca ON ca.entity = a JOIN c cb ON cb.entity = b, t),
edges AS (SELECT a AS entity_a, b AS entity_b, round(least(1.0, pmi / -ln(pab)), 6) AS score, n::BIGINT AS cooccur FROM s WHERE pmi > 0 AND pmi / -ln(pab) >= 0.15),
directed AS (SELECT * FROM edges UNION ALL SELECT entity_b, entity_a, score, cooccur FROM edges)"""


def _edges(spark, d):
    return ent.npmi(table(spark, d, "lineitem"), "l_orderkey", "l_partkey").withColumn("score", F.round("score", 6))


@query(f"WITH {_NPMI} SELECT * FROM directed")
def npmi_pairs(spark, d):
    return _edges(spark, d)


_RESOLVED = """seeds AS (SELECT p_partkey FROM part WHERE p_size >= 25), manual AS (SELECT a.p_partkey AS entity_a, b.p_partkey AS entity_b, 0.9 AS weight, a.p_partkey % 7 = 0 AS suppress FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
l AS (SELECT entity_a, entity_b, score FROM directed WHERE entity_a IN (SELECT p_partkey FROM seeds)), o AS (SELECT * FROM manual WHERE entity_a IN (SELECT p_partkey FROM seeds)),
w AS (SELECT coalesce(l.entity_b, o.entity_b) AS entity, max(coalesce(o.weight, l.score)) AS weight FROM l FULL JOIN o ON l.entity_a = o.entity_a AND l.entity_b = o.entity_b
  WHERE NOT coalesce(suppress, false) AND coalesce(l.entity_b, o.entity_b) NOT IN (SELECT p_partkey FROM seeds) GROUP BY 1)"""


def _resolved(spark, d):
    part = table(spark, d, "part")
    seeds = part.where("p_size >= 25").select(F.col("p_partkey").alias("entity"))
    manual = part.select(F.col("p_partkey").alias("entity_a"), (F.col("p_partkey") + 1).alias("entity_b"), F.lit(0.9).alias("weight"), (F.col("p_partkey") % 7 == 0).alias("suppress")).join(part.select(F.col("p_partkey").alias("entity_b")), "entity_b", "left_semi")
    return ent.resolve_associations_of(_edges(spark, d), manual, seeds)


@query(f"WITH {_NPMI}, {_RESOLVED} SELECT entity, round(weight, 6) AS weight FROM w")
def assoc_resolve(spark, d):
    return _resolved(spark, d).select("entity", F.round("weight", 6).alias("weight"))


@query(f"WITH {_NPMI}, {_RESOLVED} SELECT l.item AS item_id, round(max(weight), 6) AS weight FROM links l JOIN w ON w.entity = l.entity GROUP BY 1")
def assoc_weights(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("entity_id")).distinct()
    return ent.weights_of_items(links, _resolved(spark, d)).select("item_id", F.round("weight", 6).alias("weight"))


_NORM = "regexp_replace(regexp_replace(canonical_name, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"


@query(f"""WITH {_LINKS}, u AS (SELECT entity_id, count(*) AS uses FROM links GROUP BY 1), t AS (SELECT id, entity_type, canonical_name, coalesce(uses, 0) AS uses, {_NORM} AS plain FROM entities LEFT JOIN u ON u.entity_id = id WHERE coalesce(pending_review, 0) <> 2),
    r AS (SELECT *, lower(plain) AS norm, CASE WHEN entity_type IN ('person', 'place') THEN array_to_string([upper(x[1:1]) || lower(x[2:]) FOR x IN string_split(plain, ' ')], ' ') ELSE plain END AS tidy FROM t)
    SELECT norm, entity_type, count(*)::BIGINT AS n, arg_min(id, (tidy <> canonical_name, -uses, length(canonical_name), id)) AS survivor FROM r WHERE norm <> '' GROUP BY ALL HAVING count(*) > 1""")
def normalize_groups(spark, d):
    uses = people.participant_links(_items(spark, d), table(spark, d, "entities")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return ent.normalised_groups(table(spark, d, "entities"), uses).select("norm", "entity_type", "n", "survivor")


@query("""WITH r AS (SELECT id, entity_type, array_to_string([w FOR w IN regexp_split_to_array(lower(canonical_name), '[^\\p{L}\\p{N}_]+')
      IF w <> '' AND w NOT IN ('as', 'asa', 'ab', 'inc', 'llc', 'ltd', 'gmbh', 'group', 'gruppen', 'consulting', 'consult', 'holding', 'norge', 'company', 'co', 'corp')], ' ') AS key FROM entities WHERE coalesce(pending_review, 0) <> 2)
    SELECT key, entity_type, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r WHERE key <> '' GROUP BY key, entity_type HAVING count(*) > 1""")
def merge_suggestions(spark, d):
    return ent.merge_suggestions(table(spark, d, "entities")).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"""WITH {_LINKS}, u AS (SELECT entity_id, count(*) AS n FROM links GROUP BY 1), s AS (SELECT id, canonical_name, trim(canonical_name) AS s FROM entities WHERE pending_review = 1),
    q AS (SELECT *, length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) AS letters, length(replace(s, ' ', '')) AS solid FROM s),
    w AS (SELECT id, canonical_name, array_to_string([x FOR x IN [CASE WHEN letters > 0 AND s = lower(s) THEN 'all-lowercase' END, CASE WHEN length(s) <= 2 AND s <> upper(s) THEN 'very-short' END,
      CASE WHEN regexp_full_match(s, '[0-9]+') THEN 'numeric' END, CASE WHEN solid > 0 AND letters / solid < 0.5 THEN 'symbol-heavy' END] IF x IS NOT NULL], ',') AS reasons FROM q)
    SELECT w.id, canonical_name, coalesce(u.n, 0)::BIGINT AS n, reasons FROM w LEFT JOIN u ON u.entity_id = w.id WHERE reasons <> ''""")
def prune_candidates(spark, d):
    uses = people.participant_links(_items(spark, d), table(spark, d, "entities")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return ent.prune_candidates(table(spark, d, "entities"), uses).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT alias, canonical_name AS canonical, 'entities' AS origins FROM (SELECT DISTINCT unnest(aliases) AS alias, canonical_name FROM entities) WHERE trim(alias) <> ''""")
def alias_inventory(spark, d):
    return ent.alias_inventory({"entities": table(spark, d, "entities").select(F.col("canonical_name").alias("canonical"), "aliases")})


@query("""SELECT o_custkey AS customer FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 2""")
def metadata_intersect(spark, d):
    return ent.with_all(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"]).withColumnRenamed("o_custkey", "customer")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def orphan_vacuum(spark, d):
    return ent.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "c_custkey")


# --- query log -------------------------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT result_id, count(*) FILTER (kind IN ('hit', 'relevant'))::BIGINT AS validations, count(*) FILTER (kind = 'correction')::BIGINT AS contradictions FROM feedback WHERE result_id IS NOT NULL GROUP BY 1")
def feedback_counts(spark, d):
    return signals.feedback_counts(_log(spark, d)[2])


@query(f"""WITH {LOG}, up AS (SELECT result_id, count(*) AS n FROM (SELECT result_id FROM results WHERE cited UNION ALL SELECT result_id FROM feedback WHERE kind = 'correction') WHERE result_id IS NOT NULL GROUP BY 1),
    down AS (SELECT result_id, count(DISTINCT query_id) AS n FROM feedback WHERE kind = 'bad_result' GROUP BY 1)
    SELECT result_id, greatest(0, up.n - coalesce(down.n, 0))::BIGINT AS n, round(1 + least(0.03 * greatest(0, up.n - coalesce(down.n, 0)), 0.15), 6)::DOUBLE AS factor FROM up LEFT JOIN down USING (result_id)""")
def boost_counts(spark, d):
    _, r, f = _log(spark, d)
    return signals.boost_counts(r, f).withColumn("factor", F.round(signals.boost_factor(F.col("n")), 6))


@query(f"WITH {LOG} SELECT lower(text) AS query, count(*)::BIGINT AS n, epoch_us(max(ts))::BIGINT AS last_us, count(*) FILTER (results_returned = 0)::BIGINT AS zero_results FROM queries WHERE confidence IN ('low', 'unknown') OR results_returned = 0 GROUP BY 1")
def coverage_gaps(spark, d):
    return signals.coverage_gaps(_log(spark, d)[0]).select("query", "n", _us("last_ts").alias("last_us"), "zero_results")


_USAGE = f"""{LOG}, latest AS (SELECT query_id, arg_max(kind, id) AS kind FROM feedback WHERE kind <> 'deferred' GROUP BY 1),
usage AS (SELECT result_id, count(*)::BIGINT AS surfaced, count(*) FILTER (cited)::BIGINT AS cited, epoch_us(max(q.ts))::BIGINT AS last_us FROM results r JOIN queries q ON q.id = r.query_id
  WHERE coalesce(provenance, '') <> 'test' AND r.query_id NOT IN (SELECT query_id FROM latest WHERE kind = 'noise') GROUP BY 1)"""


@query(f"WITH {_USAGE} SELECT * FROM usage")
def item_usage(spark, d):
    return signals.item_usage(*_log(spark, d)).select("result_id", "surfaced", "cited", _us("last_ts").alias("last_us"))


@query(f"WITH {_USAGE} SELECT DISTINCT 'doc-' || k AS id FROM ev WHERE 'doc-' || k NOT IN (SELECT result_id FROM usage WHERE last_us >= epoch_us(TIMESTAMP '2024-01-29'))")
def stale_anti(spark, d):
    known = querylog.feedback(table(spark, d, "events")).select("result_id").unionByName(querylog.results(table(spark, d, "events")).select("result_id")).distinct().select(F.col("result_id").alias("id"), F.col("result_id").alias("source_id"))
    return signals.stale(known, signals.item_usage(*_log(spark, d)), F.lit("2024-01-29").cast("timestamp")).select("id")


@query(f"WITH {LOG} SELECT query_id, arg_max(kind, id) AS kind FROM feedback WHERE kind <> 'deferred' GROUP BY 1")
def latest_verdict(spark, d):
    return signals.latest_verdicts(_log(spark, d)[2])


@query(f"""WITH {LOG}, c AS (SELECT query_id, count(*) FILTER (cited) AS cited FROM results GROUP BY 1), x AS (SELECT q.*, j.query_id IS NULL AS unjudged, coalesce(c.cited, 0) AS cited, ({NOW_SQL} - epoch_us(ts)) / 86400000000 AS days
      FROM queries q LEFT JOIN judged j ON j.query_id = q.id LEFT JOIN c ON c.query_id = q.id)
    SELECT id AS query_id, round(CASE WHEN unjudged THEN 1.0 ELSE 0.0 END + CASE WHEN confidence = 'low' THEN 0.5 ELSE 0.0 END + CASE WHEN results_returned >= 5 THEN 0.3 WHEN results_returned = 0 THEN 0.4 ELSE 0.0 END
      + CASE WHEN cited = 0 AND results_returned > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN days < 1 THEN 0.4 WHEN days < 7 THEN 0.2 ELSE 0.0 END, 6)::DOUBLE AS priority FROM x""")
def review_priority(spark, d):
    return signals.review_queue(*_log(spark, d), NOW).select("query_id", "priority")


@query(f"""WITH {LOG}, f AS (SELECT (SELECT count(*) FROM judged)::BIGINT AS judged, count(*) FILTER (kind = 'hit')::BIGINT AS hit, count(*) FILTER (kind = 'miss')::BIGINT AS miss, count(*) FILTER (kind = 'correction')::BIGINT AS correction,
      count(*) FILTER (kind = 'noise')::BIGINT AS noise, count(*) FILTER (kind = 'relevant')::BIGINT AS relevant, count(*) FILTER (kind = 'thin')::BIGINT AS thin FROM feedback), q AS (SELECT count(*)::BIGINT AS total FROM queries)
    SELECT total, f.*, round(judged / total, 6) AS coverage, round(hit / (hit + miss + correction), 6) AS hit_rate, round(relevant / (relevant + thin), 6) AS usefulness FROM q, f""")
def dashboard(spark, d):
    q, _, f = _log(spark, d)
    return signals.dashboard(q, f).withColumns({c: F.round(c, 6) for c in ("coverage", "hit_rate", "usefulness")})


@query(f"WITH {LOG} SELECT r.source, count(*)::BIGINT AS n FROM feedback f JOIN results r ON r.query_id = f.query_id AND r.rank = 1 WHERE f.kind = 'miss' GROUP BY 1")
def miss_sources(spark, d):
    _, r, f = _log(spark, d)
    return signals.miss_sources(r, f)


@query(f"""WITH {LOG}, seeds AS (SELECT DISTINCT query_id FROM feedback WHERE kind = 'noise'), t AS (SELECT DISTINCT text FROM queries WHERE id IN (SELECT query_id FROM seeds))
    SELECT id AS query_id FROM queries WHERE text IN (SELECT text FROM t) AND id NOT IN (SELECT query_id FROM judged) UNION SELECT query_id FROM seeds""")
def noise_cascade(spark, d):
    q, _, f = _log(spark, d)
    return signals.noise_cascade(q, f, f.where("kind = 'noise'").select("query_id").distinct())


@query("""WITH r AS (SELECT event_type AS tag, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT tag, max(n)::BIGINT AS n, round(sum(v), 4) AS total, min(v) FILTER (i = floor(n * 0.5)) AS p50, min(v) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY tag""")
def usage_rollup(spark, d):
    return signals.usage_rollup(table(spark, d, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


# --- evaluation ------------------------------------------------------------------------------------------------------

_SCORED = "x AS (SELECT event_id, user_id, least(value, 50) / 50 AS score, event_type IN ('purchase', 'click') AS label, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) = 0 AS other FROM events)"


def _scored(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", (F.least("value", F.lit(50.0)) / 50).alias("score"), F.col("event_type").isin("purchase", "click").alias("label"), (F.get_json_object("props", "$.k").cast("long") % 3 == 0).alias("other"))


@query("SELECT o_orderkey, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT o_orderkey, ('0x' || substr(sha1(o_custkey::VARCHAR), 1, 15))::BIGINT % 100 AS b FROM orders)")
def hash_splits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", evaluate.split_name(F.col("o_custkey").cast("string")).alias("split"))


@query(f"""WITH {LOG}, a AS (SELECT query_id, min(rank) FILTER (cited) AS rank FROM results GROUP BY 1)
    SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_at_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_at_10,
      round(avg(coalesce(1.0 / rank, 0.0)), 6)::DOUBLE AS mrr, round(0.7 * avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) + 0.3 * avg(coalesce(1.0 / rank, 0.0)), 6)::DOUBLE AS quality FROM a""")
def rank_metrics(spark, d):
    best = _log(spark, d)[1].groupBy("query_id").agg(F.min(F.when(F.col("cited"), F.col("rank"))).alias("rank"))
    m = evaluate.rank_metrics(best)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "recall_at_10", "mrr", "quality")])


@query(f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM x),
    c AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q, sum(r) FILTER (label) AS s FROM r)
    SELECT p::BIGINT AS positives, q::BIGINT AS negatives, round((s - p * (p + 1) / 2.0) / (p::DOUBLE * q), 6)::DOUBLE AS auc FROM c""")
def auc(spark, d):
    return evaluate.auc(_scored(spark, d)).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label = other) AS same, count(*) FILTER (label) AS ya, count(*) FILTER (other) AS yb FROM x),
    k AS (SELECT n, same / n AS po, (ya * yb + (n - ya) * (n - yb)) / (n * n) AS pe FROM c) SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def kappa(spark, d):
    return evaluate.kappa(_scored(spark, d).select(F.col("label").alias("a"), F.col("other").alias("b"))).withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


@query(f"WITH {_SCORED} SELECT least(floor(score * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, round(avg(label::INT), 6) AS rate FROM x WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def ece_bins(spark, d):
    return evaluate.reliability(_scored(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_score", "rate")})


@query(f"""WITH {_SCORED}, t AS (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS threshold) SELECT threshold, count(*)::BIGINT AS kept, round(count(*) FILTER (label) / count(*), 6) AS precision,
    round(count(*) FILTER (label) / (SELECT count(*) FROM x WHERE label), 6) AS recall FROM x JOIN t ON score >= threshold GROUP BY 1""")
def pr_thresholds(spark, d):
    return evaluate.precision_recall(_scored(spark, d), [0.1, 0.2, 0.4]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS ra, row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id) AS rb FROM events),
    s AS (SELECT event_type, count(*)::DOUBLE AS n, sum((ra - rb)::DOUBLE * (ra - rb)) AS d2 FROM r GROUP BY 1) SELECT event_type, n::BIGINT AS n, round(1 - 6 * d2 / (n * (n * n - 1)), 6) AS rho FROM s""")
def spearman(spark, d):
    return evaluate.spearman(table(spark, d, "events"), "event_type", "value", "user_id", "event_id").withColumn("rho", F.round("rho", 6))


@query("SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {k / 10}), 4) AS d{k}" for k in range(1, 10)) + " FROM orders")
def percentile_deciles(spark, d):
    return evaluate.deciles(table(spark, d, "orders"), "o_totalprice").withColumns({f"d{k}": F.round(f"d{k}", 4) for k in range(1, 10)})


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s1:' || o_orderkey), o_orderkey) AS k FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE k <= 20""")
def stratified_sample(spark, d):
    return evaluate.stratified_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 20, "s1").select("o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('s2:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark, d):
    return evaluate.seeded_sample(table(spark, d, "orders"), "o_orderkey", 100, "s2").select("o_orderkey")


@query()
def bootstrap_gain(spark, d):
    return evaluate.bootstrap_gain(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(150000.0).alias("a"), F.col("o_totalprice").alias("b")), replicates=200)
