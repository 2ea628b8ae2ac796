"""Queries over texts, facts, candidates and ingest, with the SQL they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import abbreviations, text as T
from emberlake.operators import entities as ent, people, promote
from emberlake.queries.relational import _LINKS, COLUMNS, ITEMS
from emberlake.session import shared_dir
from emberlake.sources import store
from emberlake.streaming import ingest
from emberlake.tables import distinct_items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_NB = "'og', 'ikke', 'jeg', 'det', 'som', 'har', 'skal', 'kan', 'deg', 'meg', 'dere', 'hvis', 'med', 'av', 'fra', 'til', 'takk', 'hei', 'etter', 'noen', 'alle', 'blir', 'bare', 'denne', 'dette', 'hva', 'hvordan'"


@query(f"""SELECT doc_id, CASE WHEN length(trim(text, ' ')) >= 10 THEN CASE WHEN regexp_matches(text, '[æøåÆØÅ]') OR len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zæøå]+')), [{_NB}])) >= 2 THEN 'no' ELSE 'en' END END AS lang FROM documents""")
def lang_detect(spark, d):
    return _documents(spark, d).select("doc_id", T.language(F.col("text")).alias("lang"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?:https?|ftp)://[^ \\t\\n\\r\\f\\v]+|www\\.[^ \\t\\n\\r\\f\\v]+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g'), '</?[a-zA-Z][^>\\n]*>', ' ', 'g'),
    '[\\x{00a0}\\x{2000}-\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x{2190}-\\x{2bff}\\x{1f000}-\\x{1faff}]', ' ', 'g')) AS digest FROM documents""")
def strip_markup(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.strip_markup(F.col("text"))).alias("digest"))


@query()
def html_clean(spark, d):
    return _documents(spark, d).select("doc_id", T.html_to_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'eyJ[\\w-]{10,}(?:\\.[\\w-]{10,}){2}', '<redacted-jwt>', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._\\-+/=]+', 'Bearer <redacted>', 'g'),
    '(?i)"(access_token|refresh_token|id_token|client_secret|api_key|secret|body|content|text|html_body|plain_body)"\\s*:\\s*"[^"]*"', '"\\1":"<redacted>"', 'g')) AS digest FROM documents""")
def redact(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query("""SELECT source_id, substr(regexp_replace(trim(regexp_replace(lower(content), '[^a-z0-9\\s]', '', 'g'), ' '), '\\s+', '_', 'g'), 1, 60) AS slug FROM chat_facts WHERE content IS NOT NULL""")
def fact_slugs(spark, d):
    return table(spark, d, "chat_facts").where("content IS NOT NULL").select("source_id", T.slug(F.col("content")).alias("slug"))


@query("""WITH c AS (SELECT source_id, regexp_extract(content, '^\\s*([^.;:!?\\n]+)', 1) AS c FROM chat_facts WHERE content IS NOT NULL)
    SELECT source_id, trim(CASE WHEN length(c) <= 80 THEN c ELSE regexp_replace(substr(c, 1, 80), '\\s+\\S*$', '') END, ' ') AS title FROM c""")
def fact_titles(spark, d):
    return table(spark, d, "chat_facts").where("content IS NOT NULL").select("source_id", T.fact_title(F.col("content")).alias("title"))


@query("""WITH t AS (SELECT DISTINCT source_id, lower(trim(x)) AS tag FROM (SELECT source_id, unnest(tags) AS x FROM chat_facts) WHERE trim(x) <> '') SELECT tag, count(*)::BIGINT AS n FROM t GROUP BY tag""")
def fact_tags(spark, d):
    tags = table(spark, d, "chat_facts").select("source_id", F.explode("tags").alias("x")).where("trim(x) <> ''").select("source_id", F.lower(F.trim("x")).alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query()
def abbrev_mine(spark, d):
    rows = _documents(spark, d).select(F.col("doc_id").alias("id"), "source", F.col("created_at").cast("timestamp").alias("timestamp"), "text")
    return abbreviations.mine(rows)


@query("""WITH r AS (SELECT DISTINCT unnest(recipients) AS r FROM items) SELECT r AS recipient, CASE WHEN regexp_full_match(p, '\\+[0-9]{8,15}') THEN p END AS phone
    FROM (SELECT r, CASE WHEN starts_with(d, '+') THEN d WHEN starts_with(d, '00') THEN '+' || substr(d, 3) WHEN length(d) = 8 THEN '+47' || d END AS p FROM (SELECT r, regexp_replace(r, '[^0-9+]', '', 'g') AS d FROM r WHERE r IS NOT NULL))""")
def phone_numbers(spark, d):
    rows = table(spark, d, "items").select(F.explode("recipients").alias("recipient")).where("recipient IS NOT NULL").distinct()
    return rows.select("recipient", T.phone(F.col("recipient")).alias("phone"))


_TAGS = """e AS (SELECT id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS n FROM entities WHERE coalesce(pending_review, 0) <> 2),
nm AS (SELECT DISTINCT id AS entity_id, array_to_string(t, ' ') AS name, t, len(t) AS k FROM (SELECT id, regexp_extract_all(lower(n), '[\\p{L}\\p{N}]+') AS t FROM e WHERE n IS NOT NULL) WHERE len(t) >= 1),
dn AS (SELECT DISTINCT name, t, k, t[1] AS first FROM nm),
tx AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents), tok AS (SELECT id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS pos FROM tx),
m AS (SELECT tok.id, pos, k, name FROM tok JOIN dn ON w = first JOIN tx ON tx.id = tok.id WHERE tx.t[pos:pos + k - 1] = dn.t),
w AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND o.k > m.k AND o.pos <= m.pos AND o.pos + o.k >= m.pos + m.k))"""


@query(f"WITH {_TAGS} SELECT w.id, entity_id, count(*)::BIGINT AS n FROM w JOIN nm USING (name) GROUP BY ALL")
def entity_tags(spark, d):
    return ent.dictionary_tags(_documents(spark, d).select(F.col("doc_id").alias("id"), "text"), table(spark, d, "entities"))


# --- promotion -------------------------------------------------------------------------------------------------------


def _candidates(spark, d) -> DataFrame:
    """One candidate per linked entity: its three newest items."""
    items = distinct_items(table(spark, d, "items"), *COLUMNS)
    top = promote.newest_per_entity(people.participant_links(items, table(spark, d, "entities")), items, 3)
    return top.groupBy("entity_id").agg(F.array_sort(F.collect_list("item_id")).alias("source_item_ids")).withColumn("candidate_id", F.substring(F.sha2(F.concat_ws(",", F.col("entity_id").cast("string"), F.array_join("source_item_ids", ",")), 256), 1, 16))


_TOP = f"""{_LINKS}, top AS (SELECT * FROM (SELECT entity_id, item_id, timestamp, timestamp_inferred, source, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp DESC, item_id) AS place FROM links JOIN d ON d.id = links.item_id)),
cand AS (SELECT entity_id, list(item_id ORDER BY item_id) AS ids, substr(sha256(entity_id || ',' || array_to_string(list(item_id ORDER BY item_id), ',')), 1, 16) AS candidate_id FROM top WHERE place <= 3 GROUP BY 1)"""


@query(f"WITH {_TOP} SELECT entity_id, place::BIGINT AS place, item_id FROM top WHERE place <= 10")
def cluster_topk(spark, d):
    items = distinct_items(table(spark, d, "items"), *COLUMNS)
    return promote.newest_per_entity(people.participant_links(items, table(spark, d, "entities")), items).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_TOP} SELECT candidate_id, epoch_us(min(timestamp))::BIGINT AS event_us, bool_or(coalesce(timestamp_inferred, false)) AS inferred FROM cand, unnest(cand.ids) AS t(i) JOIN d ON d.id = t.i GROUP BY 1")
def event_time_reduce(spark, d):
    items = distinct_items(table(spark, d, "items"), *COLUMNS)
    return promote.event_times(_candidates(spark, d), items).select("candidate_id", F.unix_micros("event_ts").alias("event_us"), "inferred")


@query(f"""WITH {_TOP}, rj AS (SELECT * FROM cand WHERE entity_id % 3 = 0), hit AS (SELECT DISTINCT c.candidate_id FROM cand c JOIN rj ON c.entity_id = rj.entity_id AND list_has_any(c.ids, rj.ids))
    SELECT candidate_id FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM hit)""")
def candidate_rejection(spark, d):
    c = _candidates(spark, d)
    return promote.not_rejected(c, c.where("entity_id % 3 = 0")).select("candidate_id")


@query(f"""WITH {_TOP}, tr AS (SELECT candidate_id, any_value(cand.entity_id) AS entity_id, count(*) AS n, max(CASE WHEN source = 'tier2_ledger' THEN 1.0 WHEN source = 'email' THEN 0.92 WHEN source IN ('imessage', 'signal') THEN 0.82 WHEN timestamp_inferred THEN 0.7 ELSE 0.82 END) AS trust FROM cand, unnest(cand.ids) AS t(i) JOIN d ON d.id = t.i GROUP BY 1),
    te AS (SELECT tr.*, list_distinct([x FOR x IN regexp_extract_all(lower(canonical_name), '[\\p{{L}}\\p{{N}}]+') IF length(x) >= 3]) AS terms FROM tr JOIN entities e ON e.id = tr.entity_id)
    SELECT candidate_id, round(0.35 + 0.25 * CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, ['logistics', 'energi', 'kerem', 'amina', 'farid'])) / len(terms) ELSE 0.0 END + 0.2 * least(1.0, n / 6) + 0.2 * trust, 6)::DOUBLE AS score FROM te""")
def admission_score(spark, d):
    items = distinct_items(table(spark, d, "items"), *COLUMNS)
    kind = promote.provenance_class(F.col("source"), F.coalesce("timestamp_inferred", F.lit(False)), F.lit(False))
    rows = _candidates(spark, d).select("candidate_id", "entity_id", F.explode("source_item_ids").alias("id")).join(items.select("id", promote.provenance_weight(kind).alias("w")), "id")
    rows = rows.groupBy("candidate_id", "entity_id").agg(F.count("*").alias("n"), F.max("w").alias("trust")).join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    terms = F.array_distinct(F.filter(T.tokens(F.col("canonical_name")), lambda t: F.length(t) >= 3))
    known = F.array(*map(F.lit, ["logistics", "energi", "kerem", "amina", "farid"]))
    return rows.select("candidate_id", F.round(promote.admission(F.lit(None).cast("double"), terms, known, F.col("trust"), F.col("n")), 6).alias("score"))


# --- ingest ----------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT ON (id) * FROM items ORDER BY id, ingested_at DESC), o AS (SELECT id, min(ingested_at) AS ingested_at FROM items GROUP BY id)
    SELECT id, source, epoch_us(o.ingested_at)::BIGINT AS ingested_us, epoch_us(f.timestamp)::BIGINT AS us FROM f JOIN o USING (id)""")
def ingest_upsert(spark, d):
    items = table(spark, d, "items")
    cols = ["id", "source", "timestamp", "ingested_at"]
    first = items.groupBy("id").agg(F.min_by(F.struct(*cols[1:]), "ingested_at").alias("v")).select("id", "v.*")
    return store.upsert(first, items.select(*cols)).select("id", "source", F.unix_micros("ingested_at").alias("ingested_us"), F.unix_micros("timestamp").alias("us"))


@query("SELECT source, count(*)::BIGINT AS seen, count(DISTINCT id)::BIGINT AS new, (count(*) - count(DISTINCT id))::BIGINT AS skipped FROM items GROUP BY source")
def ingest_runs(spark, d):
    items = table(spark, d, "items").select("id", "source")
    return store.run_rows(items, items.limit(0))


@query("SELECT source, epoch_us(max(timestamp))::BIGINT AS last_us FROM items GROUP BY source")
def watermark_upsert(spark, d):
    items = table(spark, d, "items").select("source", "timestamp")
    early = items.where("timestamp < '2026-04-01'")
    marks = store.advance(spark.createDataFrame([], "source string, last_us long"), early)
    return store.advance(marks, items)


@query("SELECT DISTINCT ON (id) id, source FROM items ORDER BY id")
def streaming_ingest_dedup(spark, d):
    """The items file replayed as a stream into a store in the shared folder; second deliveries are not stored again."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "items").select("id", "source", "timestamp").write.parquet(f"{home}/in")
    ingest.append_new(ingest.read_stream(spark, f"{home}/in", 4), f"{home}/store", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/store/items").select("id", "source")


@query("SELECT source || ':' || source_id AS name, sha256(source || ':' || source_id) AS id FROM (SELECT DISTINCT source, source_id FROM items)")
def item_ids(spark, d):
    from emberlake.sources.readers import item_id

    rows = table(spark, d, "items").select("source", "source_id").distinct()
    return rows.select(F.concat_ws(":", "source", "source_id").alias("name"), item_id(F.col("source"), F.col("source_id")).alias("id"))


@query(f"""WITH {ITEMS} SELECT id FROM d WHERE junk_reason IS NULL OR consolidated_into IS NOT NULL""")
def junk_prune(spark, d):
    return store.prune(distinct_items(table(spark, d, "items"), "junk_reason", "consolidated_into")).select("id")
