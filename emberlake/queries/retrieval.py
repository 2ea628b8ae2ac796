"""Queries of the retrieval engine over the whole item corpus, with the SQL they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators import consolidate, fusion, lexical, promote, quality, signals, vector
from emberlake.plans.retrieve import ITEM_WEIGHTS, SESSION_WEIGHTS, HybridConfig, hybrid, hydrated
from emberlake.queries.relational import COLUMNS, ITEMS, LOG, MESSAGES, _log
from emberlake.session import shared_dir, stage, unstage
from emberlake.sources import store
from emberlake.tables import distinct_items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

TEXTS = {"q1": "spare key Winter Gate", "q2": "nightly run retry", "q3": "presentasjonen onsdag", "q4": "who broke the label-printer", "q5": "budget blocked"}
WORDS = ["spare", "granite", "tilgangslisten", "confidential", "trees", "prompt", "addressee", "invoice", "kaia"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return distinct_items(table(spark, d, "items"), *COLUMNS)


def _phrases(prefixes: bool = False, synonyms: dict | None = None) -> list[lexical.Phrase]:
    return [p for q, t in TEXTS.items() for p in lexical.phrases_of(q, t, synonyms, prefixes)]


def _values(phrases: list[lexical.Phrase]) -> str:
    rows = [f"('{p.query_id}', {p.no}, {i}, '{w}', {str(p.prefix and i == len(p.words) - 1).lower()}, {len(p.words)})" for p in phrases for i, w in enumerate(p.words)]
    return f"qt(query_id, phrase, idx, word, prefix, words) AS (VALUES {', '.join(rows)})"


def _bm25_sql(phrases: list[lexical.Phrase] | str, weights: dict[str, float], docs: str = "d") -> str:
    """Common tables that end in scored(query_id, id, score); ``phrases``: a list, or the common table qt."""
    asked = phrases if isinstance(phrases, str) else _values(phrases)
    split = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {w}::DOUBLE AS weight, regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {docs}" for c, w in weights.items())
    return f"""{asked}, tk AS ({split}), post AS (SELECT id, col, weight, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tk),
len AS (SELECT id, sum(len(t)) AS len FROM tk GROUP BY id), stat AS (SELECT count(*)::DOUBLE AS total, avg(len) AS mean FROM len),
met AS (SELECT q.*, p.id, p.col, p.weight, p.pos FROM post p JOIN qt q ON p.term = q.word WHERE NOT q.prefix UNION ALL
  SELECT q.*, p.id, p.col, p.weight, p.pos FROM post p JOIN qt q ON substr(p.term, 1, length(q.word)) = q.word WHERE q.prefix),
runs AS (SELECT query_id, phrase, id, col, weight FROM met GROUP BY query_id, phrase, words, id, col, weight, pos - idx HAVING count(DISTINCT idx) = words),
f AS (SELECT query_id, phrase, id, sum(weight) AS f FROM runs GROUP BY ALL), n AS (SELECT query_id, phrase, count(*) AS n FROM f GROUP BY ALL),
scored AS (SELECT query_id, id, round(sum(CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
  FROM f JOIN n USING (query_id, phrase) JOIN len USING (id), stat GROUP BY query_id, id)"""


def _top_sql(k: int, source: str = "scored") -> str:
    return f"SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {k}"


def _top(scored: DataFrame, k: int) -> DataFrame:
    return lexical.top_k(scored, k).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_OUT = "SELECT query_id, id, round(score, 6) AS score, rank::BIGINT AS rank FROM"


@query(f"WITH {ITEMS}, {_bm25_sql(_phrases(), {'content': 1.0})}, t AS ({_top_sql(20)}) {_OUT} t")
def bm25_topk(spark, d):
    return _top(lexical.bm25(_items(spark, d), {"content": 1.0}, _phrases()), 20)


@query(f"WITH {ITEMS}, {_bm25_sql(_phrases(), ITEM_WEIGHTS)}, t AS ({_top_sql(20)}) {_OUT} t")
def bm25_weighted_columns(spark, d):
    return _top(lexical.bm25(_items(spark, d), ITEM_WEIGHTS, _phrases()), 20)


@query(f"WITH {ITEMS}, {_bm25_sql(_phrases(True), ITEM_WEIGHTS)}, t AS ({_top_sql(20)}) {_OUT} t")
def bm25_prefix(spark, d):
    return _top(lexical.bm25(_items(spark, d), ITEM_WEIGHTS, _phrases(True)), 20)


@query(f"WITH {ITEMS}, {_bm25_sql(_phrases(True), ITEM_WEIGHTS)}, t AS ({_top_sql(20)}) {_OUT} t")
def bm25_stored(spark, d):
    """The searches of ``bm25_prefix`` on an index that was written before."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lexical.write_index(_items(spark, d), list(ITEM_WEIGHTS), path)
    return _top(lexical.stored_bm25(spark, path, ITEM_WEIGHTS, _phrases(True)), 20)


SYNONYMS = {"budget": ["budget", "budsjettet"], "retry": ["retry", "restart", "start på nytt"], "onsdag": ["onsdag", "wednesday"]}


@query(f"WITH {ITEMS}, {_bm25_sql(_phrases(True, SYNONYMS), ITEM_WEIGHTS)}, t AS ({_top_sql(20)}) {_OUT} t")
def synonym_expand(spark, d):
    return _top(lexical.bm25(_items(spark, d), ITEM_WEIGHTS, _phrases(True, SYNONYMS)), 20)


@query("""WITH o AS (SELECT id, list_distinct([lower(trim(x)) FOR x IN list_concat([canonical_name], coalesce(aliases, [])) IF trim(x) <> '']) AS names FROM entities WHERE coalesce(pending_review, 0) <> 2),
    w AS (SELECT names, unnest(names) AS word FROM o WHERE len(names) > 1), g AS (SELECT word, unnest(names) AS s FROM w WHERE word NOT LIKE '% %') SELECT word, string_agg(DISTINCT s, '|' ORDER BY s) AS spellings FROM g GROUP BY word""")
def synonym_groups(spark, d):
    return lexical.synonym_groups(table(spark, d, "entities")).withColumn("spellings", F.array_join("spellings", "|"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT id, lower(trim(x)) AS name FROM (SELECT id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS x FROM entities WHERE coalesce(pending_review, 0) <> 2) WHERE trim(x) <> ''),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM n a JOIN n b USING (name)), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a), g AS (SELECT label, list_sort(list_distinct(list(name))) AS s FROM n JOIN l USING (id) GROUP BY label)
    SELECT word, array_to_string(s, '|') AS spellings FROM (SELECT s, unnest(s) AS word FROM g WHERE len(s) > 1) WHERE word NOT LIKE '% %'""")
def synonym_closure(spark, d):
    return lexical.merged_synonyms(table(spark, d, "entities")).withColumn("spellings", F.array_join("spellings", "|"))


_WORDS = ", ".join(f"'{w}'" for w in WORDS)


@query(f"""WITH {ITEMS}, p AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', content, subject, sender)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM d)
    SELECT term AS word, count(DISTINCT id)::BIGINT AS df FROM p WHERE term IN ({_WORDS}) GROUP BY term HAVING count(DISTINCT id) <= 250""")
def rare_terms(spark, d):
    return lexical.rare_terms(_items(spark, d), list(ITEM_WEIGHTS), WORDS, 250)


_RARE = [lexical.Phrase(f"{w}", 0, (w,), False) for w in ("compass", "prompt", "restart")]


@query(f"""WITH {ITEMS}, {_bm25_sql(_RARE, ITEM_WEIGHTS)}, l AS ({_top_sql(30)}), i AS (SELECT id, min(rank) AS r, arg_min(query_id, (rank, query_id)) AS lane FROM l GROUP BY id)
    SELECT 'q' AS query_id, id, row_number() OVER (ORDER BY r, lane, id)::BIGINT AS rank FROM i""")
def rare_lane(spark, d):
    lanes = lexical.top_k(lexical.bm25(_items(spark, d), ITEM_WEIGHTS, _RARE), 30).select(F.lit("q").alias("query_id"), F.col("query_id").alias("lane"), "id", "rank")
    return lexical.interleaved(lanes).withColumn("rank", F.col("rank").cast("long"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_KNN = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), k AS (SELECT q.id AS query_id, v.id, v.label, round(list_distance(q.e, v.e), 6) AS distance FROM v q, v WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM k)"""


def _near(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.knn(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), k)


@query(f"WITH {_KNN} SELECT query_id, id, distance, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def knn_l2_topk(spark, d):
    return _near(spark, d, 10).select("query_id", "id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KNN} SELECT query_id, id, rank::BIGINT AS rank FROM r WHERE rank <= 20 AND label IN (1, 2, 3)")
def knn_postfilter(spark, d):
    label = table(spark, d, "embeddings").where("label IN (1, 2, 3)").select(F.col("vec_id").alias("id"))
    return _near(spark, d, 20).join(label, "id", "left_semi").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_KNN}, b AS (SELECT query_id, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM r WHERE id <> query_id GROUP BY 1)
    SELECT query_id, id, CASE WHEN round(1 - distance * distance / 2, 6) >= 0.6 THEN 'duplicate' WHEN round(1 - distance * distance / 2, 6) >= 0.45 THEN 'merge' ELSE 'new' END AS band FROM b""")
def dedup_bands(spark, d):
    near = vector.nearest_other(_near(spark, d, 3))
    return near.select("query_id", "id", promote.band(F.col("similarity"), 0.6, 0.45).alias("band"))


# --- fusion ----------------------------------------------------------------------------------------------------------

_DOCS = "d AS (SELECT doc_id AS id, text AS content, subject, author AS sender FROM documents)"
#: The query set: every vector with an id divisible by 20, with the subject of the document of that id as text where it has one.
_ASKED = """sp AS (SELECT 'q' || id AS query_id, unnest(list_distinct(regexp_split_to_array(lower(replace(subject, '"', ' ')), '\\s+'))) AS spelling FROM d JOIN (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0) USING (id)),
sw AS (SELECT query_id, spelling, regexp_extract_all(spelling, '[\\p{L}\\p{N}]+') AS t FROM sp),
qt AS (SELECT query_id, spelling AS phrase, i - 1 AS idx, t[i] AS word, length(spelling) >= 5 AND i = len(t) AS prefix, len(t) AS words FROM sw, unnest(range(1, len(t) + 1)) AS u(i))"""
_FUSED = f"""{_DOCS}, {_bm25_sql(_ASKED, ITEM_WEIGHTS)}, fts AS ({_top_sql(50)}), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
k AS (SELECT 'q' || q.id AS query_id, v.id, round(list_distance(q.e, v.e), 6) AS distance FROM v q, v WHERE q.id % 20 = 0),
vec AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM k) WHERE rank <= 50),
al AS (SELECT query_id, id, rank - 1 AS r0, 'fts' AS ix FROM fts UNION ALL SELECT query_id, id, rank - 1, 'vector' FROM vec),
fu AS (SELECT query_id, id, sum(1.0 / (30 + r0 + 1))::DOUBLE AS s, min(r0) FILTER (ix = 'fts') AS fr, min(r0) FILTER (ix = 'vector') AS vr FROM al GROUP BY ALL),
fused AS (SELECT query_id, id, round(s * CASE WHEN fr <= 2 AND vr <= 2 THEN 1.05 ELSE 1.0 END, 9) AS score, fr, vr FROM fu)"""


def _fused(spark, d) -> DataFrame:
    """The queries are all vectors with an id divisible by 20, each with the subject of the document of that id, where it has one, as text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "subject", F.col("author").alias("sender"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 20 = 0")
    name = F.concat(F.lit("q"), F.col("query_id")).alias("query_id")
    near = vector.knn(v, asked.withColumnRenamed("id", "query_id"), 50).select(name, "id", "rank")
    texts = docs.join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("subject").alias("text")).select(name, "text")
    phrases = stage(lexical.phrases_from(texts), "phrases")
    found = lexical.top_k(lexical.bm25(docs, ITEM_WEIGHTS, phrases), 50)
    return fusion.rrf([fusion.lane(found, "fts_items", "item", "fts"), fusion.lane(near, "vec_items", "item", "vector")]).withColumn("id", F.col("id").cast("long"))


@query(f"WITH {_FUSED}, t AS ({_top_sql(20, 'fused')}) {_OUT} t")
def rrf_fuse(spark, d):
    return _top(_fused(spark, d), 20)


@query(f"WITH {_FUSED} SELECT query_id, id, fr::BIGINT AS fts_rank, vr::BIGINT AS vector_rank FROM fused WHERE fr IS NOT NULL AND vr IS NOT NULL")
def rank_agreement(spark, d):
    return _fused(spark, d).where("fts_rank IS NOT NULL AND vector_rank IS NOT NULL").select("query_id", "id", F.col("fts_rank").cast("long").alias("fts_rank"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query(f"WITH {_FUSED}, b AS (SELECT query_id, max(score) AS b FROM fused GROUP BY 1) SELECT query_id, id, round(score, 6) AS score FROM fused JOIN b USING (query_id) WHERE score >= 0.6 * b")
def relevance_floor(spark, d):
    return fusion.relevance_floor(_fused(spark, d), 0.6).select("query_id", "id", F.round("score", 6).alias("score"))


_SCORED = f"{ITEMS}, {_bm25_sql(_phrases(True), ITEM_WEIGHTS)}"


def _scored(spark, d):
    return lexical.bm25(_items(spark, d), ITEM_WEIGHTS, _phrases(True))


@query(f"""WITH {_SCORED}, t AS ({_top_sql(200)}), nw AS (SELECT max(epoch_us(timestamp)) AS us FROM d),
    x AS (SELECT query_id, id, round(score * greatest(0.3, exp(-(nw.us - epoch_us(d.timestamp)) / 86400000000 / 30)), 6) AS score FROM t JOIN d USING (id), nw)
    SELECT query_id, id, score FROM x""")
def recency_decay(spark, d):
    items = _items(spark, d).select("id", "timestamp")
    now = items.agg(F.max("timestamp").alias("now"))
    rows = lexical.top_k(_scored(spark, d), 200).join(items, "id").join(F.broadcast(now))  # one row
    age = (F.unix_micros("now") - F.unix_micros("timestamp")) / 86_400_000_000
    return rows.select("query_id", "id", F.round(fusion.recency_decay(F.col("score"), age, 30, 0.3), 6).alias("score"))


@query(f"""WITH {_SCORED}, nw AS (SELECT max(epoch_us(timestamp)) AS us FROM d), s2 AS (SELECT s.* FROM scored s JOIN d USING (id), nw WHERE epoch_us(d.timestamp) >= nw.us - 7 * 86400000000::BIGINT),
    t AS ({_top_sql(10, 's2')}) SELECT query_id, id, rank::BIGINT AS rank FROM t""")
def recency_lane(spark, d):
    items = _items(spark, d).select("id", "timestamp")
    now = items.agg(F.max("timestamp").alias("now"))
    fresh = items.join(F.broadcast(now)).where(F.unix_micros("timestamp") >= F.unix_micros("now") - 7 * 86_400_000_000).select("id")
    return lexical.top_k(_scored(spark, d).join(fresh, "id", "left_semi"), 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SCORED}, t AS ({_top_sql(50)}), x AS (SELECT t.query_id, t.id, row_number() OVER (PARTITION BY query_id ORDER BY epoch_us(d.timestamp) // 3600000000 DESC, score DESC, id) AS place FROM t JOIN d USING (id))
    SELECT query_id, id, place::BIGINT AS place FROM x WHERE place <= 20""")
def time_sort_ties(spark, d):
    hour = F.floor(F.unix_micros("timestamp") / 3_600_000_000).alias("hour")
    rows = lexical.top_k(_scored(spark, d), 50).join(_items(spark, d).select("id", hour), "id")
    return fusion.time_order(rows, "hour", True).where("place <= 20").select("query_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {ITEMS} SELECT id FROM d WHERE timestamp BETWEEN TIMESTAMPTZ '2026-04-01 00:00:00+00' AND TIMESTAMPTZ '2026-04-02 00:00:00+00' ORDER BY timestamp DESC, id LIMIT 50")
def browse_window(spark, d):
    rows = _items(spark, d).where(F.col("timestamp").between(F.lit("2026-04-01").cast("timestamp"), F.lit("2026-04-02").cast("timestamp")))
    return rows.orderBy(F.desc("timestamp"), "id").limit(50).select("id")


@query(f"""WITH {_SCORED}, t AS ({_top_sql(50)}), x AS (SELECT t.*, sum(length(coalesce(d.content, '')) // 4) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM t JOIN d USING (id))
    SELECT query_id, id, upto::BIGINT AS upto FROM x WHERE upto <= 600 OR rank = 1""")
def token_budget(spark, d):
    rows = lexical.top_k(_scored(spark, d), 50).join(_items(spark, d).select("id", "content"), "id")
    return fusion.token_budget(rows, 600).select("query_id", "id", "upto")


_SESSIONS = f"""{ITEMS}, o AS (SELECT *, coalesce(thread_id, '') AS thread_key, epoch_us(timestamp) AS us FROM d WHERE {MESSAGES} AND timestamp IS NOT NULL),
e AS (SELECT *, CASE WHEN us - lag(us) OVER w > 14400000000 THEN 1 ELSE 0 END AS opens FROM o WINDOW w AS (PARTITION BY source, thread_key ORDER BY us, id)),
h AS (SELECT *, sum(opens) OVER (PARTITION BY source, thread_key ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS gap FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY source, thread_key, gap ORDER BY us, id) - 1 AS n FROM h),
m AS (SELECT *, n // 50 AS cap FROM i), s AS (SELECT source, thread_key, gap, cap, list(id ORDER BY us, id) AS ids, string_agg(coalesce(content, ''), ' ' ORDER BY us, id) AS content, min(us) AS us FROM m GROUP BY ALL HAVING count(*) >= 3),
docs AS (SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS id, thread_key AS thread_id, content FROM s)"""


def _sessions(spark, d, items: DataFrame | None = None):
    """(id, thread_id, source, content, participants, start_us, end_us) of the sessions of messages, as a table that searches read more than once.

    ``items``: a table of the distinct items, if there is one; their texts are then read from it, and members carry none.
    """
    if items is None:
        texts = members = stage(consolidate.capped_sessions(distinct_items(table(spark, d, "items").where(quality.is_message(F.col("source"))), "source", "timestamp", "sender", "content", "thread_id")), "members", sweep=True)
    else:
        texts = items.where(quality.is_message(F.col("source")))
        members = stage(consolidate.capped_sessions(texts.select("id", "source", "timestamp", "sender", "thread_id")), "members", sweep=True)
    c = stage(consolidate.consolidations(members), "consolidations", sweep=True)
    each = c.select("consolidation_id", F.posexplode("raw_item_ids").alias("pos", "id"))
    said = each.join(texts.select("id", "content"), "id").groupBy("consolidation_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("c")))).getField("c"), " ").alias("content"))
    rows = c.join(said, "consolidation_id")
    out = stage(rows.select(F.col("consolidation_id").alias("id"), F.col("thread_key").alias("thread_id"), "source", "content", "participants", "raw_item_ids", "start_us", "end_us"), "sessions", sweep=True)
    for done in (members, c):
        unstage(done)
    return out


@query(f"WITH {_SESSIONS}, {_bm25_sql(_phrases(True), {'content': 1.0}, 'docs')}, t AS ({_top_sql(10)}) {_OUT} t")
def bm25_sessions(spark, d):
    return _top(lexical.bm25(_sessions(spark, d), {"content": 1.0}, _phrases(True)), 10)


@query(f"""WITH {_SESSIONS}, si AS (WITH {_bm25_sql(_phrases(True), ITEM_WEIGHTS)} SELECT * FROM scored), ss AS (WITH {_bm25_sql(_phrases(True), {'content': 1.0}, 'docs')} SELECT * FROM scored),
    ti AS ({_top_sql(50, 'si')}), ts AS ({_top_sql(50, 'ss')}),
    fu AS (SELECT query_id, 'item' AS kind, id, round(1.0 / (30 + rank), 9)::DOUBLE AS score FROM ti UNION ALL SELECT query_id, 'session', id, round(1.05 / (30 + rank), 9)::DOUBLE FROM ts),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS place FROM fu),
    ld AS (SELECT query_id, thread_id, max(score) AS lead FROM pl JOIN docs USING (id) WHERE place <= 3 AND kind = 'session' AND thread_id <> '' GROUP BY ALL)
    SELECT fu.query_id, fu.kind, fu.id, round(fu.score + CASE WHEN fu.kind = 'item' THEN coalesce(0.15 * lead, 0) ELSE 0 END, 9)::DOUBLE AS score FROM fu LEFT JOIN d ON d.id = fu.id LEFT JOIN ld ON ld.query_id = fu.query_id AND ld.thread_id = d.thread_id""")
def thread_credit(spark, d):
    items, sessions = _items(spark, d), _sessions(spark, d)
    lanes = [
        fusion.lane(lexical.top_k(lexical.bm25(items, ITEM_WEIGHTS, _phrases(True)), 50), "fts_items", "item", "fts"),
        fusion.lane(lexical.top_k(lexical.bm25(sessions, {"content": 1.0}, _phrases(True)), 50), "fts_sessions", "session", "fts"),
    ]
    return fusion.thread_credit(fusion.rrf(lanes), items, sessions).select("query_id", "kind", "id", "score")


_FILTERED = f"""{_SESSIONS}, g2 AS (SELECT source, thread_key, gap, cap, list(id ORDER BY us, id) AS ids, string_agg(coalesce(content, ''), ' ' ORDER BY us, id) AS summary, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM m GROUP BY source, thread_key, gap, cap HAVING count(*) >= 3),
pp AS (SELECT source, thread_key, gap, cap, sender, min((us, id)) AS f FROM m WHERE sender IS NOT NULL AND sender <> '' GROUP BY source, thread_key, gap, cap, sender),
pq AS (SELECT source, thread_key, gap, cap, list(sender ORDER BY f) AS people FROM pp GROUP BY source, thread_key, gap, cap),
sx AS (SELECT 'cons:' || substr(sha256(array_to_string(ids, ',')), 1, 32) AS id, source, thread_key AS thread_id, ids, summary, start_us, end_us, n, coalesce(people, []) AS people, array_to_string(coalesce(people, []), ' ') AS participants FROM g2 LEFT JOIN pq USING (source, thread_key, gap, cap)),
ok AS (SELECT id FROM d WHERE source IN ('signal', 'email', 'teams_ops') AND timestamp >= TIMESTAMPTZ '2026-03-01 00:00:00+00' AND timestamp <= TIMESTAMPTZ '2026-05-01 00:00:00+00' AND NOT coalesce(timestamp_inferred, false) AND junk_reason IS NULL
  AND id NOT IN (SELECT unnest(ids) FROM sx) AND sender IS DISTINCT FROM 'me'),
os AS (SELECT id FROM sx WHERE source IN ('signal', 'email', 'teams_ops') AND end_us >= epoch_us(TIMESTAMP '2026-03-01') AND start_us <= epoch_us(TIMESTAMP '2026-05-01')),
si AS (WITH {_bm25_sql(_phrases(True), ITEM_WEIGHTS)} SELECT scored.* FROM scored JOIN ok USING (id)), ss AS (WITH {_bm25_sql(_phrases(True), SESSION_WEIGHTS, 'sx')} SELECT scored.* FROM scored JOIN os USING (id)),
ti AS ({_top_sql(200, 'si')}), ts AS ({_top_sql(200, 'ss')}),
fu AS (SELECT query_id, 'item' AS kind, id, round(1.0 / (30 + rank), 9)::DOUBLE AS score FROM ti UNION ALL SELECT query_id, 'session', id, round(1.05 / (30 + rank), 9)::DOUBLE FROM ts),
pz AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS place FROM fu),
ld AS (SELECT query_id, thread_id, max(score) AS lead FROM pz JOIN sx USING (id) JOIN os USING (id) WHERE place <= 3 AND kind = 'session' AND thread_id <> '' GROUP BY ALL),
cr AS (SELECT fu.query_id, fu.kind, fu.id, round(fu.score + CASE WHEN fu.kind = 'item' THEN coalesce(0.15 * lead, 0) ELSE 0 END, 9)::DOUBLE AS score FROM fu LEFT JOIN d ON d.id = fu.id LEFT JOIN ld ON ld.query_id = fu.query_id AND ld.thread_id = d.thread_id),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS c FROM cr) WHERE c <= 200),
sh AS (SELECT 'item' AS kind, id, source, epoch_us(timestamp) AS at_us, epoch_us(timestamp) AS end_us, sender, subject, thread_id, substr(coalesce(content, ''), 1, 400) AS preview FROM d
  UNION ALL SELECT 'session', id, source, start_us, least(end_us, epoch_us(TIMESTAMP '2026-05-01')), array_to_string(people[1:3], ', '), source || ' session (' || n || ' items)', thread_id, substr(summary, 1, 400) FROM sx),
lo AS (SELECT ct.query_id, ct.score, sh.*, row_number() OVER (PARTITION BY ct.query_id ORDER BY sh.end_us DESC NULLS LAST, ct.score DESC, ct.id) AS place FROM ct JOIN sh USING (kind, id))"""


@query(f"WITH {_FILTERED} SELECT query_id, place::BIGINT AS place, round(score, 6) AS score, kind, id, source, at_us::BIGINT AS at_us, sender, subject, thread_id, preview FROM lo WHERE place <= 20")
def hybrid_filtered(spark, d):
    """Every filter at once, newest first: sources, window, junk, members left to their sessions, an allow list and curated and associated weights."""
    sessions = _sessions(spark, d).withColumnRenamed("content", "summary")
    items = stage(store.mark_consolidated(_items(spark, d).withColumn("consolidated_into", F.lit(None).cast("string")), sessions.withColumnRenamed("id", "consolidation_id")), "items")
    cfg = HybridConfig(top_k=20, sort="desc", since="2026-03-01", until="2026-05-01", source_filter=["signal", "email", "teams_ops"], exclude_junk=True, exclude_ids=items.where("sender = 'me'"), tier_boost=1.2, query_shape="last_occurrence")
    found = hybrid(items, TEXTS, cfg, sessions)
    return hydrated(found, items, sessions).withColumn("place", F.col("place").cast("long"))


@query()
def hybrid_query(spark, d):
    """The whole plan over items, documents and sessions: lexical, dense, recency and rare-word lanes, credits, decay and floor.

    Only documents have vectors. The queries are those of ``rrf_fuse``, named by their number.
    """
    items = stage(distinct_items(table(spark, d, "items"), "source", "timestamp", "sender", "content", "subject", "thread_id"), "items", sweep=True)
    sessions = _sessions(spark, d, items).withColumnRenamed("content", "summary")
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("created_at").cast("timestamp").alias("timestamp"), F.col("author").alias("sender"), F.col("text").alias("content"), "subject")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    texts = documents.join(asked.select(F.col("query_id").cast("string").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("subject").alias("text"))
    cfg = HybridConfig(top_k=20, recency_lane_days=14, rare_term_df=25, decay_tau_days=60, relevance_floor=0.2)
    return hybrid(items.unionByName(documents, allowMissingColumns=True), texts, cfg, sessions, vectors, asked)


@query(f"""WITH {ITEMS}, x AS (SELECT id, CASE WHEN promoted_to IS NOT NULL OR source = 'tier2_ledger' THEN 'curated' WHEN source = 'email' THEN 'authored' WHEN source IN ('imessage', 'signal') THEN 'conversational'
      WHEN timestamp_inferred THEN 'inferred' ELSE 'conversational' END AS class FROM d), y AS (SELECT *, 0.9 * CASE class WHEN 'curated' THEN 1.0 WHEN 'authored' THEN 0.92 WHEN 'conversational' THEN 0.82 ELSE 0.7 END AS c FROM x)
    SELECT id, class, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM y""")
def trust_verdict(spark, d):
    rows = distinct_items(table(spark, d, "items"), "source", "timestamp_inferred", "promoted_to")
    kind = promote.provenance_class(F.col("source"), F.coalesce("timestamp_inferred", F.lit(False)), F.col("promoted_to").isNotNull())
    rows = rows.withColumn("class", kind)
    c = promote.effective_confidence(F.lit(0.9), F.col("class"), F.lit(0))
    return rows.select("id", "class", promote.trust_level(c, F.lit(False), F.lit(False)).alias("level"))


@query(f"""WITH {LOG}, up AS (SELECT result_id, count(*) AS n FROM (SELECT result_id FROM results WHERE cited UNION ALL SELECT result_id FROM feedback WHERE kind = 'correction') GROUP BY 1),
    down AS (SELECT result_id, count(DISTINCT query_id) AS n FROM feedback WHERE kind = 'bad_result' GROUP BY 1), b AS (SELECT result_id, greatest(0, up.n - coalesce(down.n, 0)) AS n FROM up LEFT JOIN down USING (result_id))
    SELECT r.query_id, r.result_id, r.rank::BIGINT AS rank, round(1.0 / (30 + rank) * (1 + least(0.03 * coalesce(b.n, 0), 0.15)), 6)::DOUBLE AS score FROM results r LEFT JOIN b USING (result_id)""")
def feedback_boost(spark, d):
    _, r, f = _log(spark, d)
    rows = r.join(signals.boost_counts(r, f), "result_id", "left")
    return rows.select("query_id", "result_id", F.col("rank").cast("long").alias("rank"), F.round(1.0 / (30 + F.col("rank")) * signals.boost_factor(F.coalesce("n", F.lit(0))), 6).alias("score"))
