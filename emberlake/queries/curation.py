"""Queries of the curation operators, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlake.operators import curation
from emberlake.queries.relational import ITEMS, LOG, MESSAGES, _log, _messages
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


@query("""WITH m AS (SELECT l_orderkey AS item_id, CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 1 ELSE l_partkey END AS entity_id, l_discount AS confidence FROM lineitem)
    SELECT item_id, entity_id, max(confidence) AS confidence FROM m GROUP BY ALL""")
def entity_merge(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("entity_id"), F.col("l_discount").alias("confidence"))
    merges = table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") - 1).alias("survivor"))
    return curation.merged_links(links, merges)


@query("""WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_discount AS w FROM lineitem), m AS (SELECT CASE WHEN a % 10 = 3 THEN a - 1 ELSE a END AS entity_a, CASE WHEN b % 10 = 3 THEN b - 1 ELSE b END AS entity_b, w FROM r)
    SELECT entity_a, entity_b, max(w) AS weight FROM m WHERE entity_a <> entity_b GROUP BY ALL""")
def relation_merge(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_a"), F.col("l_suppkey").alias("entity_b"), F.col("l_discount").alias("weight")).distinct()
    ids = r.select(F.col("entity_a").alias("entity_id")).unionByName(r.select(F.col("entity_b").alias("entity_id"))).distinct()
    return curation.merged_relations(r, ids.where("entity_id % 10 = 3").withColumn("survivor", F.col("entity_id") - 1))


@query(f"""WITH {ITEMS}, m AS (SELECT id, thread_id, timestamp, substr(id, 1, 1) = 'a' AS labelled, lag(id) OVER w AS p, lead(id) OVER w AS n FROM d WHERE {MESSAGES} WINDOW w AS (PARTITION BY thread_id ORDER BY timestamp, id)),
    o AS (SELECT id FROM m WHERE labelled UNION SELECT p FROM m WHERE labelled AND p IS NOT NULL UNION SELECT n FROM m WHERE labelled AND n IS NOT NULL) SELECT id FROM m WHERE id NOT IN (SELECT id FROM o)""")
def neighbour_exclusion(spark, d):
    rows = _messages(spark, d).select("id", "thread_id", "timestamp")
    return curation.without_neighbours(rows, rows.where("substr(id, 1, 1) = 'a'"), "thread_id", "timestamp", "id").select("id")


@query("""WITH b AS (SELECT o_orderkey, ('0x' || substr(sha1(o_custkey::VARCHAR), 1, 15))::BIGINT % 100 AS b, o_orderstatus = 'F' AS label FROM orders),
    f AS (SELECT o_orderkey, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'holdout' END AS fold, label FROM b) SELECT o_orderkey, fold, unnest(range(1, CASE WHEN fold = 'train' AND label THEN 4 ELSE 2 END))::INT AS copy FROM f""")
def training_set(spark, d):
    rows = table(spark, d, "orders").withColumn("label", F.col("o_orderstatus") == "F")
    return curation.training_rows(rows, "o_custkey", "label", 3).select("o_orderkey", "fold", "copy")


@query("""SELECT count(*)::BIGINT AS n, count(*) FILTER (x = y)::BIGINT AS agree, count(*) FILTER (x AND y)::BIGINT AS both_true FROM (SELECT value > 10 AS x, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 2) = 0 AS y FROM events)""")
def two_run_consensus(spark, d):
    e = table(spark, d, "events")
    return curation.consensus(e.select(F.col("event_id").alias("id"), (F.col("value") > 10).alias("verdict")), e.select(F.col("event_id").alias("id"), (F.get_json_object("props", "$.k").cast("long") % 2 == 0).alias("verdict")))


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), q AS (SELECT event_id AS query_id, user_id, us FROM e WHERE event_type = 'purchase'), h AS (SELECT q.query_id, e.event_id AS hit_id, e.value AS score FROM q JOIN e ON e.user_id = q.user_id AND e.event_type = 'view' AND e.us <= q.us AND e.us >= q.us - 259200000000)
    SELECT query_id, place::BIGINT AS place, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS place FROM h) WHERE place <= 3""")
def windowed_hits(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    q = e.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), "user_id", "us")
    h = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("hit_id"), F.col("value").alias("score"), "us").join(q.select("query_id", "user_id"), "user_id")
    return curation.hits_before(q, h, 3, 3).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {LOG} SELECT lower(text) AS text, arg_min(id, (ts, id)) AS id FROM queries GROUP BY 1")
def earliest_per_text(spark, d):
    return curation.earliest_per_text(_log(spark, d)[0])


@query("""WITH s AS (SELECT l_linenumber AS k, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1) SELECT min(k) AS k FROM s WHERE score >= (SELECT max(score) FROM s) * 0.99""")
def knee(spark, d):
    return curation.knee(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_extendedprice").alias("score")))


@query("""WITH r AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
    SELECT count(*) FILTER (b < a)::BIGINT AS up, count(*) FILTER (b > a)::BIGINT AS down, count(*) FILTER (a = b)::BIGINT AS same, count(*) FILTER (a >= 5 AND b <= 3)::BIGINT AS into_top3 FROM r""")
def rank_movement(spark, d):
    w = Window.partitionBy("o_custkey")
    ranks = table(spark, d, "orders").select(F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("before"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("after"))
    return curation.movement(ranks)


@query("""SELECT o_custkey AS id, count(*)::BIGINT AS n, count(*) FILTER (o_totalprice > 150000) * 2 > count(*) AS relevant FROM orders GROUP BY 1""")
def judge_votes(spark, d):
    return curation.votes(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") > 150000).alias("vote")))


@query("""SELECT arg_min(epoch_us(ingested_at), (ingested_at, id))::BIGINT AS first_us, arg_min(id, (ingested_at, id)) AS first_id, arg_max(epoch_us(ingested_at), (ingested_at, id))::BIGINT AS last_us, arg_max(id, (ingested_at, id)) AS last_id, count(*)::BIGINT AS n,
    sum(('0x' || substr(sha1(id), 1, 15))::BIGINT % 2147483648)::BIGINT AS checksum FROM items""")
def run_window(spark, d):
    return curation.run_window(table(spark, d, "items"))
