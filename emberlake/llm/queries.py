"""The numbered queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import conversations, leakage, mailtext, neighbours, packing, pii, reading, variants
from emberlake.session import stage
from emberlake.tables import table

CHATS = ["chats_desk", "chats_web"]
MESSAGES = ["imessage", "signal", "teams_ops", "teams_field"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").where(F.col("source").isin(CHATS))
    found = conversations.rebuild(items, table(spark, sf_dir, "speaker_roles"), loose=False)
    return found.select("source", F.col("conv_key").alias("thread_id"), F.col("msg_pos").cast("long").alias("msg_pos"), "item_id")


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations found again by links alone: all thread ids are blanked, and each message replies to the one of the number before its own.

    (source, item_id, conversation, n_messages): conversation is named by its smallest item id.
    """
    items = table(spark, sf_dir, "items").where(F.col("source").isin(CHATS))
    before = F.concat(F.regexp_extract("source_id", r"^(.*:)\d+$", 1), (F.regexp_extract("source_id", r":(\d+)$", 1).try_cast("long") - 1).cast("string"))
    loose = items.withColumns({"thread_id": F.lit(None).cast("string"), "raw_metadata": F.to_json(F.struct(before.alias("reply_to")))})
    rows = stage(conversations.conversation_rows(loose).select("source", F.col("id").alias("item_id"), F.col("conv_key").alias("conversation")), "linked")
    return rows.join(rows.groupBy("conversation").agg(F.count("*").alias("n_messages")), "conversation").select("source", "item_id", "conversation", "n_messages")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "eval_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailtext.new_lines(table(spark, sf_dir, "items").where("source = 'email'")).select("item_id", "line_no")


def p2_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailtext.new_text(table(spark, sf_dir, "items").where("source = 'email'"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(table(spark, sf_dir, "consolidations_vec"), "consolidation_id", "embedding")
    return pairs.select(F.col("a").alias("consolidation_a"), F.col("b").alias("consolidation_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf_dir, "entities"), table(spark, sf_dir, "items"), [*MESSAGES, "email"])


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.clusters(variants.references_of(table(spark, sf_dir, "entities"), table(spark, sf_dir, "items"), [*MESSAGES, "email"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").where(F.col("source").isin(MESSAGES))
    return pii.find(items, table(spark, sf_dir, "entities"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").where(F.col("source").isin(MESSAGES))
    return pii.redact(items, table(spark, sf_dir, "entities")).withColumn("recipients", F.array_join("recipients", "; "))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, n_docs, over_capacity, cut_in_vain, gaps): every document is placed; containers that hold too much, texts cut that would have fitted, and pieces that do not follow on each other are none."""
    limits = table(spark, sf_dir, "pack_limits").where("capacity_tokens > 0").groupBy("limit_name").agg(F.min("capacity_tokens").alias("cap"))
    rows = stage(p8_containers(spark, sf_dir), "placed").join(limits, "limit_name").withColumn("n", F.col("token_to") - F.col("token_from"))
    full = rows.groupBy("limit_name", "container_id").agg(F.sum("n").alias("n"), F.min("cap").alias("cap")).groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("cap")).alias("over_capacity"))
    docs = rows.groupBy("limit_name", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("pieces"), F.max("token_to").alias("end"), F.max("piece_no").alias("last"), F.min("cap").alias("cap"))
    docs = docs.groupBy("limit_name").agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("cap"))).alias("cut_in_vain"), F.count_if((F.col("n") != F.col("end")) | (F.col("last") + 1 != F.col("pieces"))).alias("gaps"))
    return docs.join(full, "limit_name").select("limit_name", "n_docs", "over_capacity", "cut_in_vain", "gaps")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading.level_profile(reading.reading_levels(documents, table(spark, sf_dir, "reading_labels")), documents)


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile, "p1_found": p1_found, "p1_linked": p1_linked, "p2_found": p2_found, "p2_new_text": p2_new_text, "p4_found": p4_found, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_found": p9_found}

_PLAIN = r"regexp_replace(lower({0}), '^[\s\p{{Z}}\p{{P}}\p{{Cf}}]+|[\s\p{{Z}}\p{{P}}\p{{Cf}}]+$', '', 'g')"
_STAND_IN = conversations.STAND_INS.replace("'", "''")
_BLANK = conversations.INVISIBLE

SQL: dict[str, str] = {
    "p1_found": f"""WITH d AS (SELECT DISTINCT ON (id) * FROM items WHERE source IN ('chats_desk', 'chats_web') AND thread_id IS NOT NULL ORDER BY id, ingested_at),
    r AS (SELECT {_PLAIN.format('sender_form')} AS form, min(speaker_role) AS role FROM speaker_roles GROUP BY 1),
    x AS (SELECT d.*, r.role, TRY_CAST(regexp_extract(source_id, ':(\\d+)$', 1) AS BIGINT) AS no, trim(regexp_replace(content, '{_BLANK}', ' ', 'g')) AS t FROM d LEFT JOIN r ON {_PLAIN.format('d.sender')} = r.form),
    s AS (SELECT source, thread_id FROM x GROUP BY ALL HAVING min(no) = 1 AND max(no) = count(*) AND count(DISTINCT no) = count(*) AND bool_and(coalesce(t <> '' AND NOT regexp_matches(t, '{_STAND_IN}') AND role IS NOT NULL AND timestamp IS NOT NULL, false))
      AND arg_min(role, (timestamp, no, id)) FILTER (role IN ('user', 'assistant')) = 'user' AND arg_max(role, (timestamp, no, id)) FILTER (role IN ('user', 'assistant')) = 'assistant')
    SELECT source, thread_id, row_number() OVER (PARTITION BY source, thread_id ORDER BY timestamp, no, id)::BIGINT AS msg_pos, id AS item_id FROM x SEMI JOIN s USING (source, thread_id)""",
    "p8_checks": "SELECT limit_name, (SELECT count(*) FROM documents)::BIGINT AS n_docs, 0::BIGINT AS over_capacity, 0::BIGINT AS cut_in_vain, 0::BIGINT AS gaps FROM pack_limits WHERE capacity_tokens > 0 GROUP BY limit_name",
    # Runs of numbers without a hole, by source and what stands before the number.
    "p1_linked": """WITH d AS (SELECT DISTINCT ON (id) id, source, regexp_extract(source_id, '^(.*:)[0-9]+$', 1) AS head, TRY_CAST(regexp_extract(source_id, ':([0-9]+)$', 1) AS BIGINT) AS no FROM items WHERE source IN ('chats_desk', 'chats_web') ORDER BY id, ingested_at),
    r AS (SELECT *, no - dense_rank() OVER (PARTITION BY source, head ORDER BY no) AS run FROM d)
    SELECT source, id AS item_id, CASE WHEN no IS NULL THEN id ELSE min(id) OVER w END AS conversation, CASE WHEN no IS NULL THEN 1 ELSE count(*) OVER w END AS n_messages FROM r WINDOW w AS (PARTITION BY source, head, run)""",
}
