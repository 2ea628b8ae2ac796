"""Hybrid retrieval: lexical lanes over items and sessions, dense lanes, recency, rare words and plain time, fused, weighted and ordered."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators import fusion, lexical, signals, vector
from emberlake.session import stage, unstage

ITEM_WEIGHTS = {"content": 1.0, "subject": 2.0, "sender": 1.0}
SESSION_WEIGHTS = {"summary": 1.0, "participants": 1.0}
CURATED, FACTS = "tier2_ledger", "chats_facts"
#: Questions that ask for a time: a hit needs the words.
TIME_SHAPES = ("first_occurrence", "last_occurrence", "temporal_range", "event_anchored")
COVERAGE_RANK = 5
PREVIEW = 400
_DAY_US = 86_400_000_000


@dataclass
class HybridConfig:
    """What a query asks for; None and empty lists switch a filter off.

    ``allowed`` and ``allowed_sessions`` are tables (id) that all lanes are held to: entity, participant or both, see
    ``people`` and ``entities``. ``links_boost``, ``feedback`` (id, n) and ``associations`` (id, weight) weigh what was found.
    """

    top_k: int = 20
    per_index_k: int = 50
    high_quality: bool = False
    source_filter: list[str] = field(default_factory=list)
    repo_filter: list[str] = field(default_factory=list)
    sender_filter: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    lang: str | None = None
    exclude_junk: bool = False
    exclude_ids: DataFrame | None = None
    allowed: DataFrame | None = None
    allowed_sessions: DataFrame | None = None
    rrf_k: int = fusion.RRF_K
    tier_boost: float = 1.0
    coverage: float = 0.0
    links_boost: DataFrame | None = None
    boost_factor: float = 3.0
    feedback: DataFrame | None = None
    associations: DataFrame | None = None
    recency_lane_days: int = 0
    recency_lane_weight: float = 0.5
    rare_term_df: int = 0
    rare_term_weight: float = 1.0
    decay_tau_days: float = 0.0
    decay_floor: float = 0.0
    now: str | None = None
    relevance_floor: float = 0.0
    query_shape: str = "factual"
    occurrence_browse: bool = False
    raw_only: bool = False
    sort: str = "relevance"
    prefixes: bool = True
    dim: int = 64

    def depth(self) -> int:
        """Results that each index is asked for: the widest of what the filters need, not their product."""
        wide = self.sort != "relevance" or self.since or self.until or self.decay_tau_days > 0 or self.allowed is not None or self.sender_filter
        return self.per_index_k * (4 if wide else 2 if self.high_quality else 1)

    def cap(self) -> int:
        """Fused results that are looked at further."""
        return max(2 * self.top_k, self.depth())


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def passing(items: DataFrame, cfg: HybridConfig, sessions: DataFrame | None = None) -> DataFrame:
    """The items that a configuration lets through; time bounds are inclusive. Facts only where asked for by source.

    Items that a session stands for are left to it, where ``sessions`` are searched too.
    """
    keep = F.lit(True)
    if cfg.source_filter:
        keep = keep & F.col("source").isin(cfg.source_filter)
    else:
        keep = keep & (F.coalesce("source", F.lit("")) != FACTS)
    if cfg.repo_filter:
        keep = keep & F.get_json_object("raw_metadata", "$.repo").isin(cfg.repo_filter)
    if cfg.since:
        keep = keep & (F.col("timestamp") >= _at(cfg.since))
    if cfg.until:
        keep = keep & (F.col("timestamp") <= _at(cfg.until))
    if cfg.lang:
        keep = keep & (F.col("lang") == cfg.lang)
    if cfg.exclude_junk:
        keep = keep & F.col("junk_reason").isNull()
    if cfg.sort != "relevance":
        keep = keep & ~F.coalesce("timestamp_inferred", F.lit(False))
    if sessions is not None and "consolidated_into" in items.columns:
        keep = keep & F.col("consolidated_into").isNull()
    rows = items.where(keep)
    if cfg.exclude_ids is not None:
        rows = rows.join(cfg.exclude_ids.select("id").distinct(), "id", "left_anti")
    return rows if cfg.allowed is None else rows.join(cfg.allowed.select("id").distinct(), "id", "left_semi")


def passing_sessions(sessions: DataFrame, items: DataFrame, cfg: HybridConfig) -> DataFrame:
    """The sessions that a configuration lets through: they touch the time window, and a member has the language. None where repositories are asked for."""
    keep = F.lit(not cfg.repo_filter)
    if cfg.source_filter:
        keep = keep & F.col("source").isin(cfg.source_filter)
    if cfg.since:
        keep = keep & (F.col("end_us") >= F.unix_micros(_at(cfg.since)))
    if cfg.until:
        keep = keep & (F.col("start_us") <= F.unix_micros(_at(cfg.until)))
    rows = sessions.where(keep)
    if cfg.lang:
        member = rows.select(F.col("id").alias("_s"), F.explode("raw_item_ids").alias("id")).join(items.where(F.col("lang") == cfg.lang).select("id"), "id", "left_semi")
        rows = rows.join(member.select(F.col("_s").alias("id")).distinct(), "id", "left_semi")
    return rows if cfg.allowed_sessions is None else rows.join(cfg.allowed_sessions.select("id").distinct(), "id", "left_semi")


def entity_allowlist(links: DataFrame, entities: DataFrame, names: list[str], sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(id) of the items linked to an entity of one of ``names``, in any case, and of the sessions that hold such an item.

    ``links(item_id, entity_id)``.
    """
    wanted = entities.where(F.lower("canonical_name").isin([n.lower() for n in names])).select(F.col("id").alias("entity_id"))
    ids = links.join(wanted, "entity_id", "left_semi").select(F.col("item_id").alias("id")).distinct()
    return ids, None if sessions is None else sessions_of(sessions, ids)


def sessions_of(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the ``sessions`` that contain one of the items ``ids(id)``."""
    member = sessions.select(F.col("id").alias("_s"), F.explode("raw_item_ids").alias("id"))
    return member.join(ids, "id", "left_semi").select(F.col("_s").alias("id")).distinct()


def participant_sessions(sessions: DataFrame, identities: list[str], ids: DataFrame) -> DataFrame:
    """(id) of the sessions that one of ``identities`` took part in, or that contain one of the items ``ids(id)``."""
    own = sessions.where(F.arrays_overlap("participants", F.array(*map(F.lit, identities)))).select("id")
    return own.unionByName(sessions_of(sessions, ids)).distinct()


@dataclass
class Found:
    """What the words of all queries have found in one index: its ``lexical.hits`` and ``spelling_weights``."""

    hits: DataFrame
    weights: DataFrame

    def among(self, only: DataFrame, asked: DataFrame, k: int, *group: str) -> DataFrame:
        """(group..., id, score) of the documents ``only(id)``; best ``k`` of each query, or all where a word is scored alone."""
        scored = lexical.scores(self.hits.join(only, "id", "left_semi"), self.weights, asked, *group)
        return lexical.best(scored, k) if group == ("query_id",) else lexical.top_k(scored.withColumn("_w", F.struct(*group)), k, "_w").drop("_w")


def _find(docs: DataFrame, weights: dict[str, float], words: DataFrame, keep) -> Found:
    index = lexical.index_of(docs, list(weights), keep)
    hits = lexical.hits(index, weights, words)
    found = Found(hits, lexical.spelling_weights(hits, index))
    unstage(index)
    return found


def rare_lanes(items: Found, asked: DataFrame, allowed: DataFrame, cfg: HybridConfig, sessions: Found | None, allowed_sessions: DataFrame | None) -> list[DataFrame]:
    """Each word of at most ``rare_term_df`` items searched alone, with all its items; hits dealt out by rank. Queries of one word have no such lane."""
    more = asked.groupBy("query_id").agg(F.count("*").alias("_n")).where("_n > 1").select("query_id")
    rare = items.weights.where(F.col("n") <= cfg.rare_term_df).select("s")
    words = stage(asked.join(more, "query_id", "left_semi").join(rare, "s", "left_semi"), "rare_words", sweep=True)

    def dealt(found: Found, only: DataFrame, k: int) -> DataFrame:
        few = Found(found.hits.join(words.select("s"), "s", "left_semi"), found.weights)
        return lexical.interleaved(few.among(only, words, k, "query_id", "phrase").withColumnRenamed("phrase", "lane"))

    lanes = [fusion.lane(dealt(items, allowed, cfg.rare_term_df), "rare_items", "item", "fts", cfg.rare_term_weight)]
    if sessions is not None:
        lanes.append(fusion.lane(dealt(sessions, allowed_sessions, cfg.depth()), "rare_sessions", "session", "fts", cfg.rare_term_weight))
    return [stage(x, "rare_lane", sweep=True) for x in lanes]


def _nearest(vectors: DataFrame, asked: DataFrame, cfg: HybridConfig) -> DataFrame:
    return vector.knn(vectors, asked, cfg.depth(), cfg.dim).select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), "rank")


def hybrid(items: DataFrame, texts: dict[str, str] | DataFrame, cfg: HybridConfig, sessions: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, session_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, place, kind, id, score) for each of ``texts`` (query id to text, or a table (query_id, text), which takes no synonyms).

    ``items``: distinct items; ``sessions(id, thread_id, summary, participants)``, for filters also source, start_us, end_us and raw_item_ids; ``vectors(id, embedding)`` and
    ``query_vectors(query_id, embedding)`` make a dense lane, ``session_vectors(id, embedding)`` one over sessions. Corpus statistics count all items, filters apply to
    what was found. Blank texts find nothing in words; a query that finds nothing at all gets the newest items of its time window, if it has one.
    """
    if isinstance(texts, DataFrame):
        if synonyms:
            raise ValueError("synonyms need the texts as a dictionary")
        queries, keep, plain = texts.select("query_id"), None, None
        phrases = stage(lexical.phrases_from(texts, cfg.prefixes), "phrases", sweep=True)
    else:
        queries = items.sparkSession.createDataFrame([(q,) for q in texts], "query_id string")
        listed, literal = ([p for q, t in texts.items() for p in lexical.phrases_of(q, t, s, cfg.prefixes)] for s in (synonyms, None))
        phrases, plain = (lexical.phrase_table(items.sparkSession, x) for x in (listed, literal))
        keep = lexical.asked(listed + literal)
    asked, asked_literal, words = lexical.spelt(phrases, plain)
    of_items = _find(items, ITEM_WEIGHTS, words, keep)
    allowed = stage(passing(items, cfg, sessions).select("id", "timestamp"), "allowed", sweep=True)
    ids = allowed.select("id")
    recent = cfg.recency_lane_days and cfg.sort == "relevance" and not cfg.since
    now = _now(items, cfg)
    fresh = F.unix_micros("timestamp") >= F.col("now_us") - cfg.recency_lane_days * _DAY_US
    new_ids = allowed.join(F.broadcast(now)).where(fresh).select("id") if recent else None  # one row
    cut = lambda found, only: stage(found.among(only, asked, cfg.depth(), "query_id"), "best", sweep=True)
    lanes = [fusion.lane(cut(of_items, ids), "fts_items", "item", "fts")]
    if recent:
        lanes.append(fusion.lane(cut(of_items, new_ids), "recency", "item", "fts", cfg.recency_lane_weight))
    of_sessions = None
    if sessions is not None:
        of_sessions = _find(sessions, SESSION_WEIGHTS, words, keep)
        sessions = passing_sessions(sessions, items, cfg)
        lanes.append(fusion.lane(cut(of_sessions, sessions.select("id")), "fts_sessions", "session", "fts"))
        if recent and "end_us" in sessions.columns:
            ended = sessions.join(F.broadcast(now)).where(F.col("end_us") >= F.col("now_us") - cfg.recency_lane_days * _DAY_US).select("id")  # one row
            lanes.append(fusion.lane(cut(of_sessions, ended), "recency_sessions", "session", "fts", cfg.recency_lane_weight))
    if vectors is not None and query_vectors is not None:
        # The nearest overall first, filters after, as an index would.
        near = stage(_nearest(vectors, query_vectors, cfg), "near", sweep=True)
        lanes.append(fusion.lane(near.join(ids, "id", "left_semi"), "vec_items", "item", "vector"))
        if recent:
            lanes.append(fusion.lane(near.join(new_ids, "id", "left_semi"), "recency_vec", "item", "vector", cfg.recency_lane_weight))
    if sessions is not None and session_vectors is not None and query_vectors is not None:
        near = stage(_nearest(session_vectors, query_vectors, cfg), "near_sessions", sweep=True)
        lanes.append(fusion.lane(near.join(sessions.select("id"), "id", "left_semi"), "vec_sessions", "session", "vector"))
        if recent and "end_us" in sessions.columns:
            lanes.append(fusion.lane(near.join(ended, "id", "left_semi"), "recency_vec_sessions", "session", "vector", cfg.recency_lane_weight))
    if cfg.rare_term_df > 0:
        lanes += rare_lanes(of_items, asked_literal, ids, cfg, of_sessions, None if sessions is None else sessions.select("id"))
    fused = stage(fusion.rrf(lanes, cfg.rrf_k), "fused", sweep=True)
    for found in (of_items, of_sessions):
        if found is not None:
            unstage(found.hits)
    if sessions is not None:
        fused = stage(fusion.thread_credit(fused, items, sessions), "credited", sweep=True)
    rows = lexical.top_k(fused, cfg.cap()).drop("rank").withColumn("kept", F.lit(False))
    if (cfg.since or cfg.until) and cfg.allowed is None:
        rows = rows.unionByName(_by_time(queries.join(rows.select("query_id").distinct(), "query_id", "left_anti"), allowed, cfg, cfg.cap()).withColumn("kept", F.lit(False)))
    if cfg.occurrence_browse and cfg.sort != "relevance" and cfg.allowed is not None:
        lane = _by_time(queries, allowed, cfg, cfg.top_k)
        marks = lane.select("query_id", "kind", "id", F.lit(True).alias("_mark"))
        rows = rows.join(marks, ["query_id", "kind", "id"], "left").withColumn("kept", F.coalesce("_mark", F.lit(False))).drop("_mark")
        rows = rows.unionByName(lane.join(rows.select("query_id", "kind", "id"), ["query_id", "kind", "id"], "left_anti").withColumn("kept", F.lit(True)))
    return ordered(weighted(located(rows, items, sessions), now, cfg), cfg)


def _now(items: DataFrame, cfg: HybridConfig) -> DataFrame:
    """One row (now_us): the given time, or that of the newest item."""
    latest = F.max(F.unix_micros("timestamp"))
    return items.agg((latest if cfg.now is None else F.unix_micros(_at(cfg.now)) + F.lit(0) * F.count("*")).alias("now_us"))


def _by_time(queries: DataFrame, allowed: DataFrame, cfg: HybridConfig, n: int) -> DataFrame:
    """The ``n`` items nearest the end that the order asks for, the newest first as a rule, for each of ``queries``, with score 0."""
    first = F.asc("timestamp") if cfg.sort == "asc" else F.desc("timestamp")
    rows = allowed.where("timestamp IS NOT NULL").orderBy(first, "id").limit(n).groupBy().agg(F.collect_list("id").alias("ids"))  # n ids in one row
    none = F.lit(None).cast("int")
    return queries.join(F.broadcast(rows)).select("query_id", F.lit("item").alias("kind"), F.explode("ids").alias("id"), F.lit(0.0).alias("score"), none.alias("fts_rank"), none.alias("vector_rank"))


def located(rows: DataFrame, items: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """``rows`` with source, sender list, start and end of what was found; what is gone since it was indexed is left out."""
    own = items.select(F.lit("item").alias("kind"), "id", "source", F.array("sender").alias("people"), F.unix_micros("timestamp").alias("start_us"), F.unix_micros("timestamp").alias("end_us"))
    if sessions is not None:
        has = lambda c, t: F.col(c) if c in sessions.columns else F.lit(None).cast(t)
        people = has("participants", "array<string>") if dict(sessions.dtypes).get("participants", "").startswith("array") else F.lit(None).cast("array<string>")
        own = own.unionByName(sessions.select(F.lit("session").alias("kind"), "id", has("source", "string").alias("source"), people.alias("people"), has("start_us", "long").alias("start_us"), has("end_us", "long").alias("end_us")))
    return rows.join(own, ["kind", "id"])


def weighted(rows: DataFrame, now: DataFrame, cfg: HybridConfig) -> DataFrame:
    """``rows`` with their score after coverage, tier, decay, links, feedback and associations; ``exact``: whether no association was needed."""
    score = F.col("score")
    curated = F.coalesce(F.col("source") == CURATED, F.lit(False))
    if cfg.coverage and cfg.query_shape == "factual":
        score = score + F.when(curated & (F.col("fts_rank") <= COVERAGE_RANK) & F.col("vector_rank").isNull(), cfg.coverage / (cfg.rrf_k + F.col("fts_rank") + 1)).otherwise(0.0)
    if cfg.tier_boost != 1.0:
        score = score * F.when(curated, cfg.tier_boost).otherwise(1.0)
    if cfg.decay_tau_days > 0 and cfg.sort == "relevance":
        rows = rows.join(F.broadcast(now))  # one row
        age = (F.col("now_us") - F.col("start_us")) / _DAY_US
        score = F.when(F.col("start_us").isNull() | curated, score).otherwise(fusion.recency_decay(score, age, cfg.decay_tau_days, cfg.decay_floor))
    rows = rows.withColumn("score", score)
    if cfg.links_boost is not None:
        rows = rows.join(cfg.links_boost.select("id", F.lit(cfg.boost_factor).alias("_f")).distinct(), "id", "left").withColumn("score", F.col("score") * F.coalesce("_f", F.lit(1.0))).drop("_f")
    if cfg.feedback is not None:
        rows = rows.join(cfg.feedback.select("id", F.col("n").alias("_n")), "id", "left").withColumn("score", F.col("score") * signals.boost_factor(F.coalesce("_n", F.lit(0)))).drop("_n")
    weight = F.lit(1.0)
    if cfg.associations is not None:
        rows = rows.join(cfg.associations.select("id", F.col("weight").alias("_w")), "id", "left")
        weight = F.coalesce("_w", F.lit(1.0))
    return rows.withColumn("score", F.col("score") * weight).withColumn("exact", weight >= 1.0).drop("_w", "now_us")


def ordered(rows: DataFrame, cfg: HybridConfig) -> DataFrame:
    """The ``top_k`` rows of each query with place: by score, or by time with the better score first at equal times; associated ones behind exact ones."""
    if cfg.sender_filter:
        rows = rows.where(F.arrays_overlap("people", F.array(*map(F.lit, cfg.sender_filter))))
    if cfg.sort != "relevance" and cfg.query_shape in TIME_SHAPES:
        said = rows.groupBy("query_id").agg(F.max(F.col("fts_rank").isNotNull()).alias("_said"))
        rows = rows.join(said, "query_id").where("NOT _said OR fts_rank IS NOT NULL OR kept").drop("_said")
    if cfg.relevance_floor:
        rows = fusion.relevance_floor(rows, cfg.relevance_floor, keep=F.col("kept"))
    if cfg.sort == "desc":
        end = F.col("end_us") if cfg.until is None else F.least("end_us", F.unix_micros(_at(cfg.until)))
        rows = rows.withColumn("_at", -end)
    else:
        rows = rows.withColumn("_at", F.col("start_us") if cfg.sort == "asc" else F.lit(0).cast("long"))
    order = F.struct((~F.col("exact")).alias("a"), F.coalesce("_at", F.lit((1 << 63) - 1)).alias("b"), (-F.col("score")).alias("c"))
    out = lexical.top_k(rows.withColumn("_o", order), cfg.top_k, score=F.col("_o").asc()).withColumnRenamed("rank", "place")
    if cfg.raw_only:
        out = out.where(~F.coalesce(F.col("source") == CURATED, F.lit(False)))
    return out.select("query_id", "place", "kind", "id", "score")


def hydrated(results: DataFrame, items: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``results`` of ``hybrid`` as shown: source, at_us, sender, subject, thread_id and a preview of the text.

    A session's sender is its first three participants, its subject its source and size.
    """
    wanted = results.select("kind", "id").distinct()
    cols = ["kind", "id", "source", "at_us", "sender", "subject", "thread_id", "preview"]
    preview = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, PREVIEW).alias("preview")
    shown = [items.select(F.lit("item").alias("kind"), "id", "source", F.unix_micros("timestamp").alias("at_us"), "sender", "subject", "thread_id", preview("content"))]
    if sessions is not None:
        subject = F.concat(F.col("source"), F.lit(" session ("), F.size("raw_item_ids").cast("string"), F.lit(" items)"))
        shown.append(sessions.select(F.lit("session").alias("kind"), "id", "source", F.col("start_us").alias("at_us"), F.array_join(F.slice("participants", 1, 3), ", ").alias("sender"), subject.alias("subject"), "thread_id", preview("summary")))
    rows = reduce(DataFrame.unionByName, [x.select(*cols).join(wanted, ["kind", "id"], "left_semi") for x in shown])
    return results.join(rows, ["kind", "id"]).withColumn("score", F.round("score", 6)).select("query_id", "place", "score", *cols)
