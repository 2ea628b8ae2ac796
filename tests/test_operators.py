import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlake.functions import abbreviations, text
from emberlake.operators import entities, evaluate, fusion, lexical, people, quality, signals, vector
from emberlake.plans.retrieve import HybridConfig, hybrid
from emberlake.sources import store

T0 = datetime(2026, 4, 1, 12, tzinfo=timezone.utc)
ITEM = "id string, source string, thread_id string, timestamp timestamp, sender string, recipients array<string>, content string, subject string, junk_reason string, lang string, timestamp_inferred boolean"


def _items(spark, rows):
    full = [{"id": str(k), "source": "signal", "thread_id": "t", "timestamp": T0 + timedelta(minutes=k), "sender": "a", "recipients": ["me"], "content": "words enough to stay", "subject": None, "junk_reason": None, "lang": "en", "timestamp_inferred": False} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], ITEM)


def test_annotation_order_and_null_safe_copies(spark):
    items = _items(spark, [
        {"content": "ok"}, {"source": "imessage", "content": "Liked “that”"}, {"content": "the same words"}, {"content": "the same words"}, {"content": "the same words", "thread_id": None},
        {"content": "the same words", "thread_id": None}, {"content": "the same words", "timestamp": T0 + timedelta(days=2)}, {"content": None}, {"content": "short", "junk_reason": "kept"}, {"source": "email", "content": "x"},
    ])
    got = {r["id"]: r["junk_reason"] for r in quality.annotate(items).collect()}
    assert got == {"0": "mech:short", "1": "mech:reaction", "3": "mech:dup", "5": "mech:dup"}
    assert quality.annotate(items, spark.createDataFrame([("0",)], "id string")).where("id = '0'").count() == 0


def test_context_is_strict_on_ties(spark):
    same = T0
    items = _items(spark, [{"content": "first", "timestamp": same}, {"content": "second", "timestamp": same}, {"content": "later"}])
    got = {r["id"]: (r["prev"], r["next"]) for r in quality.context(items).collect()}
    assert got == {"0": ("", "later"), "1": ("", "later"), "2": ("first", "")}


def test_exchanges_by_window_and_direct(spark):
    hour = lambda h: T0 + timedelta(hours=h)
    items = _items(spark, [
        {"sender": "me", "recipients": ["x", "y"], "timestamp": hour(0)}, {"sender": "Bo", "recipients": ["x", "y"], "timestamp": hour(2)}, {"sender": "bo", "recipients": ["x", "y"], "timestamp": hour(4.01)},
        {"sender": "me", "recipients": ["BO"], "thread_id": None, "timestamp": hour(50)}, {"sender": "me", "recipients": [], "thread_id": None, "timestamp": hour(51)}, {"sender": None, "recipients": None},
    ])
    assert {r["id"] for r in people.exchanges(items, ["Bo"], ["me"]).collect()} == {"0", "1", "3"}


def test_shared_alias_links_nobody_and_canonical_wins(spark):
    e = spark.createDataFrame([(1, "Alex Berg", "person", ["Alex", None, ""], 0), (2, "Alex Dahl", "person", ["Alex", "alex berg"], 1), (3, "Gone", "person", ["gone@x"], 2)], "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int")
    items = _items(spark, [{"sender": "Alex"}, {"sender": "ALEX BERG"}, {"recipients": ["alex dahl", None]}, {"sender": "gone@x"}])
    assert {(r["item_id"], r["entity_id"]) for r in people.participant_links(items, e).collect()} == {("1", 1), ("2", 2)}


def test_tags_take_the_longest_name(spark):
    e = spark.createDataFrame([(1, "Blue", "x", None, 0), (2, "Blue Anchor", "x", ["Old  Blue"], 0), (3, "Anchor", "x", [], 2)], "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int")
    docs = spark.createDataFrame([("a", "The blue-anchor, blue and OLD BLUE."), ("b", None), ("c", "")], "id string, text string")
    assert {(r["id"], r["entity_id"], r["n"]) for r in entities.dictionary_tags(docs, e).collect()} == {("a", 1, 1), ("a", 2, 2)}


def test_npmi_always_together_and_chance(spark):
    links = [(k, e) for k in range(20) for e in (("a", "b") if k < 4 else ("c",) if k < 12 else ("c", "d") if k < 16 else ("d",))]
    got = {(r["entity_a"], r["entity_b"]): round(r["score"], 4) for r in entities.npmi(spark.createDataFrame(links, "i int, e string"), "i", "e").collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0}


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([("1", "red fox red"), ("2", "blue fox"), ("3", "grey goose flew"), ("4", None)], "id string, content string")
    got = {r["id"]: r["score"] for r in lexical.bm25(docs, {"content": 1.0}, lexical.phrases_of("q", "red", prefixes=False)).collect()}
    idf, mean = math.log((4 - 1 + 0.5) / 1.5), 8 / 4
    assert got == {"1": pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), abs=1e-8)}
    phrase = lexical.bm25(docs, {"content": 1.0}, lexical.phrases_of("q", "fox-re", prefixes=True)).collect()
    assert [r["id"] for r in phrase] == ["1"]
    assert lexical.bm25(docs.limit(0), {"content": 1.0}, lexical.phrases_of("q", "red")).count() == 0


def test_common_term_scores_next_to_nothing(spark):
    docs = spark.createDataFrame([(str(k), "word") for k in range(5)], "id string, content string")
    assert all(0 < r["score"] < 1e-5 for r in lexical.bm25(docs, {"content": 1.0}, lexical.phrases_of("q", "word")).collect())


def test_knn_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(120)] + [(500, None), (501, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector.knn(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, 4).collect()}
    for q in range(0, 120, 20):
        order = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], x)) ** 0.5, 6), k) for k, x in rows[:120])
        assert [got[(q, n)] for n in range(1, 6)] == [k for _, k in order[:5]]


def test_fusion_ties_floor_and_time(spark):
    lane = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    fused = fusion.rrf([fusion.lane(lane, "x", "item", "fts"), fusion.lane(lane, "y", "item", "vector", 0.5)])
    got = {r["id"]: r["score"] for r in fused.collect()}
    assert got["a"] == pytest.approx(1.5 / 31 * 1.05, abs=1e-8)
    rows = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 1.0, 1), ("q", "c", 2.0, 2)], "query_id string, id string, score double, at int")
    assert {r["id"] for r in fusion.relevance_floor(rows, 0.6).collect()} == {"a", "c"}
    for newest, want in ((True, "cab"), (False, "abc")):
        assert "".join(r["id"] for r in fusion.time_order(rows, "at", newest).orderBy("place").collect()) == want


def test_hybrid_filters_and_blank_text(spark):
    items = _items(spark, [{"content": "the parser broke"}, {"content": "the parser works", "source": "email"}, {"content": "lunch"}])
    cfg = HybridConfig(source_filter=["email"], recency_lane_days=7)
    assert [r["id"] for r in hybrid(items, {"q": "parser"}, cfg).collect()] == ["1"]
    assert [r["id"] for r in hybrid(items, {"q": "parser"}, HybridConfig(sort="desc")).orderBy("place").collect()] == ["1", "0"]


def test_signals(spark):
    f = spark.createDataFrame([(1, "q1", "noise", None), (2, "q1", "bad_result", "d"), (3, "q2", "deferred", "d"), (4, "q2", "correction", "d"), (5, "q1", "bad_result", "d")], "id long, query_id string, kind string, result_id string")
    r = spark.createDataFrame([("q1", "d", True, 1, "s"), ("q2", "d", True, 1, "s"), ("q2", "e", False, 2, "s")], "query_id string, result_id string, cited boolean, rank int, source string")
    assert {x["query_id"]: x["kind"] for x in signals.latest_verdicts(f).collect()} == {"q1": "bad_result", "q2": "correction"}
    assert [tuple(x) for x in signals.boost_counts(r, f).collect()] == [("d", 2)]


def test_measures(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0.1, 0.2, 0.25, 0.9]), rng.random() < 0.4) for k in range(200)]
    s = spark.createDataFrame(rows, "id int, score double, label boolean")
    pos, neg = [x for _, x, y in rows if y], [x for _, x, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluate.auc(s).first()["auc"] == pytest.approx(want)
    assert evaluate.auc(s.limit(0)).first()["auc"] is None
    assert evaluate.stratified_sample(s, "label", "id", 5, "x").count() == 10
    gain = evaluate.bootstrap_gain(s.select("id", F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), 20).first()
    assert gain["mean_gain"] == pytest.approx(1) and gain["p10"] == pytest.approx(1)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.language(F.lit("Jeg har det og vi")).alias("no"), text.language(F.lit("short")).alias("short"), text.language(F.lit(None).cast("string")).alias("none"), text.redact(F.lit('Bearer abc {"secret": "x"}')).alias("redact"),
        text.html_to_text(F.lit("<style>x</style><p>a &amp; b</p>c<br>d")).alias("html"), text.slug(F.lit("Hello, World 2!")).alias("slug"), text.phone(F.lit("22 33 44 55")).alias("phone"), text.phone(F.lit("12")).alias("nophone"),
        text.merge_key(F.lit("Acme, Ltd.")).alias("key"), text.citations(F.lit("a [2] b [1] [2] [9]"), F.lit(3)).alias("cites"), text.elapsed(F.lit(7200)).alias("ago"), text.without_private(F.lit("a<private>x\ny</private>b")).alias("open"),
        F.array_join(text.junk_reasons(F.lit("x")), ",").alias("junk"), text.identity_key(F.lit(" +47 (22) 33-44 ")).alias("ident"),
    ).first()
    assert row.asDict() == {"no": "no", "short": None, "none": None, "redact": 'Bearer <redacted> {"secret":"<redacted>"}', "html": "a & b\nc\nd", "slug": "hello_world_2", "phone": "+4722334455", "nophone": None, "key": "acme", "cites": [2, 1], "ago": "~2h", "open": "ab", "junk": "all-lowercase,very-short", "ident": "+47223344"}


def test_abbreviations(spark):
    docs = spark.createDataFrame([("1", "s", T0, "Use the Service Provider (SP) or UDI = immigration office i Oslo."), ("2", "s", T0, None), ("3", "s", T0, "An apple (ZQ).")], "id string, source string, timestamp timestamp, text string")
    got = {(r["short_form"], r["long_form"]) for r in abbreviations.mine(docs).collect()}
    assert ("UDI", "immigration office") in got and not any(s == "ZQ" for s, _ in got) and any(s == "SP" and long.endswith("Service Provider") for s, long in got)


def test_store(spark):
    cols = "id string, content string, ingested_at timestamp, junk_reason string"
    old = spark.createDataFrame([("1", "a", T0, "j"), ("2", "b", T0, None)], cols)
    new = spark.createDataFrame([("1", "a2", T0 + timedelta(1), None), ("3", "c", T0, None), ("3", "c2", T0 + timedelta(1), None)], cols)
    got = {r["id"]: (r["content"], r["ingested_at"].day, r["junk_reason"]) for r in store.upsert(old, new).collect()}
    assert got == {"1": ("a2", 1, "j"), "2": ("b", 1, None), "3": ("c2", 2, None)}
    assert store.upsert(old.limit(0), new.limit(0)).count() == 0
    keys = spark.createDataFrame([("a_b_c",), ("x",)], "key string")
    assert [tuple(r) for r in store.longest_prefix(keys, spark.createDataFrame([("a", "1"), ("a_b", "2")], "prefix string, note string")).collect()] == [("a_b_c", "2")]
