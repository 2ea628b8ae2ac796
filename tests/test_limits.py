from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlake.operators import entities, lexical, upkeep
from emberlake.plans.retrieve import HybridConfig, hybrid, hydrated, passing

T0 = datetime(2026, 4, 1, tzinfo=timezone.utc)
ENTITY = "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int"
ITEM = "id string, source string, thread_id string, timestamp timestamp, sender string, content string, subject string, junk_reason string, lang string, timestamp_inferred boolean, raw_metadata string, consolidated_into string"


def test_names_of_many_tokens_are_tagged(spark):
    long = "The Old and Very Long Harbour Logistics G.m.b.H. of Bergen"
    e = spark.createDataFrame([(1, long, "organization", None, 0), (2, "Harbour Logistics", "organization", [], 0), (3, "", "x", ["", None], 0)], ENTITY)
    docs = spark.createDataFrame([("a", f"{long.lower()} and harbour logistics"), ("b", None)], "id string, text string")
    assert {(r["id"], r["entity_id"], r["n"]) for r in entities.dictionary_tags(docs, e).collect()} == {("a", 1, 1), ("a", 2, 1)}
    assert entities.dictionary_tags(docs.limit(0), e).count() == 0 and entities.dictionary_tags(docs, e.limit(0)).count() == 0


def test_stored_index_equals_the_search(spark, tmp_path):
    docs = spark.createDataFrame([(str(k), f"word{k % 7} common label-printer{k % 3}", None if k % 2 else "common title") for k in range(60)], "id string, content string, subject string")
    weights = {"content": 1.0, "subject": 2.0}
    phrases = [p for q, t in {"a": "word3 common", "b": "label-printer", "c": "titles zebra", "d": ""}.items() for p in lexical.phrases_of(q, t)]
    lexical.write_index(docs, list(weights), str(tmp_path / "index"), 4, 2)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    assert rows(lexical.stored_bm25(spark, str(tmp_path / "index"), weights, phrases)) == rows(lexical.bm25(docs, weights, phrases)) != []
    as_table = lexical.phrase_table(spark, phrases)
    assert rows(lexical.bm25(docs, weights, as_table)) == rows(lexical.bm25(docs, weights, phrases))


def _items(spark, n=6):
    rows = [(str(k), ("email", "signal", "tier2_ledger")[k % 3], "t", T0.replace(day=1 + k), ("bo", "mei")[k % 2], "parser words", None, None, "en", False, '{"repo": "a/b"}' if k < 2 else None, "s" if k == 5 else None) for k in range(n)]
    return spark.createDataFrame(rows, ITEM)


def test_filters_and_weights_of_the_plan(spark):
    items = _items(spark)
    ids = lambda cfg, s=None: sorted(r["id"] for r in passing(items, cfg, s).collect())
    assert ids(HybridConfig(repo_filter=["a/b"])) == ["0", "1"] and ids(HybridConfig(source_filter=["email"])) == ["0", "3"]
    assert ids(HybridConfig(exclude_ids=items.where("id = '0'"))) == ["1", "2", "3", "4", "5"] and ids(HybridConfig(allowed=items.where("id < '2'"))) == ["0", "1"]
    assert ids(HybridConfig(), items) == ["0", "1", "2", "3", "4"]
    run = lambda **k: [r["id"] for r in hybrid(items, {"q": "parser"}, HybridConfig(**k)).orderBy("place").collect()]
    assert run(tier_boost=1.6)[0] == "2" and "2" not in run(raw_only=True) and run(sender_filter=["mei"]) == ["1", "3", "5"]
    assert run(links_boost=items.where("id = '4'").select("id"))[0] == "4"
    assert run(associations=items.where("id IN ('0', '1')").select("id", F.lit(0.9).alias("weight")))[-2:] == ["0", "1"]
    assert run(sort="asc") == ["0", "1", "2", "3", "4", "5"] and run(sort="desc", top_k=2) == ["5", "4"]
    assert [r["id"] for r in hybrid(items, {"q": "nothing"}, HybridConfig(since="2026-04-03", until="2026-04-05")).orderBy("place").collect()] == ["2", "3", "4"]
    shown = hydrated(hybrid(items, {"q": "parser"}, HybridConfig(top_k=1)), items).first()
    assert (shown["sender"], shown["preview"]) == ("bo", "parser words")


def test_answers_in_sections(spark):
    texts = ["ANSWER: It is so [1].\nCONFIDENCE: high (two mails say it)\nGAPS:\n- when\n* who\n", "plain words", None, "**Answer:** a\n\nGaps: none\nConfidence: Low - old"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [tuple(r)[1:] for r in df.select("k", *upkeep.answer_parts(F.col("t"))).orderBy("k").collect()]
    assert got[0] == ("It is so [1].", "high", "two mails say it", ["when", "who"])
    assert got[1] == ("plain words", "unknown", "", []) and got[2] == ("", "unknown", "", [])
    assert got[3][0] == "a" and got[3][1] == "low" and got[3][3] == []


def test_batches_and_thresholds(spark):
    rows = spark.createDataFrame([(k, "x" * (90 if k == 3 else 12)) for k in range(8)], "id int, t string").coalesce(1)
    got = [r["batch"] for r in upkeep.bounded_batches(rows, "t", 3, 20).orderBy("id").collect()]
    assert got == ["0-0", "0-0", "0-0", "0-1", "0-2", "0-2", "0-2", "0-3"]
    scores = spark.createDataFrame([(k, k / 100, False) for k in range(100)] + [(200, 0.9, True)], "id int, score double, label boolean")
    assert 0.75 <= upkeep.median_threshold(scores, 0.8).first()["threshold"] <= 0.85
    assert upkeep.median_threshold(scores.limit(0), 0.8).first()["threshold"] == 0.5


def test_synonyms_merge_from_one_entity_to_the_next(spark):
    e = spark.createDataFrame([(1, "Budget", "x", ["plan"], 0), (2, "PLAN", "x", ["outline"], 0), (3, "Outline", "x", ["the draft"], 1), (4, "outline", "x", ["gone"], 2), (5, "alone", "x", None, 0)], ENTITY)
    got = {r["word"]: r["spellings"] for r in lexical.merged_synonyms(e).collect()}
    assert got == {w: ["budget", "outline", "plan", "the draft"] for w in ("budget", "plan", "outline")}
    assert lexical.merged_synonyms(e.limit(0)).count() == 0
