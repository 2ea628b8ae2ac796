import hashlib

from pyspark.sql import functions as F

from emberlake.operators import lexical
from emberlake.plans.retrieve import HybridConfig, hybrid
from emberlake.queries import corpus, retrieval


def _corpus(spark, folder, n=60):
    docs = [(k, f"words of number{k} here", f"number{k}" if k != 40 else None, "a") for k in range(1, n + 1)]
    spark.createDataFrame(docs, "doc_id long, text string, subject string, author string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(k, [float(k)] + [1.0] * 63) for k in range(n + 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def test_phrases_as_a_table_equal_the_list(spark):
    texts = {"a": 'The label-printer "broke" the printer', "b": "", "c": "-- a_b Onsdag"}
    want = lexical.phrase_table(spark, [p for q, t in texts.items() for p in lexical.phrases_of(q, t)])
    got = lexical.phrases_from(spark.createDataFrame([*texts.items(), ("d", None)], "query_id string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_fused_queries_grow_with_the_vectors(spark, tmp_path):
    _corpus(spark, tmp_path)
    rows = retrieval.rrf_fuse(spark, str(tmp_path))
    assert {r["query_id"] for r in rows.select("query_id").distinct().collect()} == {"q0", "q20", "q40", "q60"}
    top = {r["query_id"]: r["id"] for r in rows.where("rank = 1").collect()}
    assert top == {"q0": 0, "q20": 20, "q40": 40, "q60": 60}
    agree = {(r["query_id"], r["id"], r["fts_rank"], r["vector_rank"]) for r in retrieval.rank_agreement(spark, str(tmp_path)).collect()}
    assert agree == {("q20", 20, 0, 0), ("q60", 60, 0, 0)}  # document 40 has no subject, vector 0 no document
    assert retrieval.relevance_floor(spark, str(tmp_path)).where(F.col("query_id") == "q60").count() == 1


def test_all_documents_are_stripped_and_redacted(spark, tmp_path):
    token = "eyJ" + ".".join(["abcdefghijk"] * 3)
    texts = ["plain", "odd\u00a0blank \u2192 \U0001f600", "[label](http://x.y) <b>bold", '{"body": "secret words"}', f"got {token} back", '"text":"x" Bearer abc', None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda t: t if t is None else hashlib.md5(t.encode()).hexdigest()
    stripped = [texts[0], "odd blank    ", "label  bold", *texts[3:]]
    assert {r["doc_id"]: r["digest"] for r in corpus.strip_markup(spark, str(tmp_path)).collect()} == {k: md5(t) for k, t in enumerate(stripped)}
    redacted = [*texts[:3], '{"body":"<redacted>"}', "got <redacted-jwt> back", '"text":"<redacted>" Bearer <redacted>', None]
    assert {r["doc_id"]: r["digest"] for r in corpus.redact(spark, str(tmp_path)).collect()} == {k: md5(t) for k, t in enumerate(redacted)}


def test_rare_words_reach_past_the_depth_of_an_index(spark):
    cols = "id string, source string, thread_id string, timestamp timestamp, sender string, content string, subject string, junk_reason string, lang string, timestamp_inferred boolean"
    long = "zebra " + "filler " * 60
    rows = [(str(k), "s", None, None, "a", "common words" if k < 4 else long if k == 4 else "nothing here", None, None, "en", False) for k in range(30)]
    items = spark.createDataFrame(rows, cols)
    cut = HybridConfig(per_index_k=1)
    texts = {"q": "common words zebra", "one": "zebra"}
    found = lambda cfg, t: {(r["query_id"], r["id"]): r["score"] for r in hybrid(items, t, cfg).collect()}
    plain, rare = found(cut, texts), found(HybridConfig(per_index_k=1, rare_term_df=1, rare_term_weight=2.0), texts)
    assert ("q", "4") not in plain and rare["q", "4"] > rare["q", "0"] and plain["one", "4"] == rare["one", "4"]
    table = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    assert found(HybridConfig(per_index_k=1, rare_term_df=1, rare_term_weight=2.0), table) == rare
