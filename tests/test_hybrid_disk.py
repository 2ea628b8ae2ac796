import os

from pyspark.sql import functions as F

from emberlake import session
from emberlake.operators import lexical
from emberlake.plans import retrieve


def test_a_word_of_many_queries_is_looked_for_once(spark, monkeypatch):
    cols = "id string, source string, thread_id string, timestamp timestamp, sender string, content string, subject string"
    items = spark.createDataFrame([(f"{k:03}", "s", None, None, "a", "granite quarry " + "filler " * (k % 7) + ("granite-mill" if k % 3 else ""), None) for k in range(100)], cols)
    texts = spark.createDataFrame([(f"q{k}", f"granite quarry granite-mill w{k}") for k in range(40)], "query_id string, text string")
    rows, real = {}, session.stage

    def counted(df, name, *args, **kwargs):
        out = real(df, name, *args, **kwargs)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    for module in (retrieve, lexical):
        monkeypatch.setattr(module, "stage", counted)
    cfg = retrieve.HybridConfig(top_k=3, per_index_k=3, recency_lane_days=0)
    got = {(r["query_id"], r["place"]): r["id"] for r in retrieve.hybrid(items, texts, cfg).collect()}
    assert max(rows.values()) <= 300, rows  # not 40 queries times 100 items
    want = lexical.top_k(lexical.bm25(items, retrieve.ITEM_WEIGHTS, lexical.phrases_from(texts)), 3)
    assert got == {(r["query_id"], r["rank"]): r["id"] for r in want.collect()} and len(got) == 120


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files_and_can_be_undone(spark):
    before = _shuffle_files(spark)
    rows = session.stage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "swept", sweep=True)
    assert not _shuffle_files(spark) - before and rows.count() == 7 and spark.conf.get(session.SWEEP) == "false"
    folder = rows.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    session.unstage(rows)
    assert not os.path.exists(folder)
