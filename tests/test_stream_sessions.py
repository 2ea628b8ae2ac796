from datetime import datetime, timedelta, timezone

from emberlake.streaming import sessions
from emberlake.streaming.ingest import read_stream

T0 = datetime(2026, 4, 1, tzinfo=timezone.utc)
ITEM = "id string, source string, thread_id string, timestamp timestamp, extra string"


def _run(spark, tmp_path, batches, lateness_minutes=10_000):
    for rows in batches:
        spark.createDataFrame([(i, s, t, None if m is None else T0 + timedelta(minutes=m), "x") for i, s, t, m in rows], ITEM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    gaps = spark.createDataFrame([("a", 10 * 60_000_000), ("b", 60_000_000)], "source string, gap_us long")
    sessions.session_state(read_stream(spark, f"{tmp_path}/in", 1), gaps, f"{tmp_path}/state", f"{tmp_path}/checkpoint", lateness_minutes * 60_000_000).awaitTermination()
    us = lambda x: int((x / 60_000_000) - T0.timestamp() / 60)
    return sorted((r["source"], r["thread_key"], us(r["start_us"]), us(r["end_us"]), r["n_items"]) for r in sessions.sessions_at(spark, f"{tmp_path}/state").collect())


def test_late_events_bridge_and_ids_count_once(spark, tmp_path):
    got = _run(spark, tmp_path, [
        [("1", "a", "t", 0), ("2", "a", "t", 10), ("3", "a", "t", 30), ("4", "b", "t", 0), ("5", "b", "t", 2), ("6", "c", "t", 0), ("7", "a", "t", None)],
        [("1", "a", "t", 0), ("8", "a", "t", 20), ("9", "a", None, 500)],
        [("10", "a", "t", -5), ("11", "b", "t", 1)],
    ])
    assert got == [("a", "", 500, 500, 1), ("a", "t", -5, 30, 5), ("b", "t", 0, 2, 3)]


def test_what_comes_behind_the_watermark_is_kept_apart(spark, tmp_path):
    got = _run(spark, tmp_path, [[("1", "a", "t", 0)], [("2", "a", "t", 1000)], [("3", "a", "t", 5), ("4", "a", "t", 1005)]], lateness_minutes=100)
    assert got == [("a", "t", 0, 0, 1), ("a", "t", 1000, 1005, 2)]
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/state/late").collect()] == ["3"]
    assert spark.read.parquet(f"{tmp_path}/state/closed").count() == 1
