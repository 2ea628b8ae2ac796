import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from emberlake.operators import consolidate, sessions

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
SCHEMA = "id string, source string, source_id string, thread_id string, timestamp timestamp, ingested_at timestamp, sender string, content string, value string"


def _items(spark, rows):
    return spark.createDataFrame([(i, s, f"{s}:{i}", t, at, T0, "a", "x", "clash") for i, s, t, at in rows], SCHEMA)


def _config(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, gap_minutes int")


def test_gap_bounds_nulls_and_second_deliveries(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    items = _items(spark, [("1", "a", "t", at(0)), ("2", "a", "t", at(240)), ("3", "a", "t", at(480.02)), ("3", "a", "t", at(480.02)), ("4", "a", None, at(0)), ("5", "a", "", at(1)), ("6", "b", "t", at(0)), ("7", "a", "t", None)])
    got = {tuple(r) for r in sessions.sessionize_items(items, _config(spark, ("a", 240), ("a", None), ("c", 5))).select("thread_key", "n_items").collect()}
    assert got == {("t", 2), ("t", 1), ("", 2)}


def test_matches_plain_loop_over_block_bounds(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([0, 1, 5, 29, 30, 31, 200, 900])
        rows.append((str(k), "a", rng.choice(["t", "u"]), T0 + timedelta(minutes=at)))
    got = sorted(tuple(r) for r in sessions.sessionize_items(_items(spark, rows), _config(spark, ("a", 30)), block_us=3_600_000_000).select("thread_key", "start_us", "end_us", "n_items").collect())
    want = []
    for thread in ("t", "u"):
        times = sorted(int(r[3].timestamp() * 1e6) for r in rows if r[2] == thread)
        part = [times[0]]
        for x in times[1:]:
            if x - part[-1] > 30 * 60_000_000:
                want.append((thread, part[0], part[-1], len(part)))
                part = []
            part.append(x)
        want.append((thread, part[0], part[-1], len(part)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert sessions.sessionize_items(_items(spark, []), _config(spark, ("a", 30))).count() == 0


def test_cap_and_summary(spark):
    items = _items(spark, [(f"{k:02}", "a", "t", T0 + timedelta(minutes=k)) for k in range(7)])
    members = consolidate.capped_sessions(items, 240, 4)
    c = consolidate.consolidations(members, 3).orderBy("session_no").collect()
    assert [r["item_count"] for r in c] == [4, 3] and c[0]["participants"] == ["a"]
    text = consolidate.summaries(members, 3, 80).orderBy("session_no").collect()[0]["summary"]
    assert text.startswith("a session 2026-03-01 with a:") and text.endswith("... and 2 more messages"), text
    assert consolidate.overlapping(consolidate.consolidations(members), 0, 1).count() == 0


def test_folded_turns_treat_nulls_as_one_sender(spark):
    items = _items(spark, [(str(k), "a", "t", T0 + timedelta(minutes=k)) for k in range(4)]).withColumn("sender", F.when(F.col("id") >= "2", None).otherwise("x"))
    assert [r["n"] for r in consolidate.folded_turns(items).orderBy("turn_no").collect()] == [2, 2]
