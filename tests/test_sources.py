import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from emberlake.sources import readers, store
from emberlake.streaming import ingest

T0 = datetime(2026, 4, 1, 12, tzinfo=timezone.utc)


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Bo <bo@example.test>\nTo: me@example.test\nSubject: Hi\nMessage-ID: <1@x>\nDate: Wed, 1 Apr 2026 10:00:00 +0200\nContent-Type: text/html\n\n<p>Hello<br>there</p>")
    (tmp_path / "b.eml").write_bytes(b"From: x@example.test\nList-Id: news\nMessage-ID: <2@x>\n\nNews")
    (tmp_path / "c.eml").write_bytes(b"From: no-reply@example.test\nMessage-ID: <3@x>\n\nAutomatic")
    got = readers.mail_files(spark, str(tmp_path)).collect()
    assert [(r["sender"], r["content"], r["timestamp"].astimezone(timezone.utc).hour, r["recipients"]) for r in got] == [("bo@example.test", "Hello\nthere", 8, ["me@example.test"])]


def test_notes_and_facts(spark, tmp_path):
    (tmp_path / "2026-03-04 plan.md").write_text("# The plan\nSee [[x|the link]].\n\n## Insights / Facts\n- a fact that is long enough\n  and goes on\n- short\n\n## Next\n- not a fact at all, really not\n")
    (tmp_path / "b.md").write_text("---\ntitle: B\ncreated: 2026-01-02\n---\ntext")
    got = {r["subject"]: r for r in readers.notes(spark, str(tmp_path)).collect()}
    assert got["The plan"]["timestamp_inferred"] and got["The plan"]["timestamp"].day == 4 and "See the link." in got["The plan"]["content"]
    assert not got["B"]["timestamp_inferred"]
    assert [r["content"] for r in readers.facts(spark, str(tmp_path)).collect()] == ["a fact that is long enough and goes on"]


def test_json_sources(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    e = readers.activity_events(spark, put("e.json", [{"id": "1", "type": "PushEvent", "repo": {"name": "o/r"}, "payload": {"ref": "main", "commits": [{"message": "m1"}]}, "created_at": "2026-01-01T00:00:00Z"}, {"id": "2", "type": "OddEvent"}])).collect()
    assert {r["content"] for r in e} == {"pushed to main: m1", "OddEvent on "}
    w = readers.work_items(spark, put("w.json", [{"id": 7, "rev": 2, "fields": {"System.Title": "T", "System.WorkItemType": "Bug", "System.Description": "<p>d</p>"}}])).first()
    assert w["source_id"] == "7:2" and w["content"] == "[Bug] T\nd"
    c = readers.calendar(spark, put("c.json", [{"id": "1", "subject": "s", "showAs": "Free"}, {"id": "2", "subject": "s", "showAs": "busy"}]))
    assert [r["source_id"] for r in c.collect()] == ["2"]
    t = readers.team_messages(spark, put("t.json", [{"id": "1", "messageType": "message", "from": {"user": {"displayName": "Bo"}}, "body": {"content": "<div>hi</div>"}}, {"id": "2", "messageType": "systemEventMessage"}]))
    assert [r["content"] for r in t.collect()] == ["hi"]
    n = readers.ledger(spark, put("l.json", [{"notes": {"k": {"title": "t", "statement": "S.", "body": "S. more", "updated": "2026-01-01"}}}]))
    assert n.first()["content"] == "S. more"


def test_chat_exports(spark):
    m = spark.createDataFrame([("g1", "hi", 700000000, 0, 1, 1, 0), ("g2", "Liked", 700000000, 0, 1, 1, 2001), ("g3", "yo", 700000000 * 10**9, 1, None, 1, None)], "guid string, text string, date long, is_from_me int, handle_id int, chat_id int, associated_message_type int")
    h = spark.createDataFrame([(1, "+4711")], "id int, address string")
    c = spark.createDataFrame([(1, "chat1", None)], "id int, identifier string, name string")
    got = {r["source_id"]: (r["sender"], r["timestamp"]) for r in readers.chat_export(m, h, c).collect()}
    assert got["g1"][0] == "+4711" and got["g3"][0] == "me" and got["g1"][1] == got["g3"][1] and "g2" not in got
    s = spark.createDataFrame([("1", "c", "incoming", 1, "x", "b", '{"attachments":[{"fileName":"f.png"}]}'), ("2", "c", "keychange", 1, "x", "b", None)], "id string, conversationId string, type string, sent_at long, source string, body string, json string")
    got = readers.signal_export(s, spark.createDataFrame([("c", "n", "e")], "id string, name string, e164 string")).collect()
    assert {r["source_id"] for r in got} == {"1", "1#0"}


def test_stream_appends_each_id_once(spark, tmp_path):
    rows = [(str(k % 7), "s", T0 + timedelta(minutes=k)) for k in range(20)]
    for n in range(4):
        spark.createDataFrame(rows[n * 5 : n * 5 + 5], "id string, source string, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.append_new(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/items")).count() == 7
    marks = spark.read.parquet(str(tmp_path / "out/marks")).agg(F.max("last_us")).first()[0]
    assert marks == int((T0 + timedelta(minutes=19)).timestamp() * 1e6)


def test_session_stream(spark, tmp_path):
    rows = [("u", T0 + timedelta(minutes=m)) for m in (0, 5, 9, 60)] + [("v", T0 + timedelta(days=1))]
    spark.createDataFrame(rows, "user string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.session_stream(ingest.read_stream(spark, str(tmp_path / "in")), "user", "at", "10 minutes", "5 minutes")
    q = s.writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user"], r["n_items"]) for r in spark.table("sess").collect()}
    assert ("u", 3) in got and ("u", 1) in got


def test_late_and_runs(spark):
    items = spark.createDataFrame([("1", "s", T0), ("1", "s", T0), ("2", "s", T0 + timedelta(1))], "id string, source string, timestamp timestamp")
    marks = store.advance(spark.createDataFrame([("s", 5)], "source string, last_us long"), items)
    assert store.late(items, marks).select("id").distinct().count() == 1
    assert store.run_rows(items, items.where("id = '2'").select("id")).first().asDict() == {"source": "s", "seen": 3, "new": 1, "skipped": 2}
