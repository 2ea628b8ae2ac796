import json

from emberlake.sources import readers


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_mail_listing_and_delimited_records(spark, tmp_path):
    who = lambda a: {"emailAddress": {"address": a}}
    path = _lines(tmp_path / "m.json", [
        {"id": "1", "conversationId": "c", "subject": "s", "from": who("a@x.no"), "toRecipients": [who("b@x.no"), who(None)], "receivedDateTime": "2026-04-01T10:00:00Z", "body": {"contentType": "html", "content": "<p>Hi</p>there"}},
        {"id": "2", "from": who("no-reply@x.no"), "body": {"contentType": "text", "content": "x"}}, {"id": "3", "from": who("a@x.no"), "internetMessageHeaders": [{"name": "List-Id", "value": "l"}]}, {"id": None},
    ])
    rows = readers.mail_listing(spark, path).collect()
    assert [(r["source_id"], r["recipients"], r["content"], r["thread_id"]) for r in rows] == [("1", ["b@x.no"], "Hi\nthere", "c")]
    (tmp_path / "r.txt").write_text("1\x1f2026-04-01 10:00:00\x1fa; b\x1ftext\x1e2\x1fnever\x1f\x1f\x1e3\x1fshort\x1e\x1f\x1f\x1f")
    got = {r["source_id"]: (r["timestamp"] is not None, r["recipients"], r["content"]) for r in readers.delimited_records(spark, str(tmp_path / "r.txt"), ["source_id", "timestamp", "recipients", "content"], "app").collect()}
    assert got == {"1": (True, ["a", "b"], "text"), "2": (False, [], None)}


def test_chats_and_channels(spark, tmp_path):
    path = _lines(tmp_path / "c.json", [{"id": "t", "topic": None, "members": [{"id": "1", "name": "me"}, {"id": "2", "name": "Bo"}], "messages": [{"id": "a", "type": "Text", "from": "2", "composeTime": "2026-04-01T10:00:00Z", "content": "hello"}, {"id": "b", "type": "Event", "from": "2", "content": "x"}, {"id": "c", "type": "Text", "from": "9", "content": ""}]}, {"id": "u", "messages": None}])
    assert [(r["source_id"], r["sender"], r["recipients"], r["subject"]) for r in readers.chat_service(spark, path).collect()] == [("t:a", "Bo", ["me"], "Bo")]
    user = lambda n: {"user": {"displayName": n}}
    path = _lines(tmp_path / "p.json", [{"id": "p", "team": "T", "channel": "C", "from": user("Bo"), "createdDateTime": "2026-04-01T10:00:00Z", "body": {"content": "post"}, "replies": [{"id": "r", "from": user("Mei"), "body": {"content": "<b>reply</b>"}}, {"id": "s", "from": user("Build Bot"), "body": {"content": "x"}}]}, {"id": "q", "from": None, "body": {"content": "x"}, "replies": None}])
    assert sorted((r["source_id"], r["sender"], r["content"], r["thread_id"], r["subject"]) for r in readers.channels(spark, path).collect()) == [("p:p", "Bo", "post", "T:C:p", "T / C"), ("p:r", "Mei", "reply", "T:C:p", "T / C")]


def test_memory_sections_and_people(spark, tmp_path):
    home = tmp_path / "repo1" / "memory"
    home.mkdir(parents=True)
    (home / "MEMORY.md").write_text("---\na: b\n---\n# First heading\nsome words that are enough\n## Second\nx\n## Third one\nmore words that are enough")
    rows = readers.memory_files(spark, str(tmp_path)).collect()
    assert sorted((r["subject"], json.loads(r["raw_metadata"])["repo"], r["timestamp_inferred"]) for r in rows) == [("First heading", "repo1", True), ("Third one", "repo1", True)]
    records = spark.createDataFrame([(1, "Bo", "Berg", None), (2, None, "", "Firm"), (3, None, None, None), (4, "Bo", "Berg", "x")], "id long, first string, last string, organisation string")
    phones = spark.createDataFrame([(1, "900 12 345"), (2, "junk"), (9, "90012345")], "owner long, number string")
    mails = spark.createDataFrame([(1, " BO@x.no"), (4, "b@y.no"), (2, None)], "owner long, address string")
    assert sorted((r["canonical"], r["aliases"]) for r in readers.address_book(records, phones, mails).collect()) == [("Bo Berg", ["+4790012345", "b@y.no", "bo@x.no"]), ("Firm", [])]
    path = _lines(tmp_path / "d.json", [{"displayName": "Mei Li", "mail": "MEI@x.no", "userPrincipalName": "mei@x.no", "mobilePhone": "+47 900 12 345"}, {"displayName": " "}, {"mail": "z@x.no"}])
    assert [tuple(r) for r in readers.directory(spark, path).collect()] == [("Mei Li", ["+4790012345", "mei@x.no"])]


def test_mailboxes_are_split_and_lengths_kept(spark, tmp_path):
    mail = lambda n, body, head="": f"From: Bo <bo@x.no>\nTo: me@x.no\nMessage-ID: <{n}@x>\nDate: Wed, 1 Apr 2026 10:00:0{n} +0000\n{head}Subject: s\n\n{body}\n".encode("latin-1")
    (tmp_path / "box.mbox").write_bytes(b"".join(b"From bo@x.no Wed Apr  1 10:00:00 2026\n" + m + b"\n" for m in [mail(1, "one\n>From here on"), mail(2, "blåbær", "Content-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: 8bit\n"), b"Subject: undated\n\nx", mail(3, "auto", "Auto-Submitted: auto-replied\n")]))
    (tmp_path / "empty.mbox").write_bytes(b"")
    got = {r["source_id"]: r["content"].strip() for r in readers.mail_files(spark, str(tmp_path), "*.mbox", framing="mbox").collect()}
    assert got == {"<1@x>": "one\n>From here on", "<2@x>": "blåbær"}
    m = mail(4, "four")
    (tmp_path / "a.emlx").write_bytes(f"{len(m)}   \n".encode() + m + b"<?xml version='1.0'?><plist/>")
    (tmp_path / "b.emlx").write_bytes(b"no number\n" + m)
    (tmp_path / "c.emlx").write_bytes(b"")
    assert [(r["source_id"], r["content"].strip()) for r in readers.mail_files(spark, str(tmp_path), "*.emlx", framing="emlx").collect()] == [("<4@x>", "four")]


def test_reactions_close_their_message(spark):
    rows = [
        ("1", "c", "incoming", 1, "x", " hi ", '{"reactions":[{"emoji":"+1","from":"d"},{"emoji":"!","fromId":"s9"},{"fromName":"Mei"},{"emoji":"?"}]}'),
        ("2", "c", "outgoing", 2, None, None, '{"attachments":[{"fileName":"f.png"},{}]}'), ("3", "c", "incoming", 3, "x", " ", '{"reactions":[{"emoji":"+1","from":"d"}]}'),
        ("4", "c", "incoming", 4, "x", None, '{"attachments":[{"fileName":"g.png"}],"reactions":[{"emoji":"+1","from":"zz"}]}'), ("5", None, "incoming", 5, None, "b", "no json"),
    ]
    s = spark.createDataFrame(rows, "id string, conversationId string, type string, sent_at long, source string, body string, json string")
    c = spark.createDataFrame([("c", "Group", None, None), ("d", "Dag", None, None), ("e", "Eli", None, "s9"), ("f", None, None, None)], "id string, name string, e164 string, serviceId string")
    got = {r["source_id"]: r["content"] for r in readers.signal_export(s, c).collect()}
    assert got == {
        "1": "hi\n\nreactions: +1 from Dag, ! from Eli, from Mei, ? from (unknown)", "2": "Attachments: f.png, (unnamed)", "2#0": "[attachment] f.png",
        "4": "reactions: +1 from zz", "4#0": "[attachment] g.png", "5": "b",
    }
