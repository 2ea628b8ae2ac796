"""Readers that bring source formats into the item schema.

Every reader returns (id, source, source_id, timestamp, sender, recipients, content, subject, thread_id, lang,
raw_metadata, timestamp_inferred). Parsing stays in Spark expressions but for mail, whose MIME structure is read
by small per-file helpers inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions.text import html_to_text, language

ITEM_COLUMNS = ["id", "source", "source_id", "timestamp", "sender", "recipients", "content", "subject", "thread_id", "lang", "raw_metadata", "timestamp_inferred"]
APPLE_EPOCH = 978_307_200
# Local parts of addresses that machines send from.
AUTOMATED = r"(?i)^(?:no[-_]?reply|do[-_]?not[-_]?reply|donotreply|automated|notifications?|invitations?|informer|newsletter|mailer|bouncer?|reply|alerts?|updates?|digest|ikkesvar|noresponse|noresponder|postmaster|mailer-daemon|notify|hello|team|news|announce|automatic|system)@"
# Headers of mail that goes to a list, and how names of machines look.
LIST_HEADERS = ["list-unsubscribe", "list-id", "list-help"]
MACHINE_NAME = r"(?i)\b(?:bot|workflows?|connector|webhook|service account|power automate|notifications?)\b"
DATE_IN_NAME = r"(20\d{2})[-_.]?([01]\d)[-_.]?([0-3]\d)"


def item_id(source: Column, source_id: Column) -> Column:
    return F.sha2(F.concat(source, F.lit(":"), source_id), 256)


def as_items(df: DataFrame, source: str) -> DataFrame:
    """Complete ``df(source_id, timestamp, ...)`` to the item schema; missing columns are null, recipients empty, the language guessed."""
    none = {"sender": "string", "content": "string", "subject": "string", "thread_id": "string", "raw_metadata": "string"}
    for c, t in none.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    if "recipients" not in df.columns:
        df = df.withColumn("recipients", F.array().cast("array<string>"))
    if "lang" not in df.columns:
        df = df.withColumn("lang", language(F.col("content")))
    if "timestamp_inferred" not in df.columns:
        df = df.withColumn("timestamp_inferred", F.lit(False))
    return df.withColumn("source", F.lit(source)).withColumn("id", item_id(F.col("source"), F.col("source_id"))).select(*ITEM_COLUMNS)


def since(items: DataFrame, watermark, floor=None, full: bool = False) -> DataFrame:
    """Items not older than the later of ``watermark`` and the configured ``floor``; a ``full`` run minds only the floor, None reads all."""
    marks = [F.lit(x).cast("timestamp") for x in ([] if full else [watermark]) + [floor] if x is not None]
    return items if not marks else items.where(F.col("timestamp") >= (marks[0] if len(marks) == 1 else F.greatest(*marks)))


def chat_export(messages: DataFrame, handles: DataFrame, chats: DataFrame, source: str = "imessage") -> DataFrame:
    """A chat database's tables: messages(guid, text, date, is_from_me, handle_id, chat_id, associated_message_type), handles(id, address), chats(id, identifier, name).

    Left joins keep messages without handle or chat. Reactions (types 2000 to 3999) and empty texts are left out. Dates
    count from 2001, in seconds or nanoseconds, told apart by size.
    """
    rows = messages.where("NOT coalesce(associated_message_type BETWEEN 2000 AND 3999, false) AND trim(coalesce(text, '')) <> ''")
    rows = rows.join(handles.select(F.col("id").alias("handle_id"), "address"), "handle_id", "left").join(chats.select(F.col("id").alias("chat_id"), "identifier", "name"), "chat_id", "left")
    seconds = F.when(F.abs(F.col("date")) > 10**12, F.col("date") / 1e9).otherwise(F.col("date").cast("double"))
    return as_items(rows.select(
        F.col("guid").alias("source_id"), F.timestamp_micros(((seconds + APPLE_EPOCH) * 1_000_000).cast("long")).alias("timestamp"),
        F.when(F.col("is_from_me") == 1, "me").otherwise(F.col("address")).alias("sender"), F.when(F.col("is_from_me") == 1, F.array(F.coalesce("address", "identifier"))).otherwise(F.array(F.lit("me"))).alias("recipients"),
        F.col("text").alias("content"), F.col("name").alias("subject"), F.col("identifier").alias("thread_id"),
    ), source)


def signal_export(messages: DataFrame, conversations: DataFrame, source: str = "signal") -> DataFrame:
    """A messenger's messages(id, conversationId, type, sent_at, source, body, json) and conversations(id, name, e164, serviceId where kept).

    Reactions named in json are a last line of the message they belong to, from the name of who sent them where a conversation has it. Attachments become items of
    their own, with ``#n`` behind the message's id; a message with nothing else lists them. One without text and attachments is left out.
    """
    own = messages.where("type IN ('incoming', 'outgoing')").join(conversations.select(F.col("id").alias("conversationId"), "name", "e164"), "conversationId", "left")
    form = "attachments array<struct<fileName:string>>, reactions array<struct<emoji:string, `from`:string, fromId:string, fromName:string>>"
    base = own.select("id", F.timestamp_millis("sent_at").alias("timestamp"), F.when(F.col("type") == "outgoing", "me").otherwise(F.coalesce("source", "e164")).alias("sender"), F.col("name").alias("subject"), F.col("conversationId").alias("thread_id"), F.trim(F.coalesce("body", F.lit(""))).alias("body"), F.from_json("json", form).alias("j"))
    keep = ["source_id", "timestamp", "sender", "subject", "thread_id", "content"]
    names = conversations.select(F.col("id").alias("by"), "name")
    if "serviceId" in conversations.columns:
        names = names.unionByName(conversations.select(F.col("serviceId").alias("by"), "name"))
    names = names.where("by IS NOT NULL AND coalesce(name, '') <> ''").groupBy("by").agg(F.min("name").alias("known"))
    given = base.select("id", F.posexplode("j.reactions").alias("n", "r")).where("r IS NOT NULL").withColumn("by", F.coalesce("r.from", "r.fromId")).join(names, "by", "left")
    line = F.trim(F.concat(F.coalesce("r.emoji", F.lit("")), F.lit(" from "), F.coalesce("r.fromName", "known", "by", F.lit("(unknown)"))))
    footer = given.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("l")).select("id", F.concat(F.lit("reactions: "), F.array_join("l.t", ", ")).alias("footer"))
    listed = F.concat(F.lit("Attachments: "), F.array_join(F.transform("j.attachments", lambda x: F.coalesce(x["fileName"], F.lit("(unnamed)"))), ", "))
    held = F.coalesce(F.size("j.attachments") > 0, F.lit(False))
    texts = base.where((F.col("body") != "") | held).join(footer, "id", "left")
    content = F.coalesce(F.nullif(F.concat_ws("\n\n", F.nullif("body", F.lit("")), "footer"), F.lit("")), listed)
    texts = texts.withColumns({"source_id": F.col("id"), "content": content}).select(*keep)
    files = base.select("*", F.posexplode("j.attachments").alias("n", "a")).where("a.fileName IS NOT NULL")
    files = files.withColumns({"source_id": F.concat(F.col("id"), F.lit("#"), F.col("n").cast("string")), "content": F.concat(F.lit("[attachment] "), F.col("a.fileName"))}).select(*keep)
    return as_items(texts.unionByName(files), source)


def _unframed(content: bytes, framing: str) -> bytes | None:
    """The mail inside: without the envelope line in front (mbox), or as many bytes as the first line says (emlx; None where it says no number)."""
    if framing == "file":
        return content
    head, _, rest = content.partition(b"\n")
    if framing == "mbox":
        return rest
    return rest[: int(head)] if head.strip().isdigit() else None


def mail_files(spark: SparkSession, path: str, glob: str = "*.eml", source: str = "email", framing: str = "file") -> DataFrame:
    """RFC 822 mails: newsletters and machines' mail left out, bodies as text, threads by the first reference; mails without a readable date are left out.

    ``framing``: one mail a ``file``, behind its length in a file (``emlx``), or mailboxes (``mbox``), which are split at their envelope lines
    and so read in parts, however long.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy
        from email.utils import getaddresses, parsedate_to_datetime

        for b in batches:
            rows = []
            for content in b["content"]:
                raw = _unframed(content, framing)
                if not raw:
                    continue
                m = message_from_bytes(raw, policy=policy.default)
                if any(m.get(h) for h in ("List-Unsubscribe", "List-Id", "List-Help")) or str(m.get("Precedence", "")).lower() in ("bulk", "list", "junk") or str(m.get("Auto-Submitted", "no")).lower() != "no":
                    continue
                body = m.get_body(("plain", "html"))
                try:
                    at = parsedate_to_datetime(str(m["Date"])).timestamp() * 1_000_000
                except (TypeError, ValueError):
                    continue
                to = [a for _, a in getaddresses([str(x) for h in ("To", "Cc") for x in m.get_all(h, [])]) if a]
                sender = (getaddresses([str(m.get("From", ""))]) or [("", "")])[0][1]
                thread = (str(m.get("References", "")).split() or str(m.get("In-Reply-To", "")).split() or [str(m.get("Message-ID", ""))])[0]
                rows.append((str(m.get("Message-ID", "")).strip(), at, sender, to, str(m.get("Subject", "")), thread, body.get_content() if body else "", bool(body and body.get_content_subtype() == "html")))
            yield pd.DataFrame(rows, columns=["source_id", "us", "sender", "recipients", "subject", "thread_id", "body", "is_html"])

    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if framing == "mbox":
        files = read.option("lineSep", "\nFrom ").text(path).select(F.col("value").cast("binary").alias("content"))
    else:
        files = read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(parse, "source_id string, us double, sender string, recipients array<string>, subject string, thread_id string, body string, is_html boolean")
    rows = rows.where(~F.col("sender").rlike(AUTOMATED))
    return as_items(rows.withColumns({"timestamp": F.timestamp_micros(F.col("us").cast("long")), "content": F.when(F.col("is_html"), html_to_text(F.col("body"))).otherwise(F.col("body"))}), source)


def activity_events(spark: SparkSession, path: str, source: str = "github") -> DataFrame:
    """JSON lines of activity events (id, type, actor.login, repo.name, payload, created_at), rendered by type."""
    schema = "id string, type string, actor struct<login:string>, repo struct<name:string>, created_at string, payload struct<action:string, ref:string, issue:struct<title:string, body:string>, pull_request:struct<title:string, body:string>, comment:struct<body:string>, commits:array<struct<message:string>>>"
    e = spark.read.schema(schema).json(path)
    p = lambda c: F.coalesce(F.col(f"payload.{c}"), F.lit(""))
    text = (
        F.when(F.col("type") == "PushEvent", F.concat(F.lit("pushed to "), p("ref"), F.lit(": "), F.array_join("payload.commits.message", "; ")))
        .when(F.col("type") == "IssuesEvent", F.concat(p("action"), F.lit(" issue: "), p("issue.title"), F.lit("\n"), p("issue.body")))
        .when(F.col("type") == "PullRequestEvent", F.concat(p("action"), F.lit(" pull request: "), p("pull_request.title"), F.lit("\n"), p("pull_request.body")))
        .when(F.col("type").isin("IssueCommentEvent", "CommitCommentEvent", "PullRequestReviewCommentEvent"), F.concat(F.lit("commented: "), p("comment.body")))
        .when(F.col("type").isin("CreateEvent", "DeleteEvent"), F.concat(F.regexp_replace(F.lower("type"), "event", "d "), p("ref")))
        .otherwise(F.concat(F.col("type"), F.lit(" on "), F.coalesce("repo.name", F.lit(""))))
    )
    return as_items(e.where("id IS NOT NULL").select(F.col("id").alias("source_id"), F.col("created_at").try_cast("timestamp").alias("timestamp"), F.col("actor.login").alias("sender"), text.alias("content"), F.col("type").alias("subject"), F.col("repo.name").alias("thread_id"), F.to_json(F.struct(F.col("repo.name").alias("repo"), "type")).alias("raw_metadata")), source)


def work_items(spark: SparkSession, path: str, source: str = "ado_items") -> DataFrame:
    """JSON work items with a nested ``fields`` map; the revision is part of the id, so each revision is an item."""
    w = spark.read.schema("id long, rev long, fields map<string,string>").json(path)
    f = lambda k: F.try_element_at("fields", F.lit(k))
    body = html_to_text(F.coalesce(f("System.Description"), F.lit("")))
    return as_items(w.select(F.concat_ws(":", F.col("id").cast("string"), F.col("rev").cast("string")).alias("source_id"), f("System.ChangedDate").try_cast("timestamp").alias("timestamp"), f("System.CreatedBy").alias("sender"), F.concat(F.lit("["), f("System.WorkItemType"), F.lit("] "), f("System.Title"), F.lit("\n"), body).alias("content"), f("System.Title").alias("subject"), F.col("id").cast("string").alias("thread_id")), source)


def _front(text: Column, key: str) -> Column:
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    value = F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.nullif(F.btrim(value, F.lit("\"' ")), F.lit(""))


def notes(spark: SparkSession, path: str, source: str = "notes", skip: str = r"/\.|/templates/") -> DataFrame:
    """Markdown files: front matter, first heading, links unwrapped. Timestamps: front matter, file name, file time; the last two are inferred."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
    files = files.where(~F.col("path").rlike(skip))
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)\.md$", 1))
    own = F.coalesce(_front(F.col("value"), "created"), _front(F.col("value"), "date")).try_cast("timestamp")
    named = F.concat_ws("-", *[F.regexp_extract(name, DATE_IN_NAME, g) for g in (1, 2, 3)]).try_cast("timestamp")
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    heading = F.nullif(F.trim(F.regexp_extract("value", r"(?m)^# (.+)$", 1)), F.lit(""))
    return as_items(files.select(F.col("path").alias("source_id"), F.coalesce(own, named, "mtime").alias("timestamp"), own.isNull().alias("timestamp_inferred"), body.alias("content"), F.coalesce(_front(F.col("value"), "title"), heading, name).alias("subject")), source)


def facts(spark: SparkSession, path: str, section: str = "Insights / Facts", least: int = 20, source: str = "chats_facts") -> DataFrame:
    """The bullets of a section of Markdown files, one item each; short ones are left out."""
    files = notes(spark, path, source).drop("id", "source", "lang")
    part = F.regexp_extract("content", rf"(?s)(?:^|\n)## {section}\s*\n(.*?)(?=\n## |\z)", 1)
    bullets = F.transform(F.filter(F.split(part, r"(?m)^\s*[-*] "), lambda b: F.trim(b) != ""), lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)\n\s*\n.*", ""), r"\s*\n\s*", " ")))
    rows = files.withColumn("content", F.explode(bullets)).where(F.length("content") >= least)
    return as_items(rows.withColumn("source_id", F.concat("source_id", F.lit("#"), F.substring(F.sha2("content", 256), 1, 8))), source)


def ledger(spark: SparkSession, path: str, source: str = "tier2_ledger") -> DataFrame:
    """A JSON index of notes (id to title, statement, body, updated), its entries as items; the statement leads unless the body opens with it."""
    raw = spark.read.schema("notes map<string,struct<title:string,statement:string,body:string,updated:string>>").option("multiLine", "true").json(path)
    n = raw.select(F.explode("notes").alias("key", "v")).select("key", "v.*")
    body, statement = F.coalesce("body", F.lit("")), F.coalesce("statement", F.lit(""))
    text = F.when(F.startswith(body, statement), body).otherwise(F.concat(statement, F.lit("\n\n"), body))
    return as_items(n.select(F.col("key").alias("source_id"), F.col("updated").try_cast("timestamp").alias("timestamp"), text.alias("content"), F.col("title").alias("subject")), source)


def calendar(spark: SparkSession, path: str, source: str = "calendar") -> DataFrame:
    """JSON events; free time is left out."""
    e = spark.read.schema("id string, subject string, bodyPreview string, showAs string, start struct<dateTime:string>, organizer struct<emailAddress:struct<address:string>>, attendees array<struct<emailAddress:struct<address:string>>>").json(path)
    e = e.where("lower(coalesce(showAs, '')) <> 'free' AND id IS NOT NULL")
    return as_items(e.select(F.col("id").alias("source_id"), F.col("start.dateTime").try_cast("timestamp").alias("timestamp"), F.col("organizer.emailAddress.address").alias("sender"), F.col("attendees.emailAddress.address").alias("recipients"), F.concat_ws("\n", "subject", "bodyPreview").alias("content"), "subject"), source)


def team_messages(spark: SparkSession, path: str, source: str = "teams") -> DataFrame:
    """JSON chat messages: system and machine posts left out, HTML cleaned, mentions unwrapped."""
    m = spark.read.schema("id string, messageType string, createdDateTime string, chatId string, from struct<user:struct<displayName:string>, application:struct<displayName:string>>, body struct<contentType:string, content:string>").json(path)
    m = m.where("messageType = 'message' AND from.user.displayName IS NOT NULL")
    text = F.regexp_replace("body.content", r"(?is)<attachment\b.*?</attachment>", "")
    return as_items(m.select(F.col("id").alias("source_id"), F.col("createdDateTime").try_cast("timestamp").alias("timestamp"), F.col("from.user.displayName").alias("sender"), html_to_text(text).alias("content"), F.col("chatId").alias("thread_id")).where("content <> ''"), source)


def folder(spark: SparkSession, path: str, source: str = "folder") -> DataFrame:
    """Plain text files; timestamps from the name or else the file, inferred either way."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_modification_time").alias("mtime"))
    named = F.concat_ws("-", *[F.regexp_extract("source_id", DATE_IN_NAME, g) for g in (1, 2, 3)]).try_cast("timestamp")
    return as_items(files.select("source_id", F.coalesce(named, "mtime").alias("timestamp"), F.lit(True).alias("timestamp_inferred"), F.col("value").alias("content"), F.regexp_extract("source_id", r"([^/]+)$", 1).alias("subject")), source)


def mail_listing(spark: SparkSession, path: str, source: str = "email") -> DataFrame:
    """JSON lines of a mail service's listing (id, conversationId, subject, from, toRecipients, receivedDateTime, body, internetMessageHeaders); lists' and machines' mail is left out."""
    person = "struct<emailAddress:struct<name:string, address:string>>"
    m = spark.read.schema(f"id string, conversationId string, subject string, from {person}, toRecipients array<{person}>, ccRecipients array<{person}>, receivedDateTime string, body struct<contentType:string, content:string>, internetMessageHeaders array<struct<name:string, value:string>>").json(path)
    headers = F.transform(F.coalesce("internetMessageHeaders", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.lower(h["name"]))
    sender = F.col("from.emailAddress.address")
    by_machine = F.arrays_overlap(headers, F.array(*map(F.lit, LIST_HEADERS))) | F.coalesce(sender.rlike(AUTOMATED), F.lit(False))
    to = F.filter(F.concat(*[F.coalesce(F.col(c)["emailAddress"]["address"], F.array().cast("array<string>")) for c in ("toRecipients", "ccRecipients")]), lambda a: a.isNotNull())
    text = F.when(F.lower("body.contentType") == "html", html_to_text(F.col("body.content"))).otherwise(F.col("body.content"))
    return as_items(m.where(F.col("id").isNotNull() & ~by_machine).select(F.col("id").alias("source_id"), F.col("receivedDateTime").try_cast("timestamp").alias("timestamp"), sender.alias("sender"), to.alias("recipients"), text.alias("content"), "subject", F.col("conversationId").alias("thread_id")), source)


def delimited_records(spark: SparkSession, path: str, fields: list[str], source: str, record: str = "\x1e", unit: str = "\x1f") -> DataFrame:
    """Text files of records parted by ``record`` and fields by ``unit``, as a desktop application exports them; ``fields`` names them in order.

    source_id is a must; records with another number of fields are left out. A timestamp is read as written, others become null.
    """
    rows = spark.read.option("lineSep", record).text(path).select(F.split("value", unit).alias("f")).where(F.size("f") == len(fields))
    rows = rows.select(*[F.nullif(F.trim(F.get("f", F.lit(k))), F.lit("")).alias(c) for k, c in enumerate(fields)]).where("source_id IS NOT NULL")
    if "timestamp" in fields:
        rows = rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
    if "recipients" in fields:
        rows = rows.withColumn("recipients", F.filter(F.split(F.coalesce("recipients", F.lit("")), r"\s*[;,]\s*"), lambda r: r != ""))
    return as_items(rows, source)


def chat_service(spark: SparkSession, path: str, source: str = "teams_chats", own: str = "me") -> DataFrame:
    """JSON lines of chats with their roster (id, topic, members, messages): recipients are the roster without the sender, a talk of two is named after the other one."""
    message = "struct<id:string, type:string, from:string, composeTime:string, content:string>"
    c = spark.read.schema(f"id string, topic string, members array<struct<id:string, name:string>>, messages array<{message}>").json(path)
    m = c.select(F.col("id").alias("thread_id"), "topic", "members", F.explode("messages").alias("m")).where("m.id IS NOT NULL AND m.type IN ('RichText/Html', 'Text')")
    name_of = F.get(F.filter("members", lambda p: p["id"] == F.col("m.from")), F.lit(0))["name"]
    others = F.transform(F.filter("members", lambda p: p["id"] != F.col("m.from")), lambda p: F.coalesce(p["name"], p["id"]))
    single = F.get(F.filter(F.col("members.name"), lambda n: n != own), F.lit(0))
    subject = F.coalesce("topic", F.when(F.size("members") == 2, single))
    rows = m.select(F.concat_ws(":", "thread_id", "m.id").alias("source_id"), F.col("m.composeTime").try_cast("timestamp").alias("timestamp"), F.coalesce(name_of, F.col("m.from")).alias("sender"), others.alias("recipients"), html_to_text(F.col("m.content")).alias("content"), subject.alias("subject"), "thread_id")
    return as_items(rows.where("content <> ''"), source)


def channels(spark: SparkSession, path: str, source: str = "teams_channels") -> DataFrame:
    """JSON lines of channel posts with replies (id, team, channel, from, createdDateTime, subject, body, replies); a post and its replies are a thread, machines' posts are left out."""
    post = "id string, from struct<user:struct<displayName:string>>, createdDateTime string, body struct<content:string>"
    p = spark.read.schema(f"{post}, team string, channel string, subject string, replies array<struct<{', '.join(x.replace(' ', ':', 1) for x in ('id string', 'from struct<user:struct<displayName:string>>', 'createdDateTime string', 'body struct<content:string>'))}>>").json(path)
    cols = ["id", "from", "createdDateTime", "body"]
    top = p.select("team", "channel", "subject", F.col("id").alias("root"), F.struct(*cols).alias("m"))
    rest = p.select("team", "channel", "subject", F.col("id").alias("root"), F.explode("replies").alias("m"))
    rows = top.unionByName(rest).where(F.col("m.id").isNotNull() & F.col("m.from.user.displayName").isNotNull() & ~F.col("m.from.user.displayName").rlike(MACHINE_NAME))
    text = html_to_text(F.coalesce("m.body.content", F.lit("")))
    return as_items(rows.select(F.concat_ws(":", "root", "m.id").alias("source_id"), F.col("m.createdDateTime").try_cast("timestamp").alias("timestamp"), F.col("m.from.user.displayName").alias("sender"), text.alias("content"), F.coalesce("subject", F.concat_ws(" / ", "team", "channel")).alias("subject"), F.concat_ws(":", "team", "channel", "root").alias("thread_id")).where("content <> ''"), source)


def memory_files(spark: SparkSession, path: str, source: str = "agent_memory", least: int = 20) -> DataFrame:
    """Markdown files of an assistant's memory: every section under a heading is an item; the repository is the folder above ``memory``, times are the file's and inferred."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("timestamp"))
    body = F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    rows = files.select("path", "timestamp", F.posexplode(F.split(body, r"(?m)^(?=#{1,6} )")).alias("no", "part")).withColumn("part", F.btrim("part", F.lit(" \t\r\n"))).where(F.length("part") >= least)
    repo = F.nullif(F.regexp_extract("path", r"([^/]+)/memory/[^/]+$", 1), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract("part", r"\A#{1,6} ([^\n]*)", 1)), F.lit(""))
    # A section keeps its id as long as its heading and place do.
    key = F.concat("path", F.lit("#"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(heading, F.lit("")), F.col("no").cast("string")), 256), 1, 8))
    return as_items(rows.select(key.alias("source_id"), "timestamp", F.lit(True).alias("timestamp_inferred"), F.col("part").alias("content"), F.coalesce(heading, F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("subject"), F.to_json(F.struct(repo.alias("repo"))).alias("raw_metadata")), source)


def address_book(records: DataFrame, phones: DataFrame, mails: DataFrame) -> DataFrame:
    """(canonical, aliases) of an address book's records(id, first, last, organisation), phones(owner, number) and mails(owner, address).

    Records without phone or mail stay; of a record without any name the organisation is the name; numbers stand in international form, addresses in lower case. Repeats fold.
    """
    from emberlake.functions.text import phone

    p = phones.select(F.col("owner").alias("id"), phone(F.col("number")).alias("p")).groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    e = mails.select(F.col("owner").alias("id"), F.lower(F.trim("address")).alias("e")).where("e LIKE '%@%'").groupBy("id").agg(F.array_sort(F.collect_set("e")).alias("es"))
    none = F.array().cast("array<string>")
    name = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "first", "last")), F.lit("")), F.nullif(F.trim("organisation"), F.lit("")))
    rows = records.join(p, "id", "left").join(e, "id", "left").select(name.alias("canonical"), F.concat(F.coalesce("ps", none), F.coalesce("es", none)).alias("aliases")).where("canonical IS NOT NULL")
    return rows.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, aliases) of JSON lines of a company directory (displayName, mail, userPrincipalName, businessPhones, mobilePhone); records without a name are left out."""
    from emberlake.functions.text import phone

    d = spark.read.schema("displayName string, mail string, userPrincipalName string, businessPhones array<string>, mobilePhone string").json(path)
    numbers = F.transform(F.concat(F.coalesce("businessPhones", F.array().cast("array<string>")), F.array("mobilePhone")), lambda n: phone(n))
    aliases = F.array_distinct(F.array_compact(F.concat(F.array(F.lower("mail"), F.lower("userPrincipalName")), numbers)))
    return d.select(F.trim("displayName").alias("canonical"), aliases.alias("aliases")).where("canonical <> ''").groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
