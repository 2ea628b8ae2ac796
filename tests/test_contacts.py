from datetime import datetime, timedelta, timezone
from random import Random

from emberlake.functions import abbreviations
from emberlake.operators import evaluate, people
from emberlake.operators.vector import knn
from emberlake.plans.retrieve import HybridConfig, hybrid

T0 = datetime(2026, 4, 1, 4, tzinfo=timezone.utc)
SCHEMA = "id string, thread_id string, timestamp timestamp, sender string, recipients array<string>, more int"
PEOPLE = [(1, "Bo Berg", "person", ["bo@x.no", "B"], 0), (2, "Mei Li", "person", None, 0), (3, "Denied", "person", [], 2), (4, "Firm", "org", None, 0)]


def _entities(spark):
    return spark.createDataFrame(PEOPLE, "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int")


def _expected(rows):
    keys = {"bo berg": 1, "bo@x.no": 1, "b": 1, "mei li": 2}
    key = lambda s: (s or "").strip().lower()
    links = {(keys[k], r[0]): r for r in rows if r[2] for k in [key(r[3]), *map(key, r[4] or [])] if k in keys}
    thread = lambda r: r[1] if r[1] is not None else r[0]
    close = lambda a, b: thread(a) == thread(b) and abs(a[2] - b[2]) <= timedelta(hours=2)
    out = {}
    for (e, i), r in links.items():
        who, only = key(r[3]), [key(x) for x in r[4] or []]
        theirs = [o for (e2, _), o in links.items() if e2 == e and keys.get(key(o[3])) == e]
        if who == "me":
            out[e, i] = len(only) == 1 or any(close(r, o) for o in theirs)
        else:
            out[e, i] = keys.get(who) == e and (only == ["me"] or any(key(o[3]) == "me" and o[2] and close(r, o) for o in rows))
    return out


def test_talks_equal_brute_force(spark):
    rnd = Random(5)
    rows = [("x", None, None, None, None, 1), ("y", "t", T0, None, [None], 1), ("z", "t", T0, "", [], 1)]
    for n in range(400):  # one thread holds most; times tie
        names = ["me", "Me ", "Bo Berg", "bo@x.no", "B", "Mei Li", "Denied", "other", None]
        rows.append((f"i{n:03}", rnd.choice(["hot", "hot", "hot", "t", None]), T0 + timedelta(minutes=30 * rnd.randrange(160)), rnd.choice(names), rnd.choice([None, [], ["me"], ["Bo Berg"], ["Mei Li", "B"], ["me", "bo@x.no"], ["other"]]), n))
    items = spark.createDataFrame(rows, SCHEMA)
    talked = people.talks(items, _entities(spark), ["me"]).cache()
    got = {(r["entity_id"], r["item_id"]): r["talk"] for r in talked.collect()}
    want = _expected(rows)
    assert got == want and 0 < sum(want.values()) < len(want)
    by = {r[0]: r for r in rows}
    for first in (False, True):
        cases = people.contact_cases(talked, 3, first).collect()
        for e in (1, 2):
            mine = [by[i] for (p, i), ok in want.items() if p == e and ok]
            best = sorted(mine, key=lambda r: ((r[2] - T0) * (1 if first else -1), r[0]))[0]
            answers = {r[0] for r in mine if (r[1] or r[0]) == (best[1] or best[0]) and abs(r[2] - best[2]) <= timedelta(hours=2)}
            assert {(c["anchor"], c["item_id"]) for c in cases if c["entity_id"] == e} == {(best[0], i) for i in answers}
    assert people.contact_cases(talked, 10**6).count() == 0
    assert people.talks(items.limit(0), _entities(spark), ["me"]).count() == 0


def test_best_rank_of_the_right_answers(spark):
    found = spark.createDataFrame([("a", "1", 3), ("a", "2", 2), ("b", "9", 1), ("c", "1", 1)], "query_id string, id string, rank int")
    right = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1")], "query_id string, id string")
    assert {r["query_id"]: r["rank"] for r in evaluate.ranks_of(found, right).collect()} == {"a": 2, "b": None}


def test_evidence_of_aliases(spark):
    mined = spark.createDataFrame([("A.B", "Alpha Beta", 2, "7|8"), ("ab", "Aft Bow", 5, "9"), ("AB", "Ale Bar", 1, "3|4"), ("AB", "Ark Bay", 1, None), (None, "x", 1, "1"), ("..", "y", 1, "1")], "short_form string, long_form string, n long, evidence string")
    aliases = spark.createDataFrame([("a-b", 1), ("zz", 2), (None, 3), ("--", 4)], "alias string, n int")
    got = {r["n"]: (r["long_form"], r["evidence"]) for r in abbreviations.with_evidence(aliases, mined).collect()}
    assert got == {1: ("Aft Bow", "9;7;3"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_sessions_by_their_vectors(spark):
    items = spark.createDataFrame([("1", "t", T0, "Bo", "nothing of it", "s", "chat", "en", None, False, "{}")], "id string, thread_id string, timestamp timestamp, sender string, content string, subject string, source string, lang string, junk_reason string, timestamp_inferred boolean, raw_metadata string")
    sessions = spark.createDataFrame([("s1", "t", "talk of boats", "Bo", "chat", 1, 2, ["1"]), ("s2", "u", "talk of trees", "Mei", "mail", 1, 2, ["1"])], "id string, thread_id string, summary string, participants string, source string, start_us long, end_us long, raw_item_ids array<string>")
    vectors = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    run = lambda **k: [(r["kind"], r["id"]) for r in hybrid(items, {"q": "zzz"}, HybridConfig(dim=2, **k), sessions, None, asked, session_vectors=vectors).orderBy("place").collect()]
    assert run() == [("session", "s2"), ("session", "s1")]
    assert run(source_filter=["chat"]) == [("session", "s1")]
    many = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [1.0, 1.0]), (None, [0.0, 1.0]), ("n", None), ("l", [1.0]), ("w", [float("nan"), 1.0])], "id string, embedding array<float>")
    assert [(r["id"], r["rank"]) for r in knn(many, asked, 5, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert knn(many.limit(0), asked, 5, 2).count() == 0 == knn(many, asked.limit(0), 5, 2).count()
