import random
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pytest

from emberlake.llm import leakage, packing, pii, ranks, reading, variants

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(5)
    item = _words(rng, 60)
    other = _words(rng, 60)
    fill = lambda n=50: " ".join(_words(rng, n))
    edited = list(item[5:50])
    edited[9], edited[19] = "changed", "too"
    del edited[30]
    edited.insert(38, "added")
    stock = "Read the following and answer the question."
    docs = [
        (1, f"{fill()} {' '.join(item[10:25])} {fill()}"), (2, f"{fill()} {' '.join(item[10:24])} {fill()}"), (3, f"{fill()} {' '.join(edited)} {fill()}"), (4, f"{fill()} **{'** <b>'.join(x.upper() + '</b>,' for x in other[:20])} {fill()}"),
        (5, f"{fill()} {stock} {fill()}"), (6, None), (7, ""), (8, fill(20_000)), (9, f"{' '.join(item[20:36])}"),
    ]
    items = [(10, stock + "\n" + " ".join(item)), (11, stock + "\n" + " ".join(other)), (12, stock + "\n" + fill()), (13, None), (14, ""), (15, "two words")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, words string")
    e = spark.createDataFrame(items, "eval_id long, text string")
    assert {(r["doc_id"], r["eval_id"]) for r in leakage.leaks(d, e).collect()} == {(1, 10), (3, 10), (4, 11), (9, 10)}
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_seeds_skip_ignored_places():
    words = leakage.words_of(" ".join(f"a{k}" for k in range(12)))
    changed = words.copy()
    changed[4] = 1
    a, b = (set(leakage.seeds_of(w)[0].tolist()) for w in (words, changed))
    assert a & b and len(leakage.seeds_of(words[:3])[0]) == 0


@pytest.mark.parametrize("capacity", [10, 64])
def test_packing_histogram(capacity):
    rng = random.Random(1)
    histogram = Counter(rng.choice([1, 3, 3, 7, capacity // 2, capacity, rng.randint(1, capacity)]) for _ in range(3000))
    patterns = packing.pack_histogram(histogram, capacity)
    used = Counter()
    for lengths, packs in patterns:
        assert sum(k * n for k, n in lengths.items()) <= capacity and packs > 0
        for k, n in lengths.items():
            used[k] += n * packs
    assert used == histogram
    assert sum(p for _, p in patterns) <= 1.1 * sum(k * n for k, n in histogram.items()) / capacity + 1


def test_packing_whole_and_cut(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 4), (3, 6), (3, 6), (4, 0), (5, None), (6, 10)], "doc_id long, n_tokens long")
    limits = spark.createDataFrame([("s", 10), ("s", 12), ("none", 0), ("x", None), ("l", 100)], "limit_name string, capacity_tokens int")
    rows = packing.pack(sizes, limits).collect()
    fill = Counter()
    for r in rows:
        fill[r["limit_name"], r["container_id"]] += r["token_to"] - r["token_from"]
    assert all(n <= (10 if limit == "s" else 100) for (limit, _), n in fill.items())
    assert sorted((r["token_from"], r["token_to"]) for r in rows if r["doc_id"] == 1 and r["limit_name"] == "s") == [(0, 10), (10, 20), (20, 25)]
    assert len(rows) == 9 + 7 and sum(fill.values()) == 2 * 51
    assert packing.pack(sizes.limit(0), limits).count() == 0 and packing.pack(sizes, limits.limit(0)).count() == 0


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no vocabulary file here")
def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>" * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3


def test_numbered(spark):
    df = spark.range(100).selectExpr("id", "id % 3 = 0 AS g", "int(id / 7) AS b")
    got = ranks.numbered(df, ["g"], df["b"], ["id"], "n").orderBy("g", "n").collect()
    assert [r["n"] for r in got] == [*range(1, 67), *range(1, 35)] and [r["id"] for r in got if r["g"]] == list(range(0, 100, 3))


def _graded(rng, level, n=150):
    return " ".join((f"hard{rng.randrange(60)}" if rng.random() < (level - 1) / 4 else f"easy{rng.randrange(60)}") for _ in range(n)).replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") + "."


def test_reading_levels_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(k, _graded(rng, k % 5 + 1)) for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "too short"), (903, "zzz qqq " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, r, k % 5 + 1 if k % 11 else 3) for k in range(200) for r in "ab"] + [(5, "c", None), (None, "a", 2), (903, "a", None)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    assert set(got) == set(range(400)) | {903}
    assert np.mean([got[k] == k % 5 + 1 for k in range(200, 400)]) >= 0.85
    with pytest.raises(ValueError):
        reading.reading_levels(docs, labels.limit(0))


def test_prose_leaves_pasted_parts_out():
    text = "# Head\nSubject: x\nReal words here.\n```\ncode words\n```\n| a | b |\n- list item\n2026-03-03 08:48 WARN retry=3\n[9:10] Bo: said this.\n> quoted prose line goes on here"
    assert reading.prose_words(text) == ["real", "words", "here", "said", "this", "quoted", "prose", "line", "goes", "on", "here"]


SURNAMES = ["Tuvlgard", "Kvistgard", "Nordgard", "Stolpgard", "Ostrgard"]


def _entities(spark, more=()):
    rows = [(k, f"{f} {s}", "person", None, 0) for k, (f, s) in enumerate((f, s) for f in ("Mei", "Farid", "Ingrid") for s in SURNAMES)]
    return spark.createDataFrame([*rows, *more], "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int")


def test_personal_data(spark):
    rng = random.Random(3)
    kinds = [
        lambda: ("ask {} for the menu", f"{rng.choice(['Mei', 'Farid', 'Ingrid'])} {rng.choice(SURNAMES)}", "person_name"), lambda: ("write to {} please", f"a{rng.randrange(99)}@example.test", "email"), lambda: ("call {} today", f"+47 {rng.randrange(10, 99)} 22 33 44", "phone"),
        lambda: ("form says {} in box", f"{rng.randrange(10**10, 10**11)}", "id_number"), lambda: ("meet at {}, ring", f"{rng.randrange(9, 99)} Tuvl Lane", "address"), lambda: ("lunch at {}:15 as the parser broke", "", ""), lambda: ("Winter Gate {} ok", "", ""),
    ]
    rows, want = [], set()
    for k in range(500):
        frame, value, kind = kinds[k % len(kinds)]()
        rows.append((str(k), "signal", f"s:{k}", frame.format(value), ["me", "Mei Tuvlgard <mei@example.test>"] if k == 0 else [], T0, "clash"))
        if kind:
            want.add((str(k), kind, value))
    rows += [("n", "signal", "s:n", None, None, T0, ""), ("e", "signal", "s:e", "", [None, ""], T0, ""), ("twice", "signal", "s:t", "a1@example.test and a1@example.test", [], T0, ""), ("long", "signal", "s:l", "words and words " * 5000 + "a2@example.test", [], T0, "")]
    items = spark.createDataFrame(rows, "id string, source string, source_id string, content string, recipients array<string>, ingested_at timestamp, found_text string")
    found = pii.find(items, _entities(spark)).collect()
    got = {(r["item_id"], r["pii_kind"], r["found_text"]) for r in found if r["field_name"] == "content"}
    want |= {("twice", "email", "a1@example.test"), ("long", "email", "a2@example.test")}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    assert {(r["pii_kind"], r["found_text"]) for r in found if r["field_name"] == "recipients"} == {("person_name", "Mei Tuvlgard"), ("email", "mei@example.test")}
    red = {r["item_id"]: r for r in pii.redact(items, _entities(spark)).collect()}
    assert red["twice"]["content"] == "[EMAIL] and [EMAIL]" and red["n"]["content"] is None and red["5"]["content"] == rows[5][3]


def test_variants(spark):
    people = [
        (100, "Katherine Lillgrovdahl", "person", ["Kate"], 0), (101, "Katehrine Lillgrovdahl", "person", [], 1), (102, "Lillgrovdahl, Kathy", "person", None, 0), (103, "K. Lillgrovdahl", "person", ["", None], 2), (104, "Ingrid Lillgrovdahl", "person", [], 0),
        (200, "Nordvik Foods Ltd", "organization", ["Foods"], 0), (201, "nordvik-foods", "organization", [], 0), (202, "NOFL-123", "organization", ["Nordvik Foods"], 0), (203, "Nordvik Energi", "organization", [], 0), (300, "", "place", None, 0), (301, None, "place", None, 0),
    ]
    items = spark.createDataFrame([("1", "email", "katherine.lillgrovdahl@example.test"), ("2", "email", "klillgrovdahl"), ("3", "email", "me"), ("4", "email", None), ("5", "notes", "Kate Lillgrovdahl"), ("6", "email", "Dr. Kate  Lillgrøvdahl.")], "id string, source string, sender string")
    pairs = {tuple(r) for r in variants.variant_pairs(_entities(spark, people), items, ["email"]).collect()}
    same = ["e:100", "e:101", "e:102", "e:103", "s:katherine.lillgrovdahl@example.test", "s:klillgrovdahl", "s:Dr. Kate  Lillgrøvdahl."]
    assert {(min(a, b), max(a, b)) for a in same for b in same if a != b} <= pairs
    assert {("e:200", "e:201"), ("e:200", "e:202"), ("e:201", "e:202")} <= pairs
    assert not any("e:104" in p or "e:203" in p or "e:5" in p for p in pairs)
    assert variants.variant_pairs(_entities(spark).limit(0), items.limit(0), ["email"]).count() == 0


def test_similarities():
    assert variants.slips("abcd", "abdc") == 1 and variants.slips("abcd", "xyz", 2) == 3 and variants.slips("", "ab") == 2
    assert variants.monge_elkan(["k", "berg"], ["katherine", "berg"]) > 0.95 > variants.monge_elkan(["mei", "berg"], ["omar", "berg"])
    assert variants.bands_for(0.5, 0.95, 4) == 47 and variants.fold("Åse Ø. Æ") == "ase o. ae"


def test_cores_within_the_slips_always_meet(spark):
    rng = random.Random(3)
    rows, want = [], set()
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    for k in range(300):
        size = rng.randint(5, 14)  # shorter ones fall below SAME, as do two slips in eight letters
        a = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", size))
        b = swap(a, size // 2) if size < 9 else rng.choice([swap(swap(a, 1), size - 2), swap(a, 3)[:-1], "#" + a[1:] + "#"])
        rows += [(f"person|w{k}|{c}", f"person|w{k}", c) for c in (a, b)]
        want.add(tuple(sorted(f"person|w{k}|{c}" for c in (a, b))))
    rows += [(f"person|x|{c}", "person|x", c) for c in ("abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxyz")]  # over the bound between the two ways
    want.add(("person|x|abcdefghijklmnopqrstuvwx", "person|x|abcdefghijklmnopqrstuvwxyz"))
    forms = spark.createDataFrame(rows, "form string, salt string, core string")
    assert {(r["a"], r["b"]) for r in variants._verified(variants._near(forms)).collect()} == want
    cut = spark.createDataFrame([("person|k|lie", "person|k", "lie")], "form string, salt string, core string")
    people = spark.createDataFrame([("person|kari|lei", "person|k", "lei")], "form string, salt string, core string")
    assert variants._near(cut, people, 1).count() == 1
