import random

import numpy as np

from emberlake.llm import bits, leakage, pii, variants


def test_passage_behind_many_short_runs():
    rng = np.random.default_rng(0)
    word = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    item = word(60)
    noise = np.concatenate([np.concatenate([item[:4], word(1)]) for _ in range(200)])
    assert leakage.longest_overlap(np.concatenate([noise, item[4:34]]), np.concatenate([np.tile(item[:4], 20), item[4:34]])) >= 30
    head = np.concatenate([item[:4], word(6), item[10:14], word(6), item[20:38]])  # a loose head before a dense tail
    assert leakage.longest_overlap(head, item) == 22
    assert leakage.longest_overlap(word(3), item) == 0 == leakage.longest_overlap(word(0), word(0))


def test_bit_table_lets_no_member_slip(spark):
    words = [f"name{k}" for k in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "x string").selectExpr("xxhash64(x) AS seed")
    table = pii.HashedWords(bits.bit_table(df, 3000))
    assert all(w in table for w in words) and sum(f"other{k}" in table for k in range(3000)) < 30
    assert "a" not in pii.HashedWords(bits.bit_table(df.limit(0), 0))


def _texts(names, rng, n):
    forms = ["call {} today", "{} said so", "I met {} and then {} left", "ask {} about the boat", "the boat is old", "no names here at all"]
    return [rng.choice(forms).replace("{}", rng.choice(names)) for _ in range(n)]


def test_names_outside_the_lists_and_spelled_addresses():
    rng = random.Random(1)
    first = [f"{a}{b}" for a in ("Mar", "Tor", "Ing", "Sol", "Han", "Bri") for b in ("a", "en", "id", "unn")]
    last = [f"{a}{b}" for a in ("Berg", "Dal", "Strand", "Vik", "Nord") for b in ("heim", "land", "stad", "vold")]
    names = [f"{rng.choice(first)} {rng.choice(last)}" for _ in range(300)]
    known = pii.Names({x.lower() for x in first}, {x.lower()[-4:] for x in last})
    texts = _texts(names, rng, 600) + [f"write to a{k}.b [at] firma.no please" for k in range(30)]
    field = pii.fit_field(texts, known, pii.Names(known.first, known.endings, 0))
    assert field.skip.shape == (8, 8) and np.allclose(field.skip, field.skip.T)
    said = field.spans(["write to post [at] example.no please", "", "Inga Bergheim said so"])
    assert [k for _, _, k in said[0]] == ["email"] and said[1] == [] and [k for _, _, k in said[2]] == ["person_name"]
    # Ablation: first names that no list has, by the patterns, the chain and the skip chain.
    blind = pii.Names(known.first - {"inga", "torunn"}, known.endings)
    tests = [t for t in _texts([n for n in names if n.split()[0] in ("Inga", "Torunn")], rng, 200) if "Inga" in t or "Torunn" in t]
    truth = [pii.pattern_spans(t, known) for t in tests]
    total = sum(map(len, truth))
    patterns = sum(len(set(a) & set(pii.pattern_spans(t, blind))) for t, a in zip(tests, truth))
    field.names, field.types = blind, {}
    field._row("")
    with_links = sum(len(set(a) & set(b)) for a, b in zip(truth, field.spans(tests)))
    skip, field.skip = field.skip, np.zeros((8, 8))
    chain = sum(len(set(a) & set(b)) for a, b in zip(truth, field.spans(tests)))
    print(f"unlisted first names found of {total}: patterns {patterns}, chain {chain}, skip chain {with_links}")
    assert patterns == 0 and with_links >= chain > 0.5 * total


def test_unknown_nicknames_meet_by_whole_names(spark):
    rows = [(k, f"{a} {b}holmengrind", "person", None, 0) for k, (a, b) in enumerate([("Bartholomew", "Ask"), ("Bartholomeus", "Ask"), ("Ragnhild", "Ask"), ("Bartholomew", "Eik")])]
    e = spark.createDataFrame(rows, "id long, canonical_name string, entity_type string, aliases array<string>, pending_review int")
    items = spark.createDataFrame([], "id string, source string, sender string")
    assert {tuple(r) for r in variants.variant_pairs(e, items, ["email"]).collect()} == {("e:0", "e:1")}
    many = spark.createDataFrame([(f"r{k}", f"Extraordinarilylong {chr(97 + k)}berg", "person", None) for k in range(8)], "ref string, text string, kind string, aliases array<string>")
    known = variants._known_words(variants._tokens_of(many))
    assert "extraordinarilylong" in {r["word"] for r in known.collect()}
