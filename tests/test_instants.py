from datetime import datetime, timezone

import pytest

from emberlake.operators import instants

SCHEMA = "text string, tz_name string, day_first boolean, epoch_origin string"
OSLO = ("Europe/Oslo", True, "1970-01-01")
YORK = ("America/New_York", False, "2001-01-01")


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2024-01-05 08:00", OSLO, us(2024, 1, 5, 7)),
    ("2024-01-05T08:00:00.123456789Z", OSLO, us(2024, 1, 5, 8) + 123456),
    ("\xa02024-01-05  08:00:01,5 +0530 ", OSLO, us(2024, 1, 5, 2, 30, 1) + 500000),
    ("20240105T080000Z", OSLO, us(2024, 1, 5, 8)),
    ("05.01.2024 kl. 08.00", OSLO, us(2024, 1, 5, 7)),
    ("5. januar 2024 kl. 08:00", OSLO, us(2024, 1, 5, 7)),
    ("Jan 5, 2024 08:00:00", OSLO, us(2024, 1, 5, 7)),
    ("Fri, 05 Jan 2024 08:00:00 GMT", OSLO, us(2024, 1, 5, 8)),
    ("Fri, 05 Jan 2024 08:00:00 -0500 (local)", OSLO, us(2024, 1, 5, 13)),
    ("2024-07-05 08:00:00 CEST", YORK, us(2024, 7, 5, 6)),
    ("2024-07-05 08:00:00 Europe/Oslo", YORK, us(2024, 7, 5, 6)),
    ("03/02/2024 12:30 AM", OSLO, us(2024, 2, 2, 23, 30)),
    ("03/02/2024 12:30 PM", YORK, us(2024, 3, 2, 17, 30)),
    ("1704441600", OSLO, us(2024, 1, 5, 8)),
    ("1704441600123", OSLO, us(2024, 1, 5, 8) + 123000),
    ("1704441600123456789", OSLO, us(2024, 1, 5, 8) + 123456),
    ("726134400.5", YORK, us(2024, 1, 5, 8) + 500000),
    ("2024-03-31 02:30", OSLO, None),  # skipped
    ("2024-10-27 02:30", OSLO, None),  # shown twice
    ("2024-10-27 02:30 +02:00", OSLO, us(2024, 10, 27, 0, 30)),
    ("2024-01-05 08:00", (None, None, None), None),
    ("31/02/2024 10:00", OSLO, None),
    ("2024-01-05T24:10:00Z", OSLO, None),
    ("2024-01-05 08:61", OSLO, None),
    ("2024-01-05", OSLO, None),
    ("25:61", OSLO, None),
    ("yesterday", OSLO, None),
    ("", OSLO, None),
    (None, OSLO, None),
    ("2024-01-05 08:00 Mars/Olympus", OSLO, None),
    ("12", OSLO, None),
    ("13/02/2024 10:00", ("Europe/Oslo", None, None), us(2024, 2, 13, 9)),
    ("03/02/2024 10:00", ("Europe/Oslo", None, None), None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(t, *p) for t, p, _ in CASES], SCHEMA)
    return {(r["text"], r["tz_name"], r["day_first"]): r["utc_micros"] for r in instants.with_instants(rows).collect()}


@pytest.mark.parametrize("case", CASES, ids=[str(c[0]) for c in CASES])
def test_texts(parsed, case):
    text, profile, want = case
    assert parsed[(text, profile[0], profile[1])] == want


def test_dictionary_grows_and_joins_hot_texts(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "2024-01-05 08:00" if k < 90 else f"2024-01-{k - 80:02} 09:00", *OSLO) for k in range(100)] + [("x", None, *OSLO), ("y", "n/a", *OSLO)], "k string, " + SCHEMA)
    path = str(tmp_path / "d")
    assert instants.update_dictionary(spark, rows.where("k < '5'"), path).count() < instants.update_dictionary(spark, rows, path).count() == 12
    found = instants.normalise(rows, instants.parse_dictionary(rows), share=4)
    assert found.count() == 100 and found.select("k").distinct().count() == 100
    assert instants.normalise(rows.limit(0), instants.parse_dictionary(rows.limit(0))).count() == 0


def test_facts_and_profiles(spark):
    raw = spark.createDataFrame([(1, "signal", "2024-01-05 08:00"), (2, "none", "2024-01-05 08:00")], "record_id long, source string, timestamp string")
    facts = spark.createDataFrame([("f1", "2024-01-05 08:00", True), ("f2", "2024-01-05 08:00", None)], "source_id string, timestamp string, timestamp_inferred boolean")
    profiles = spark.createDataFrame([("signal", *OSLO), ("chats_facts", *OSLO)], "source string, tz_name string, day_first boolean, epoch_origin string")
    rows = instants.timestamp_rows(raw, facts, profiles)
    found = instants.normalise(rows, instants.parse_dictionary(rows))
    assert {(r["rec_table"], r["rec_key"]) for r in found.collect()} == {("raw_items", "1"), ("chat_facts", "f2")}
