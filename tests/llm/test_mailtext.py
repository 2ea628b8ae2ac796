from datetime import datetime, timezone

import pytest

from emberlake.llm import mailtext

MAILS = [
    ("Hi,\r\nthe plan works.\r\n\r\nBest regards,\r\nBo Berg\r\nBuyer\r\n\r\nPS: call me.\r\n\r\nOn Mon, 2 Mar 2026 at 10:00, Al <al@example.test> wrote:\r\n> old text\r\n> > older", [1, 2, 8]),
    ("On Mar 3, 2026, at 19:59, Al Dahl\n<al@example.test> wrote:\n> question one\n\nMy answer.\n\n> question two\nAnother answer.", [5, 8]),
    ("FYI, see below.\n\n---------- Forwarded message ---------\nFrom: Al <al@example.test>\nDate: Mon, 2 Mar 2026\nSubject: x\n\nforwarded text\nand more", [1]),
    ("Text.\n\n________________________________\nFrom: Al\nDate: 2026-03-30 22:30\nTo: Bo\nSubject: x\n\nquoted without marks", [1]),
    ("> is the prompt after login.\nFrom: the side door, To: the ramp - that is the route.\nAs the supplier wrote: it is late.", [1, 2, 3]),
    ("--- agenda ---\n1. the menu\n2. the parser\n\n-- \nBo Berg\nAnalyst\n+47 14034582\n\nCONFIDENTIAL: may be legally privileged.\nDo not copy.", [1, 2, 3]),
    ("Please forward the confidential menu by Friday, I have the rest.\n\nHilsen Bo\n\nHei,\nmer tekst.", [1, 5, 6]),
    ("Short.\n\n********************\nBO BERG\n+47 14034582\n********************", [1]),
    ("Done.\nSent from my phone", [1]),
    ("", []),
    ("\n \n", []),
]


@pytest.mark.parametrize("text,want", MAILS)
def test_own_lines(text, want):
    assert mailtext.own_lines(text, mailtext.name_words("Bo Berg")) == want


def test_nested_quotes_are_a_tree():
    lines = MAILS[0][0].replace("\r", "").split("\n")
    quote = next(n for n in mailtext.parse(lines, list(range(1, len(lines) + 1)), set()) if n.kind == "quote")
    assert [n.kind for n in quote.inside] == ["own", "quote"]


def test_table(spark):
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [("1", "email", "m:1", "Bo", "a\n\nb\n" + "x " * 50_000, t, 3), ("1", "email", "m:1", "Bo", "a\n\nb\n" + "x " * 50_000, t, 3), ("2", "email", "m:2", None, None, t, 3), ("3", "email", "m:3", "", "", t, 3)]
    mails = spark.createDataFrame(rows, "id string, source string, source_id string, sender string, content string, ingested_at timestamp, line_no int")
    got = sorted((r["item_id"], r["line_no"]) for r in mailtext.new_lines(mails).collect())
    assert got == [("1", 1), ("1", 3), ("1", 4)]
    assert mailtext.new_text(mails).count() == 1 and mailtext.new_lines(mails.limit(0)).count() == 0
