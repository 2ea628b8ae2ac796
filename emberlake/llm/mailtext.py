"""The newly written lines of e-mails, by a recursive layout grammar.

    mail    = { blank | intro quote | run | closing [ block ] | block | notice | device | own }
    intro   = a reply header of one or two lines, a forward mark, or a block of From/To/Date/Subject fields
    quote   = lines with a quote mark, which are a mail again, or all that follows an intro without marks
    run     = further lines with a quote mark, between the sender's own lines, once an intro was seen
    block   = name, role, company, phone and web lines, after a closing, a dash line, or in a box
    notice  = a paragraph of legal or company text;  device = a line on the device or app

Only ``own`` nodes of the outermost mail are the sender's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.tables import distinct_items

_MARK = re.compile(r"^ {0,3}([>|]) ?")
_STAMP = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}\.? ?[a-zæøå]{3,9}\.?,? \d{4}|[a-z]{3,9} \d{1,2},? \d{4})"
_REPLY = re.compile(
    rf"^\W*(?:(?=.*{_STAMP}).*\b(?:wrote|writes|skrev|schrieb|skriver|a écrit|escribió)\b.*:|.*\[{_STAMP}[^\]]*\]\s?:)\s*$", re.I
)
_FIELD = re.compile(r"^[*_]*(from|to|cc|bcc|sent|date|subject|reply-to|fra|til|kopi|sendt|dato|emne|von|an|gesendet|betreff)\s?:[*_]*\s?(.*)$", re.I)
_FIRST_FIELD = {"from", "fra", "von", "date", "dato", "sent", "sendt", "subject", "emne"}
_FORWARD = re.compile(r"^\W*(?:-{3,}\s?)?(?:original message|forwarded message|begin forwarded message|opprinnelig melding|videresendt melding|start på videresendt melding|ursprüngliche nachricht|weitergeleitete nachricht)\b.*$", re.I)
_RULE = re.compile(r"^\s*[_=*#~-]{5,}\s*$")
_DASHES = re.compile(r"^\s*(?:--|—|__)\s?$")
_CLOSING = re.compile(
    r"^\W*(?:(?:with )?(?:kind|best|warm|many|warmest)?\s?(?:regards|wishes)|all the best|best|cheers|sincerely|yours(?: \w+)?|thanks and regards|many thanks|take care"
    r"|mvh|m\.v\.h|vh|(?:med )?(?:vennlig|vennleg|beste|mange|gode?) (?:hilsen|hilsener|helsing)|hilsen|hilsener|helsing|ha det|mit freundlichen grüßen)(?P<rest>[\s,.!-]*(?:[^\W\d_][\w.'-]*[ ,]*){0,4})$",
    re.I,
)
_DEVICE = re.compile(r"^\W*(?:sent|sendt|skickat|gesendet|get|hentet|shared|delt|typed|written|skrevet)\b.{0,12}\b(?:from|fra|via|from my|using|with|med|på|on|von|outlook|for)\b.{0,50}$", re.I)
_DEVICE_WORD = re.compile(r"\b(?:phone|mobil\w*|tablet|nettbrett\w*|ipad|iphone|android|outlook|mail app|handheld|device|telefon\w*|brevity|watch|app)\b", re.I)
_NOTICE = re.compile(
    r"^\W*confidential\W*(?::|$|-)|confidential(?:ity)? (?:notice|information|and|or)|privileged|intended (?:only )?(?:for the|reader|recipient)|addressee only|disclaimer|fortrolig informasjon|taushetsplikt|kun ment for|feilsendt"
    r"|^\W*\*\*\* ?(?:notice|merknad|varsel)|think of the (?:trees|environment)|before printing|tenk på (?:miljøet|trærne)|registered (?:in|office|company)|org(?:anisa[sz]jons)?\.? ?(?:nr|nummer)\b|\bcompany no\b"
    r"|^\W*unsubscribe|known (?:threats|viruses)|^\W*(?:external (?:sender|mail|e-?mail)|ekstern avsender)|^this (?:e-?mail|message) (?:and its|and any|is confidential)|^denne (?:e-?posten|meldingen) (?:kan inneholde|og eventuelle)|all rights reserved|do not bind the company",
    re.I,
)
_PHONE = re.compile(r"(?:\+|00)?\d[\d ()./-]{6,}\d")
_WEB = re.compile(r"^\W*(?:www\.\S+|https?://\S+|\S+@\S+\.\S+)\W*$", re.I)
_POSTSCRIPT = re.compile(r"^\W*(?:p\.? ?s\.?|ps|nb|edit)\b\s?[:.,-]", re.I)
_GREETING = re.compile(r"^\W*(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hei|hallo|heisann|god (?:morgen|dag|kveld)|kjære)\b", re.I)
_SENTENCE = re.compile(r"[.?!…]\W*$")
_NAME = r"[^\W\d_][\w.'’-]*"
_NAMES = re.compile(rf"^\W*(?:{_NAME}[ ,]*){{1,5}}\W*$")


@dataclass
class Node:
    kind: str
    lines: list[int] = field(default_factory=list)
    inside: list[Node] = field(default_factory=list)


def _bare(line: str) -> str:
    return line.strip().strip("​ ﻿").strip()


def _fields(lines: list[str], at: int) -> int:
    """How many lines from ``at`` make up a block of header fields: two or more, and a date, sender or subject first."""
    n, names = 0, set()
    while at + n < len(lines) and (m := _FIELD.match(lines[at + n].strip())):
        names.add(m[1].lower())
        n += 1
    first = _FIELD.match(lines[at].strip()) if n else None
    return n if len(names) >= 2 and first and first[1].lower() in _FIRST_FIELD else 0


def _intro(lines: list[str], at: int) -> tuple[int, bool]:
    """The number of lines of an intro at ``at``, and whether all that follows belongs to it even without marks."""
    n = 0
    if _RULE.match(lines[at]) or _FORWARD.match(lines[at]):
        n = 1
        while at + n < len(lines) and n < 3 and not _bare(lines[at + n]):
            n += 1
        if at + n < len(lines) and (more := _fields(lines, at + n)):
            return n + more, True
        return (1, True) if _FORWARD.match(lines[at]) else (0, False)
    if n := _fields(lines, at):
        return n, True
    if _REPLY.match(lines[at]):
        return 1, False
    # A reply header that a mail program broke in two; neither part is a sentence of its own.
    if at + 1 < len(lines) and re.search(_STAMP, lines[at], re.I) and not _SENTENCE.search(lines[at]) and _REPLY.match(f"{lines[at]} {lines[at + 1]}"):
        return 2, False
    return 0, False


def _marked(lines: list[str], at: int, end: int) -> int:
    """The end of the run of marked lines from ``at``; single blank lines between marked ones belong to it."""
    last = at
    while at < end:
        if _MARK.match(lines[at]):
            last = at + 1
        elif _bare(lines[at]):
            break
        at += 1
    return last


def _contact(line: str, names: set[str], after: bool) -> bool:
    """Whether a line is one of a name and contact block. ``after``: it follows a closing, dashes or another such line."""
    s = _bare(line)
    if not s or _POSTSCRIPT.match(s) or _GREETING.match(s) or len(s) > 90:
        return False
    if _WEB.match(s) or s.count(" | ") and _PHONE.search(s):
        return True
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", s)}
    if after:
        return bool(_PHONE.search(s) and len(words) <= 6 or not _SENTENCE.search(re.sub(r"\b(?:inc|ltd|co|corp|\w)\.$", "", s, flags=re.I)) and len(words) <= 7 and "?" not in s and ":" not in s or words and words <= names)
    return bool(_PHONE.fullmatch(s)) or len(words) >= 2 and words <= names and bool(_NAMES.match(s))


def _paragraph(lines: list[str], at: int, end: int) -> int:
    while at < end and _bare(lines[at]) and not _MARK.match(lines[at]):
        at += 1
    return at


def parse(lines: list[str], numbers: list[int], names: set[str], quoted: bool = False) -> list[Node]:
    """The nodes of a mail. ``numbers``: the lines' own numbers; ``names``: words of the sender's name, in lower case."""
    tree: list[Node] = []
    at, end, answered = 0, len(lines), quoted

    def take(kind: str, to: int, inside: list[Node] | None = None) -> None:
        nonlocal at
        tree.append(Node(kind, numbers[at:to], inside or []))
        at = to

    def inner(a: int, b: int) -> list[Node]:
        return parse([_MARK.sub("", x, count=1) for x in lines[a:b]], numbers[a:b], set(), True)

    def block() -> None:
        """A name and contact block right at ``at``, over one blank line if the next paragraph is all contact."""
        nonlocal at
        to = at
        while to < end and _contact(lines[to], names, True) and not _intro(lines, to)[0]:
            to += 1
        if to > at:
            take("block", to)

    while at < end:
        line = lines[at]
        bare = _bare(line)
        n, whole = _intro(lines, at) if bare else (0, False)
        if not bare:
            take("blank", at + 1)
        elif n:
            answered = True
            take("intro", at + n)
            to = at
            while to < end and not _bare(lines[to]):
                to += 1
            if to < end and _MARK.match(lines[to]):
                to = _marked(lines, to, end)
                take("quote", to, inner(at, to))
            elif whole or to < end:
                take("quote", end, inner(at, end))
        elif _MARK.match(line) and (answered or _marked(lines, at, end) - at > 1):
            to = _marked(lines, at, end)
            take("quote", to, inner(at, to))
        elif _DASHES.match(line):
            take("dashes", at + 1)
            block()
        elif _RULE.match(line):
            close = next((k for k in range(at + 1, min(end, at + 9)) if _RULE.match(lines[k])), 0)
            if close and all(_contact(x, names, True) or not _bare(x) for x in lines[at + 1 : close]):
                take("block", close + 1)
            else:
                take("rule", at + 1)
        elif (m := _CLOSING.match(bare)) and len(bare) < 60 and (not m["rest"].strip(" ,.!-") or {w.lower() for w in re.findall(r"[^\W\d_]+", m["rest"])} <= names or m["rest"].strip(" ,.!-").istitle()):
            take("closing", at + 1)
            skip = at
            while not m["rest"].strip(" ,.!-") and skip < end and skip < at + 2 and not _bare(lines[skip]):
                skip += 1
            if skip > at and skip < end and _contact(lines[skip], names, True) and (_NAMES.match(_bare(lines[skip])) or _contact(lines[skip], names, False)):
                take("blank", skip)
            block()
        elif _NOTICE.search(bare) and not _MARK.match(line):
            take("notice", _paragraph(lines, at, end))
        elif _DEVICE.match(bare) and _DEVICE_WORD.search(bare) and len(bare) < 70:
            take("device", at + 1)
        elif _contact(line, names, False):
            take("block", at + 1)
            block()
        else:
            take("own", at + 1)
    return tree


def own_lines(content: str, names: set[str]) -> list[int]:
    """The numbers, from 1, of the lines that the sender wrote for this mail."""
    lines = [x.rstrip("\r") for x in content.split("\n")]
    return [n for node in parse(lines, list(range(1, len(lines) + 1)), names) if node.kind == "own" for n in node.lines]


def name_words(sender: str | None) -> set[str]:
    """The words of a typed sender name or address, in lower case, without the domain."""
    return {w.lower() for w in re.findall(r"[^\W\d_]{2,}", (sender or "").split("@")[0])}


def new_lines(mails: DataFrame) -> DataFrame:
    """(item_id, line_no, line) of the newly written lines of each distinct mail in ``mails``.

    Lines are parted by \\n and count from 1. Blank lines are never returned, nor anything of null or
    empty contents. Each mail is parsed by itself, so no key or thread can be hot.
    """
    rows = distinct_items(mails, "source", "source_id", "sender", "content").where("content IS NOT NULL").select("id", "sender", "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [own_lines(c, name_words(s)) for s, c in zip(b["sender"], b["content"])]
            text = [c.split("\n")[n - 1].rstrip("\r") for c, ns in zip(b["content"], own) for n in ns]
            yield pd.DataFrame({"item_id": np.repeat(b["id"].to_numpy(object), [len(x) for x in own]), "line_no": np.array([n for ns in own for n in ns], np.int64), "line": pd.Series(text, dtype=object)})

    return rows.mapInPandas(cut, "item_id string, line_no long, line string")


def new_text(mails: DataFrame) -> DataFrame:
    """(item_id, new_text): each mail's own lines in order; mails without any are left out."""
    line = F.struct("line_no", "line")
    return new_lines(mails).groupBy("item_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line)).getField("line")).alias("new_text"))
