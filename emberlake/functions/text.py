"""Text functions as Spark expressions: no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norwegian letters and stop words by which a text counts as Norwegian.
NB_LETTERS = "[æøåÆØÅ]"
NB_STOPWORDS = [
    "og", "ikke", "jeg", "det", "som", "har", "skal", "kan", "deg", "meg", "dere", "hvis", "med", "av", "fra", "til", "takk", "hei", "etter",
    "noen", "alle", "blir", "bare", "denne", "dette", "hva", "hvordan",
]
# Words of an organisation's name that do not tell it from another.
ORG_SUFFIXES = "as|asa|ab|inc|llc|ltd|gmbh|group|gruppen|consulting|consult|holding|norge|company|co|corp"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def language(text: Column) -> Column:
    """'no' or 'en'; null for null and for texts under ten characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zæøå]+"), F.lit(0)))
    norwegian = text.rlike(NB_LETTERS) | (F.size(F.array_intersect(words, F.array(*map(F.lit, NB_STOPWORDS)))) >= 2)
    return F.when(F.length(F.trim(text)) >= 10, F.when(norwegian, "no").otherwise("en"))


# What counts as a link with a label, an address, a mail address, a tag, and an odd blank or pictograph.
MARKUP = {
    "label": r"!?\[(?<label>[^\]]*)\]\([^)]*\)",
    "address": r"(?:(?:https?|ftp)://|www\.)\S+",
    "mail": r"\S+@\S+\.\S+",
    "tag": r"<(?:/[a-zA-Z]|[a-zA-Z])[^>\n]*>",
    "sign": r"[\x{a0}\x{2000}-\x{202f}\x{205f}\x{2190}-\x{2bff}\x{3000}\x{feff}\x{1f000}-\x{1faff}]",
}


def strip_markup(text: Column) -> Column:
    """Links to their labels; addresses, mail addresses, tags, odd blanks and pictographs to a space.

    Each kind is looked for in what the kinds before it left, since a label may hold an address and an
    address end in a tag.
    """
    return reduce(lambda t, kind: F.regexp_replace(t, MARKUP[kind], "${label}" if kind == "label" else " "), MARKUP, text)


# The shape of web tokens, and the JSON fields whose text is a secret or a body.
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2}"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]+"
HIDDEN_FIELDS = ["access_token", "refresh_token", "id_token", "client_secret", "api_key", "secret", "body", "content", "text", "html_body", "plain_body"]


def redact(text: Column) -> Column:
    """Secrets out of a log line: web tokens, bearer values, secret and body fields of JSON."""
    shown = F.regexp_replace(F.regexp_replace(text, WEB_TOKEN, "<redacted-jwt>"), BEARER, "Bearer <redacted>")
    return F.regexp_replace(shown, rf'(?i)"({"|".join(HIDDEN_FIELDS)})"\s*:\s*"[^"]*"', '"$1":"<redacted>"')


def without_private(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<private>.*?</private>", "")


def html_to_text(html: Column) -> Column:
    """Style, script and head dropped, blocks to line ends, other tags to nothing, common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(style|script|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")), r"\s+", "_"), 1, most)


def fact_title(text: Column, most: int = 80) -> Column:
    """The first clause, or where that is longer than ``most``, whole words up to it."""
    clause = F.regexp_extract(text, r"^\s*([^.;:!?\n]+)", 1)
    cut = F.regexp_replace(F.substring(clause, 1, most), r"\s+\S*$", "")
    return F.trim(F.when(F.length(clause) <= most, clause).otherwise(cut))


def identity_key(value: Column) -> Column:
    """Lower case and trimmed; of a phone number only digits and plus signs."""
    plain = F.trim(F.lower(F.coalesce(value, F.lit(""))))
    return F.when(plain.rlike(r"^\+?[0-9 \-()]{6,}$"), F.regexp_replace(plain, r"[^0-9+]", "")).otherwise(plain)


def phone(value: Column, country: str = "47", national: int = 8) -> Column:
    """An international number with plus, 8 to 15 digits; null for others. Bare national numbers get ``country``."""
    digits = F.regexp_replace(value, r"[^0-9+]", "")
    plus = F.when(digits.startswith("+"), digits).when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 30))).when(F.length(digits) == national, F.concat(F.lit(f"+{country}"), digits))
    return F.when(plus.rlike(r"^\+[0-9]{8,15}$"), plus)


def merge_key(name: Column) -> Column:
    """A name without case, punctuation and, wherever they stand, the words in ORG_SUFFIXES."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ~w.isin(ORG_SUFFIXES.split("|")))
    return F.array_join(words, " ")


def tidy_name(name: Column, kind: Column) -> Column:
    """Blanks collapsed and outer signs off; people and places in title case."""
    plain = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(kind.isin("person", "place"), F.initcap(plain)).otherwise(plain)


def junk_reasons(name: Column) -> Column:
    """Why a name may be no entity at all, as an array in fixed order."""
    s = F.trim(name)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    solid = F.length(F.replace(s, F.lit(" "), F.lit("")))
    why = F.array_compact(F.array(
        F.when((letters > 0) & (s == F.lower(s)), F.lit("all-lowercase")),
        F.when((F.length(s) <= 2) & (s != F.upper(s)), F.lit("very-short")),
        F.when(s.rlike("^[0-9]+$"), F.lit("numeric")),
        F.when((solid > 0) & (letters / solid < 0.5), F.lit("symbol-heavy")),
    ))
    return F.when(s == "", F.array(F.lit("empty"))).otherwise(why)


def citations(answer: Column, most: Column) -> Column:
    """Numbers in square brackets, first seen first, from 1 to ``most``."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: x.between(1, most)))


def elapsed(seconds: Column) -> Column:
    """A span in words: just now, minutes, hours under 48, days."""
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.lit("~"), F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 48 * 3600, F.concat(F.lit("~"), F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.lit("~"), F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )
