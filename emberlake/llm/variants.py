"""Variant spellings of one person, organisation or place, linked into clusters.

A reference's text is read into a core (surname, or an organisation's or place's own name) and a word
(first name, or trade or kind of place), or an initial where the word is cut. Whole names meet by MinHash banding over
padded q-grams where a word is none that many names have; cores of equal word meet where they
agree but for letters left out, very long ones by bands too. All are verified by Monge-Elkan similarity and clustered by stars: frequent
spellings are centres, the others join the most similar centre. Spellings with an initial join last.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.session import stage

GRAM = 3
#: Cores a slip or two apart meet surely up to LONG letters. Beyond, two swaps leave a similarity of (L-6)/(L+10), SLIP or more
#: where no gram is repeated; the bands find such a pair with probability RECALL.
LONG, SLIP, RECALL, ROWS = 24, 0.53, 0.96, 5
#: The most slips between two cores, and the letters that each core must have for one.
MOST_SLIPS, LETTERS_A_SLIP = 2, 4
#: Words are known that stand beside this many other words, unless they are a slip away from one that stands beside FAR_MORE times as many.
LEAST_BESIDE, FAR_MORE = 6, 8
#: Whole names of which one has an unknown word meet by bands; the similarity of two names of 12 letters that differ by two slips.
NAME_SLIP, NAME_ROWS = 0.4, 3
#: The least Monge-Elkan similarity of two spellings.
SAME = 0.88

# Short forms of first names and of trades, legal forms, and additions that name nobody.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "ben": "benjamin", "chris": "christopher", "kit": "christopher",
    "deb": "deborah", "debbie": "deborah", "ed": "edward", "ted": "edward", "beth": "elizabeth", "liz": "elizabeth", "fred": "frederick",
    "fritz": "frederick", "gaby": "gabrielle", "jen": "jennifer", "jenny": "jennifer", "jon": "jonathan", "jo": "josephine", "josie": "josephine",
    "kate": "katherine", "kathy": "katherine", "maggie": "margaret", "peggy": "margaret", "mick": "michael", "mike": "michael", "nick": "nicholas",
    "klaus": "nicholas", "pat": "patricia", "trish": "patricia", "dick": "richard", "rick": "richard", "bob": "robert", "rob": "robert",
    "sam": "samantha", "sue": "susannah", "suzy": "susannah", "tom": "thomas", "tori": "victoria", "vicky": "victoria", "bill": "william", "will": "william",
}
TRADES = {
    "an": "analytics", "anlt": "analytics", "cat": "catering", "cons": "consulting", "el": "elektro", "ener": "energi", "fds": "foods", "log": "logistics",
    "mar": "marine", "sys": "systems", "verkst": "verksted",
}
TRADE_WORDS = set(TRADES.values())
PLACE_WORDS = {"annex", "depot", "kontor", "pier"}
LEGAL = {"as", "asa", "ab", "co", "corp", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "plc", "group", "the", "hq"}
ADDITIONS = r"\((?:ekstern|external|hq)\)|- (?:field team|ekstern)$|^(?:mr/ms|mrs?|ms|dr|prof)\b\.?"

_CAMEL = re.compile(r"(?<=[a-zæøåäö])(?=[A-ZÆØÅÄÖ])")
_CODE = re.compile(r"^[A-Z]{2,5}-\d{2,5}$")
_FOLD = str.maketrans({"æ": "ae", "ø": "o", "å": "a", "ä": "a", "ö": "o", "ü": "u", "ß": "ss"})


def fold(text: str) -> str:
    """Lower case without diacritics; aa and oe, as typed for å and ø, fold alike."""
    text = unicodedata.normalize("NFC", text).lower().translate(_FOLD)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return text.replace("aa", "a").replace("oe", "o")


def slips(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours counting as one; ``most`` + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over each side's tokens of the best similarity on the other; initials match words they begin."""

    def inner(x: str, y: str) -> float:
        if min(len(x), len(y)) == 1:
            return 0.95 if x[0] == y[0] else 0.0
        return max(0.0, 1 - slips(x, y, 3) / max(len(x), len(y)))

    one = sum(max((inner(x, y) for y in b), default=0.0) for x in a) / max(1, len(a))
    two = sum(max((inner(x, y) for x in a), default=0.0) for y in b) / max(1, len(b))
    return (one + two) / 2


def split_name(text: str) -> tuple[list[str], bool]:
    """The folded tokens of a typed name, login or address, and whether it is a login."""
    s = re.sub(ADDITIONS, " ", text.strip(), flags=re.I).strip()
    login = bool(re.fullmatch(r"\S+@\S+|[a-zæøå]+(?:[._][a-zæøå]+)*", s)) and not s.isupper()
    if "@" in s:
        s = s.split("@")[0]
    s = re.sub(r"\b(?:[A-Za-z]\.){2,}[A-Za-z]?\b\.?", lambda m: m[0].replace(".", ""), s)  # G.m.b.H.
    s = re.sub(r"\ba/s\b", "as", s, flags=re.I)
    s = _CAMEL.sub(" ", s)
    return [fold(t) for t in re.findall(r"[^\W\d_]+", s)], login


class Words:
    """What is known of the tokens of some references: each one's known word, and which are known themselves."""

    def __init__(self, found: dict[str, str]):
        self.found = found

    def find(self, token: str) -> str | None:
        """The known word that a token is: itself, what it is short for, or the only one a slip away."""
        return NICKNAMES.get(token) or self.found.get(token)

    def is_known(self, token: str) -> bool:
        return token in NICKNAMES or token in _FULL_NAMES or self.found.get(token) == token


_FULL_NAMES = set(NICKNAMES.values())


def read_person(tokens: list[str], login: bool, words: Words) -> tuple[str, str, str] | None:
    """(word, initial, core) of a person's name; an empty word where only an initial stands."""
    tokens = [t for t in tokens if t not in LEGAL or len(tokens) <= 2]
    if not tokens:
        return None
    if len(tokens) == 1:
        t = tokens[0]
        return ("", t[0], t[1:]) if login and len(t) >= 7 and not words.find(t) else None
    full = [t for t in tokens if len(t) > 1]
    if len(full) == 1:
        return "", next(t for t in tokens if len(t) == 1), full[0]
    exact = [t for t in full if words.is_known(t)]
    first = next(iter(exact), None) if len(exact) < len(full) else full[0]
    if first is None:
        first = next((t for t in full if words.find(t)), None) or min(full, key=lambda t: (len(t), full.index(t)))
    rest = [t for t in full if t is not first]
    core = max((t for t in rest if t not in exact), key=len, default=rest[-1])
    return words.find(first) or first, first[0], core


def read_firm(tokens: list[str], nouns: set[str]) -> tuple[str, str, str] | None:
    """(word, initial, core) of an organisation or place; ``nouns``: its trades or kinds of place."""
    own = [t for t in tokens if t not in LEGAL] or tokens
    if not own:
        return None
    word = next((t for t in own if t in nouns), None) or next((TRADES[t] for t in own if nouns == TRADE_WORDS and t in TRADES), None)
    core = max(own, key=len) if word is None else max((t for t in own if t != word and TRADES.get(t) != word), key=len, default="")
    if word is None:
        near = [(slips(t, n, 2), n, t) for t in own if t != core for n in sorted(nouns)]
        if near and min(near)[0] <= 2:
            word = min(near)[1]
    if word is None:  # "NyulvgelosFoods" typed in one word in lower case, or a name without its noun
        word = next((n for n in sorted(nouns) if core.endswith(n) and len(core) > len(n) + 4), "")
        core = core[: len(core) - len(word)] if word else core
    return (word, "", core) if len(core) >= 3 else None


def is_firm(tokens: list[str]) -> bool:
    return any(t in TRADE_WORDS or t in TRADES or t in LEGAL - {"as", "the", "co"} for t in tokens) or any(t.endswith(tuple(TRADE_WORDS)) and len(t) > 12 for t in tokens) or bool(tokens) and len(tokens) > 1 and any(slips(t, n, 1) <= 1 for t in tokens for n in TRADE_WORDS)


def _tokens_of(references: DataFrame) -> DataFrame:
    """(ref, token) of each reference's text and aliases, as ``split_name`` reads them, with beside: whether the text has two or three tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, text, aliases in zip(b["ref"], b["text"], b["aliases"]):
                own = split_name(text)[0]
                also = [t for x in (aliases if aliases is not None else ()) if x for t in split_name(x)[0]]
                long = [t for t in own if len(t) >= 2]
                rows.append((ref, sorted({*own, *also}), long if 2 <= len(long) <= 3 else []))
            yield pd.DataFrame(rows, columns=["ref", "tokens", "beside"])

    return references.select("ref", "text", "aliases").mapInPandas(read, "ref string, tokens array<string>, beside array<string>")


def _known_words(tokens: DataFrame) -> DataFrame:
    """(word, n): words that stand beside many others in ``tokens(beside)``, but for slips of far more frequent ones.

    The least number is fixed and slips are told by comparison, so the rule is the same at every size of the table.
    """
    never = sorted(LEGAL | TRADE_WORDS | PLACE_WORDS | {"field", "team", "ekstern", "dr", "mr", "ms"})
    pair = tokens.select(F.explode("beside").alias("word"), "beside").select("word", F.explode("beside").alias("y")).where("word <> y")
    often = pair.groupBy("word").agg(F.count_distinct("y").alias("n")).where((F.col("n") >= LEAST_BESIDE) & ~F.col("word").isin(never))
    often = stage(often, "often")
    a, b = (_keyed(often, "word").select("key", F.col("word").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    slip = a.hint("merge").join(b, "key").where((F.col("nb") >= FAR_MORE * F.col("na")) & (F.levenshtein("a", "b", 2) >= 0)).select(F.col("a").alias("word")).distinct()
    known = often.join(slip, "word", "left_anti").select("word", "n")
    full = tokens.sparkSession.createDataFrame([(w, 0) for w in sorted(_FULL_NAMES)], "word string, n long")
    return known.unionByName(full).groupBy("word").agg(F.max("n").alias("n"))


def _keyed(words: DataFrame, column: str) -> DataFrame:
    """``words`` with key: the word and all it becomes by leaving out a letter. Two words a slip apart share a key."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column), F.lit(1))), lambda i: F.concat(F.substring(column, F.lit(1), i - 1), F.substring(column, i + 1, F.length(column))))
    return words.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(column), cut))))


def _resolved(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(token, word): the known word that a token is, or the only one a slip away from a token of three letters or more."""
    each = stage(tokens.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    same = each.join(known.select(F.col("word").alias("token")), "token", "left_semi").select("token", F.col("token").alias("word"))
    open_ = each.join(known.select(F.col("word").alias("token")), "token", "left_anti").where(F.length("token") >= 3)
    near = _keyed(open_, "token").hint("merge").join(_keyed(known.select("word"), "word"), "key").select("token", "word").distinct().where(F.levenshtein("token", "word", 2) >= 0)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[[slips(t, w, 1) == 1 for t, w in zip(x["token"], x["word"])]]

    near = near.mapInPandas(check, "token string, word string").groupBy("token").agg(F.count("*").alias("n"), F.min("word").alias("word")).where("n = 1").select("token", "word")
    return same.unionByName(near)


def references_of(entities: DataFrame, items: DataFrame, sources: list[str]) -> DataFrame:
    """(ref, text, kind, aliases): every entity, and every distinct sender of ``sources`` but the owner ``me``."""
    own = entities.where("id IS NOT NULL AND canonical_name IS NOT NULL").select(F.concat(F.lit("e:"), F.col("id").cast("string")).alias("ref"), F.col("canonical_name").alias("text"), F.col("entity_type").alias("kind"), "aliases")
    senders = items.where(F.col("source").isin(sources) & F.col("sender").isNotNull() & (F.col("sender") != "me")).select("sender").distinct()
    return own.unionByName(senders.select(F.concat(F.lit("s:"), F.col("sender")).alias("ref"), F.col("sender").alias("text"), F.lit("").alias("kind"), F.lit(None).cast("array<string>").alias("aliases")))


def _read(references: DataFrame) -> DataFrame:
    """(ref, kind, word, initial, core, known): what each reference's text, or else an alias of it, says; known: whether the word is one."""
    tokens = stage(_tokens_of(references), "tokens_of")
    words = _resolved(tokens, stage(_known_words(tokens), "known"))
    # A reference's few tokens come back to it with their words; references and tokens meet by shuffle.
    own = tokens.select("ref", F.explode("tokens").alias("token")).join(words, "token").groupBy("ref").agg(F.collect_list("token").alias("tokens"), F.collect_list("word").alias("words"))
    references = references.join(own, "ref", "left")

    def parse(text: str, kind: str, words: Words) -> tuple[str, str, str, str] | None:
        tokens, login = split_name(text)
        if kind == "person" or not kind and not is_firm(tokens):
            found, kind = read_person(tokens, login, words), "person"
        elif kind == "place":
            found = read_firm(tokens, PLACE_WORDS)
        else:
            found, kind = read_firm(tokens, TRADE_WORDS), "organization"
        return found and (kind, *found)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, text, kind, aliases, tokens, known in zip(b["ref"], b["text"], b["kind"], b["aliases"], b["tokens"], b["words"]):
                own = Words(dict(zip(tokens, known)) if tokens is not None else {})
                found = None if _CODE.match(text.strip()) else parse(text, kind or "", own)
                if found is not None or aliases is None or not len(aliases):
                    rows.append((ref, 0, *(found or (kind or "", "", "", fold(text)))))
                for k, other in enumerate(sorted({x for x in aliases if x}) if aliases is not None else (), 1):
                    more = parse(other, kind or "", own)
                    if more is None and found is not None and slips(fold(other), found[3]) <= 2:
                        more = (found[0], found[1], found[2], fold(other))  # the core alone
                    if more and found is None and len(split_name(other)[0]) < 2:
                        more = None
                    # Aliases such as a first name alone are shared by many: only one that agrees with the text counts.
                    if more and (found is None or slips(more[3], found[3]) <= 2 and (not found[1] or not more[1] or found[1] == more[1]) and more[2][:1] == found[2][:1]):
                        rows.append((ref, k, *(more if more[1] or found is None else (more[0], found[1], more[2], more[3]))))
                if not rows or rows[-1][0] != ref:
                    rows.append((ref, 0, kind or "", "", "", fold(text)))
            yield pd.DataFrame(rows, columns=["ref", "place", "kind", "word", "initial", "core"])

    said = stage(references.mapInPandas(read, "ref string, place int, kind string, word string, initial string, core string"), "said")
    # Of an entity's own spellings, the one that most references share stands for it: a slip seldom occurs twice.
    weight = said.groupBy("kind", "word", "core").agg(F.count_distinct("ref").alias("weight"))
    best = F.struct((F.col("word") != "").alias("named"), "weight", -F.col("place"), "kind", "word", "initial", "core")
    best = said.join(weight, ["kind", "word", "core"]).groupBy("ref").agg(F.max(best).alias("f")).select("ref", "f.kind", "f.word", "f.initial", "f.core")
    return best.join(words.where("token = word").select("word", F.lit(True).alias("known")), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The number of bands that finds a pair of that similarity with that probability, by the collision curve."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


_BANDS = bands_for(SLIP, RECALL, ROWS)


def left_out(core: str, most: int) -> set[str]:
    """``core`` with up to ``most`` letters left out. Two words ``most`` slips apart, a swap being one, share one of these."""
    out = last = {core}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _signatures(most: int | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Forms by the keys at which they meet. ``most``: slips to be found; None: as many as ``_verified`` allows at a core's length."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(11)
        mult = rng.integers(1, 1 << 62, (_BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 62, (_BANDS * ROWS, 1), dtype=np.uint64)
        for b in batches:
            forms, out = [], []
            for form, salt, core in zip(b["form"], b["salt"], b["core"]):
                seed = xxhash.xxh64_intdigest(salt)
                found = []
                if len(core) <= LONG + MOST_SLIPS:  # with room for a partner that is longer by the slips
                    n = min(MOST_SLIPS, len(core) // LETTERS_A_SLIP) if most is None else most
                    found += [xxhash.xxh64_intdigest(w, seed=seed) >> 1 for w in left_out(core, n)]
                if len(core) > LONG:
                    padded = "#" * (GRAM - 1) + core + "#" * (GRAM - 1)
                    grams = np.array([xxhash.xxh64_intdigest(padded[i : i + GRAM]) for i in range(len(padded) - GRAM + 1)], np.uint64)
                    least = ((grams * mult + plus) >> np.uint64(8)).min(1).reshape(_BANDS, ROWS)
                    found += [xxhash.xxh64_intdigest(row.tobytes(), seed=(seed + n) % (1 << 63)) >> 1 for n, row in enumerate(least, 1)]
                forms += [form] * len(found)
                out += found
            yield pd.DataFrame({"form": np.array(forms, object), "band": np.array(out, np.int64)})

    return keys


def _whole_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms by MinHash bands over the padded q-grams of their whole names, in either order of word and core."""
    bands = bands_for(NAME_SLIP, RECALL, NAME_ROWS)
    rng = np.random.default_rng(17)
    mult = rng.integers(1, 1 << 62, (bands * NAME_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 62, (bands * NAME_ROWS, 1), dtype=np.uint64)
    pad = "#" * (GRAM - 1)
    for b in batches:
        forms, out = [], []
        for form in b["form"]:
            kind, word, core = form.split("|")
            grams = {x[i : i + GRAM] for x in (f"{pad}{word}{pad}", f"{pad}{core}{pad}") for i in range(len(x) - GRAM + 1)}
            hashes = np.array([xxhash.xxh64_intdigest(g) for g in sorted(grams)], np.uint64)
            least = ((hashes * mult + plus) >> np.uint64(8)).min(1).reshape(bands, NAME_ROWS)
            seed = xxhash.xxh64_intdigest(kind)
            forms += [form] * bands
            out += [xxhash.xxh64_intdigest(row.tobytes(), seed=(seed + n) % (1 << 63)) >> 1 for n, row in enumerate(least)]
        yield pd.DataFrame({"form": np.array(forms, object), "band": np.array(out, np.int64)})


def _alike(full: DataFrame) -> DataFrame:
    """(a, b) forms whose whole names share a band, of which at least one has a word that is not known: an unknown nickname or a word of several slips."""
    bands = full.select("form").mapInPandas(_whole_names, "form string, band long")
    odd = full.where("NOT known").select("form").distinct()
    pairs = bands.join(odd, "form", "left_semi").select("band", F.col("form").alias("x")).hint("merge").join(bands.select("band", F.col("form").alias("y")), "band").where("x <> y")
    core = lambda c: F.element_at(F.split(F.col(c), r"\|"), -1)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().where(F.levenshtein(core("a"), core("b"), 4) >= 0)


def _near(left: DataFrame, right: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b) pairs of forms whose cores share a key and, by their letters, may be the same; ``left(form, salt, core)``."""
    one = left.mapInPandas(_signatures(most), "form string, band long")
    other = one if right is None else right.mapInPandas(_signatures(most), "form string, band long")
    # A form becomes many keys, which Spark's size estimate does not see: without the hint it would broadcast them.
    pairs = one.select("band", F.col("form").alias("a")).hint("merge").join(other.select("band", F.col("form").alias("b")), "band")
    if right is None:
        pairs = pairs.where("a < b")
    core = lambda c: F.element_at(F.split(F.col(c), r"\|"), -1)
    # A swap of neighbours counts two here and one below.
    return pairs.select("a", "b").distinct().where(F.levenshtein(core("a"), core("b"), 4) >= 0)


def _verified(pairs: DataFrame) -> DataFrame:
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for a, b in zip(p["a"], p["b"]):
                x, y = a.split("|"), b.split("|")
                n = slips(x[-1], y[-1])
                if n <= MOST_SLIPS and n <= min(len(x[-1]), len(y[-1])) // LETTERS_A_SLIP and monge_elkan([t for t in x[1:] if t], [t for t in y[1:] if t]) >= SAME:
                    rows.append((a, b, n))
            yield pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"n": "int32"})

    return pairs.mapInPandas(check, "a string, b string, n int")


def _gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with the slips between their cores."""
    for p in batches:
        yield p[["a", "b"]].assign(n=np.array([slips(a.split("|")[-1], b.split("|")[-1]) for a, b in zip(p["a"], p["b"])], np.int32))


def stars(forms: DataFrame, edges: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(form, centre): star clustering of ``forms(form, weight)`` over ``edges(a, b, n)``.

    In each round, forms that outweigh all undecided neighbours become centres and their neighbours
    satellites. A slip seldom occurs twice, so two forms that several references share each are two
    names; edges of two slips bind only to a centre of more weight. A satellite joins its nearest
    centre, the heavier one first, then by text. Raises if ``most_rounds`` were not enough.
    """
    w = forms.select("form", "weight")
    both = edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    both = both.join(w.withColumnsRenamed({"form": "a", "weight": "wa"}), "a").join(w.withColumnsRenamed({"form": "b", "weight": "wb"}), "b")
    apart = (F.least("wa", "wb") > 1) | ((F.col("n") > 1) & (F.col("wa") == F.col("wb")))
    both = stage(both.where(~apart), "links")
    state = stage(w.join(both.select(F.col("a").alias("form")).distinct(), "form").withColumn("is_centre", F.lit(None).cast("boolean")), "state")
    for _ in range(most_rounds):
        open_ = state.where("is_centre IS NULL").select("form")
        if open_.isEmpty():
            break
        live = both.join(open_.withColumnRenamed("form", "a"), "a", "left_semi").join(open_.withColumnRenamed("form", "b"), "b", "left_semi")
        beaten = live.where((F.col("wb") > F.col("wa")) | ((F.col("wb") == F.col("wa")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("form")).distinct()
        new = open_.join(beaten, "form", "left_anti")
        covered = both.join(new.withColumnRenamed("form", "b"), "b", "left_semi").select(F.col("a").alias("form")).distinct()
        marks = new.withColumn("now", F.lit(True)).unionByName(covered.join(new, "form", "left_anti").withColumn("now", F.lit(False)))
        state = stage(state.join(marks, "form", "left").select("form", "weight", F.coalesce("is_centre", "now").alias("is_centre")), "state")
    else:
        raise RuntimeError(f"stars are not settled after {most_rounds} rounds")
    centres = state.where("is_centre").select(F.col("form").alias("b"))
    order = Window.partitionBy("a").orderBy("n", F.desc("wb"), "b")
    bound = both.join(state.where("NOT is_centre").select(F.col("form").alias("a")), "a", "left_semi").join(centres, "b", "left_semi")
    bound = bound.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("a").alias("form"), F.col("b").alias("centre"))
    return forms.select("form").join(bound, "form", "left").select("form", F.coalesce("centre", "form").alias("centre"))


def clusters(references: DataFrame) -> DataFrame:
    """(ref, cluster) of ``references(ref, text, kind, aliases)``.

    References of equal form are folded into one before any pair is made, so copies cost nothing. A form
    with an initial joins the one cluster that has its core, within a slip, and a word of that initial; where
    several fit, none is chosen. Null kinds are guessed from the text; texts that cannot be read stand alone
    with their equals. Null and empty aliases say nothing.
    """
    refs = stage(_read(references), "references")
    form = F.concat_ws("|", "kind", "word", "core")
    short = F.concat_ws("|", "kind", "initial", "core")
    has_word = (F.col("word") != "") | (F.col("kind") != "person")
    full = stage(refs.where(has_word).groupBy(form.alias("form"), F.concat_ws("|", "kind", "word").alias("salt"), "core", "kind", "word", "known", "initial").agg(F.count("*").alias("weight"))
                 .groupBy("form", "salt", "core", "kind", "word", "known").agg(F.min("initial").alias("initial"), F.sum("weight").alias("weight")), "forms")
    people = full.where("kind = 'person' AND word <> ''")
    pairs = _near(full.select("form", "salt", "core")).unionByName(_alike(people)).distinct()
    centre = stage(stars(full, stage(_verified(pairs), "edges")), "stars")
    by_letter = F.concat_ws("|", "kind", F.substring(F.split_part("form", F.lit("|"), F.lit(2)), 1, 1))
    people = full.where("kind = 'person'").select("form", by_letter.alias("salt"), "core")
    cut = refs.where(~has_word).select(short.alias("form"), F.concat_ws("|", "kind", "initial").alias("salt"), "core").distinct()
    fits = _near(cut, people, 1).mapInPandas(_gaps, "a string, b string, n int").where("n <= 1").join(centre.select(F.col("form").alias("b"), "centre"), "b")
    # The exact core counts before one a slip away.
    best = fits.groupBy("a", "centre").agg(F.min("n").alias("n"))
    best = best.withColumn("least", F.min("n").over(Window.partitionBy("a"))).where("n = least").groupBy("a").agg(F.count("*").alias("k"), F.min("centre").alias("centre")).where("k = 1")
    joined = refs.where(~has_word).withColumn("a", short).join(best.select("a", "centre"), "a", "left").select("ref", F.coalesce("centre", "a").alias("cluster"))
    return refs.where(has_word).withColumn("form", form).join(centre, "form").select("ref", F.col("centre").alias("cluster")).unionByName(joined)


def variant_pairs(entities: DataFrame, items: DataFrame, sources: list[str]) -> DataFrame:
    """(ref_a, ref_b): all pairs of references to one entity, the smaller string first."""
    own = stage(clusters(references_of(entities, items, sources)), "clusters").distinct()
    return own.select(F.col("ref").alias("ref_a"), "cluster").join(own.select(F.col("ref").alias("ref_b"), "cluster"), "cluster").where("ref_a < ref_b").select("ref_a", "ref_b")
