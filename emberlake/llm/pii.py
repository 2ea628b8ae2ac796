"""Personal data in free text, by a skip-chain conditional random field.

A text's tokens form a chain; tokens that are equal, or numbers of one shape, are linked besides, wherever
they stand. Loopy message passing over chain and skip edges makes their labels agree. The weights of both are
trained here, on labels that strict patterns give to a bounded sample of texts; names known as first names
and the endings of surnames come from the entities table. Each task trains on a part of the sample, in which a part of the
names counts as unknown, so that context and links have to tell them; the parts' weights are averaged
between rounds. All texts are decoded, in batches, in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.bits import among, bit_table
from emberlake.session import stage
from emberlake.tables import distinct_items

LABELS = ["O", "email", "phone", "id_number", "address", "+address", "person_name", "+person_name"]
KINDS = ["email", "phone", "id_number", "address", "person_name"]
#: Texts that the fit takes at most, by smallest hash; every text is then labelled.
MOST_TEXTS = 8000
#: First names and four-letter endings of surnames are known that so many entities have.
LEAST_NAMES, LEAST_ENDINGS = 3, 3
#: Parts of the sample that are trained apart, rounds between which their weights are averaged, and passes of each over its part.
PARTS, MIXES, EPOCHS = 8, 2, 12
RATE, DECAY, BATCH = 0.3, 2e-5, 32
#: Steps, their length and the shrinking of the fit of the skip potentials; rounds of message passing.
SKIP_STEPS, SKIP_RATE, SKIP_DECAY, ROUNDS = 60, 0.5, 1e-3, 3
ROLES = (-2, -1, 0, 1, 2)

# Words that make a street, in English and Norwegian.
STREET_WORDS = "lane avenue road street drive way close court square terrace hill place"
STREET_ENDINGS = "veien vegen vei bakken gata gaten gate allé stien svingen plassen tunet"
TITLES = {"mr", "mrs", "ms", "dr", "prof", "fru", "herr"}

_EMAIL = r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+"
_SPELLED = r"[\w+-]+(?:\.[\w+-]+)* ?(?:(?:\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[\w-]+)+|at [\w-]+(?: dot [\w-]+)+)"
_NUMBER = r"\+?\d+(?: ?\(\d+\))?(?:[ ./-]\d+)*(?:[A-Za-z](?![^\W_]))?"
_TOKEN = re.compile(rf"(?P<e>{_EMAIL})|(?P<s>{_SPELLED})|(?P<n>{_NUMBER})|(?P<w>[^\W\d_]+(?:['’][^\W\d_]+)*)|(?P<p>\n|[^\s])", re.I)
_SPLIT_NUMBER = re.compile(r"[ /]")
#: The shapes of numbers: 9 for a digit.
_PHONES = re.compile(r"^(?:\+9[9 ()-]{6,18}9|9{3}-9{3}-9{4}|009{8,13}|079{3} 9{6}|099-9{3} 99 99|99 99 99 99)$")
_LEADS = [("00", re.compile(r"00\d{8,13}")), ("07", re.compile(r"07\d{3} \d{6}")), ("0", re.compile(r"0\d\d-\d{3} \d\d \d\d"))]
_IDS = re.compile(r"^(?:9{11}|9{6} 9{5}|9{3}-9{2}-9{4})$")
_STREET = rf"(?:\d+ ?[A-Z]? [^\W\d_]+ (?:{STREET_WORDS.replace(' ', '|')})|[^\W\d_]+(?:{STREET_ENDINGS.replace(' ', '|')}) \d+(?: ?[A-Z])?)\b(?:, (?:\d{{4,5}} )?(?-i:[A-ZÆØÅ][^\W\d_]+))?"
_ADDRESS = re.compile(rf"(?<![\w.:-]){_STREET}", re.I)


def shape_of(number: str) -> str:
    """A number with each digit as 9, but for the leading digits that make it a phone number."""
    keep = next((len(k) for k, form in _LEADS if form.fullmatch(number)), 0)
    return number[:keep] + re.sub(r"\d", "9", number[keep:])


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each token: e mail address, s one spelled out, n number, w word, p other sign."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "n" and not (_PHONES.match(shape_of(m[0])) or _IDS.match(shape_of(m[0]))):
            at = m.start()
            for part in re.split(r"([ /])", m[0]):  # groups that make up no known number stand alone
                if part.strip(" /"):
                    out.append((at, at + len(part), "n"))
                at += len(part)
        else:
            out.append((m.start(), m.end(), kind))
    return out


class HashedWords:
    """A set of words as a bit table."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __contains__(self, word: str) -> bool:
        return bool(among(np.array([xxhash.xxh64_intdigest(word, 42)], np.uint64), self.packed)[0])


class Names:
    """First names and surname endings, as learnt from the entities; ``hidden``: names of this part of PARTS count as unknown."""

    def __init__(self, first, endings, hidden: int | None = None):
        self.first, self.endings, self.hidden = first, endings, hidden

    def _knows(self, word: str) -> bool:
        return self.hidden is None or xxhash.xxh64_intdigest(word) % PARTS != self.hidden

    def is_first(self, word: str) -> bool:
        return word.lower() in self.first and self._knows(word.lower())

    def is_surname(self, word: str) -> bool:
        return len(word) >= 5 and word.lower()[-4:] in self.endings and word.lower() not in self.first and self._knows(word.lower())


def learn_names(entities: DataFrame) -> Names:
    """From person entities that are not denied: words that stand first, and endings of words that stand last, in enough names."""
    person = entities.where("entity_type = 'person' AND coalesce(pending_review, 0) <> 2 AND canonical_name IS NOT NULL")
    words = F.filter(F.split(F.lower("canonical_name"), r"[^\p{L}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(list(TITLES)))
    plain = person.where(~F.col("canonical_name").contains(",")).select(words.alias("w")).where(F.size("w").between(2, 3))
    ends = plain.select(F.explode(F.array(
        F.struct(F.col("w")[0].alias("x"), F.element_at("w", -1).alias("other"), F.lit(1).alias("first")),
        F.struct(F.element_at("w", -1).alias("x"), F.col("w")[0].alias("other"), F.lit(0).alias("first")),
    )).alias("e")).select("e.*")
    leads, follows = F.count_distinct(F.when(F.col("first") == 1, F.col("other"))), F.count_distinct(F.when(F.col("first") == 0, F.col("other")))
    first = ends.groupBy("x").agg(leads.alias("n"), follows.alias("m")).where((F.col("n") >= LEAST_NAMES) & (F.col("n") > 2 * F.col("m")))
    # Names are also typed surname first: an ending counts if it mostly stands last.
    last = ends.where(F.length("x") >= 5).groupBy(F.substring("x", -4, 4).alias("x")).agg(F.count_if(F.col("first") == 0).alias("n"), F.count_if(F.col("first") == 1).alias("m"))
    last = last.where((F.col("n") >= LEAST_ENDINGS) & (F.col("n") > 2 * F.col("m")))

    def hashed(df: DataFrame) -> HashedWords:
        seeds = stage(df.select(F.xxhash64("x").alias("seed")), "names")
        return HashedWords(bit_table(seeds, seeds.count()))

    return Names(hashed(first), hashed(last))


def token_type(text: str, kind: str) -> str:
    """What tokens are told apart by: words by spelling, numbers by shape, addresses not at all."""
    return f"n:{shape_of(text)}" if kind == "n" else kind if kind in "es" else text


def type_features(token: str, names: Names) -> list[str]:
    if token in ("e", "s") or token.startswith("n:"):
        shape = token[2:]
        phone, ident = bool(shape and _PHONES.match(shape)), bool(shape and _IDS.match(shape))
        house = bool(re.fullmatch(r"\d{1,3}[A-Za-z]?", shape))
        return [f"kind={token[0]}", f"phone={phone}", f"id={ident}", f"house={house}", f"code={shape == '9999'}", f"{phone}{ident}{house}"]
    if not token[0].isalpha():
        return [f"sign={token}"]
    low = token.lower()
    case = "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l"
    first, last = names.is_first(token), names.is_surname(token)
    street = "word" if low in STREET_WORDS.split() else "end" if low.endswith(tuple(STREET_ENDINGS.split())) and len(low) > 6 else ""
    return [f"word={low}", f"case={case}", f"first={first}", f"last={last}", f"street={street}", f"len={min(len(token), 5)}", f"{case}{first}{last}{street}"]


def pattern_spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Strict patterns: the labels that the fit learns from. Spans do not overlap."""
    out: list[tuple[int, int, str]] = []
    tokens = tokens_of(text)
    for a, b, kind in tokens:
        if kind in "es":
            out.append((a, b, "email"))
        elif kind == "n":
            shape = shape_of(text[a:b])
            if _IDS.match(shape):
                out.append((a, b, "id_number"))
            elif _PHONES.match(shape):
                out.append((a, b, "phone"))
    taken = [(a, b) for a, b, _ in out]
    for m in _ADDRESS.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            out.append((m.start(), m.end(), "address"))
            taken.append((m.start(), m.end()))
    words = [(a, b, text[a:b], kind) for a, b, kind in tokens]
    k = 0
    while k < len(words):
        a, b, w, kind = words[k]
        end = None
        if kind == "w" and names.is_first(w):
            j = k + 1
            if j + 1 < len(words) and re.fullmatch(r"[A-Z]", words[j][2]) and words[j + 1][2] == ".":
                j += 2
            if j < len(words) and words[j][3] == "w" and names.is_surname(words[j][2]) and words[j][2].islower() == w.islower():
                end = j
        elif kind == "w" and names.is_surname(w) and k + 2 < len(words) and words[k + 1][2] == "," and names.is_first(words[k + 2][2]) and w[0].isupper() and words[k + 2][2][0].isupper():
            end = k + 2
        if end is not None and not any(x < words[end][1] and a < y for x, y in taken):
            out.append((a, words[end][1], "person_name"))
            k = end
        k += 1
    return sorted(out)


def _labels(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> list[int]:
    out = []
    for a, b, _ in tokens:
        hit = next(((x, k) for x, y, k in spans if x <= a and b <= y), None)
        out.append(0 if hit is None else LABELS.index(hit[1] if hit[0] == a or f"+{hit[1]}" not in LABELS else f"+{hit[1]}"))
    return out


def _pad(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _unary(tables: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores (text, place, label) from ``tables`` (role, type, label); type 0 is the space around a text."""
    b, t = ids.shape
    wide = np.zeros((b, t + 4), np.int64)
    wide[:, 2:-2] = ids
    return sum(tables[k][wide[:, 2 + r : 2 + r + t]] for k, r in enumerate(ROLES))


def _chain(unary: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages and marginals of each place; places that are not ``real`` pass messages on."""
    b, t, n = unary.shape
    u = np.exp(unary - unary.max(2, keepdims=True))
    e = np.exp(trans)
    fw, bw = np.ones((b, t, n)), np.ones((b, t, n))
    for k in range(1, t):
        m = (fw[:, k - 1] * u[:, k - 1]) @ e
        fw[:, k] = np.where(real[:, k, None], m / m.sum(1, keepdims=True), 1.0)
    for k in range(t - 2, -1, -1):
        m = (bw[:, k + 1] * u[:, k + 1]) @ e.T
        bw[:, k] = np.where(real[:, k + 1, None], m / m.sum(1, keepdims=True), 1.0)
    p = fw * u * bw
    return fw * u, bw * u, p / p.sum(2, keepdims=True)


class Field:
    """A trained field: type tables made from feature weights, transitions, skip potentials, names."""

    def __init__(self, weights: np.ndarray, features: dict[str, int], trans: np.ndarray, skip: np.ndarray, names: Names):
        self.weights, self.features, self.trans, self.skip, self.names = weights, features, trans, skip, names
        self.types: dict[str, int] = {}
        self.tables = np.zeros((len(ROLES), 1024, len(LABELS)))
        self._row("")

    def _row(self, token: str) -> int:
        at = self.types.setdefault(token, len(self.types))
        if at == self.tables.shape[1]:
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], 1)
        own = [self.features[f] for f in (type_features(token, self.names) if token else ["space"]) if f in self.features]
        self.tables[:, at] = self.weights[:, own].sum(1)
        return at

    def ids(self, types: list[str]) -> np.ndarray:
        if len(self.types) > 200_000:
            self.types.clear()
            self._row("")
        return np.array([self.types[x] if x in self.types else self._row(x) for x in types], np.int64)

    @staticmethod
    def _links(types: list[str]) -> list[tuple[int, int]]:
        """Skip edges: each token and the next one equal to it but for case, signs and frequent short words aside."""
        last: dict[str, int] = {}
        out = []
        for k, x in enumerate(types):
            if len(x) > 3 or x in "es":
                if x.lower() in last:
                    out.append((last[x.lower()], k))
                last[x.lower()] = k
        return out

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The most probable label of each token of each text, given as types."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            longest = len(texts[order[min(at + 1024, len(order)) - 1]])
            part = order[at : at + max(1, min(1024, 100_000 // max(1, longest)))]
            at += len(part)
            rows = [self.ids(texts[k]) for k in part]
            ids = _pad(rows, 0)
            real = np.arange(ids.shape[1]) < np.array([len(r) for r in rows])[:, None]
            base = _unary(self.tables, ids)
            edges = [(n, i, j) for n, k in enumerate(part) for i, j in self._links(texts[k])]
            p = _chain(base, self.trans, real)[2]
            if edges:
                n, i, j = np.array(edges).T
                to_i = np.zeros((len(n), len(LABELS)))
                to_j = np.zeros_like(to_i)
                favour = np.exp(self.skip)
                for _ in range(ROUNDS):
                    new_j = np.log((p[n, i] * np.exp(-to_i)) @ favour + 1e-12)
                    new_i = np.log((p[n, j] * np.exp(-to_j)) @ favour + 1e-12)
                    to_j, to_i = new_j - new_j.mean(1, keepdims=True), new_i - new_i.mean(1, keepdims=True)
                    unary = base.copy()
                    np.add.at(unary, (n, j), to_j)
                    np.add.at(unary, (n, i), to_i)
                    p = _chain(unary, self.trans, real)[2]
            best = p.argmax(2)
            for r, k in enumerate(part):
                out[k] = best[r, : len(texts[k])]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) of the personal data in each text."""
        tokens = [tokens_of(t) for t in texts]
        labels = self.label([[token_type(t[a:b], k) for a, b, k in ts] for t, ts in zip(texts, tokens)])
        return [self._joined(t, ts, y) for t, ts, y in zip(texts, tokens, labels)]

    def _joined(self, text: str, tokens: list[tuple[int, int, str]], labels: np.ndarray) -> list[tuple[int, int, str]]:
        out = []
        k = 0
        while k < len(tokens):
            kind = LABELS[labels[k]].lstrip("+")
            end = k + 1
            if kind != "O":
                while end < len(tokens) and LABELS[labels[end]] == f"+{kind}":
                    end += 1
                while end > k and tokens[end - 1][2] == "p":
                    end -= 1
                if end > k and self.holds(kind, text, tokens[k:end]):
                    out.append((tokens[k][0], tokens[end - 1][1], kind))
                end = max(end, k + 1)
            k = end
        return out

    def holds(self, kind: str, text: str, tokens: list[tuple[int, int, str]]) -> bool:
        """Exact check of a labelled span: the form that its kind must have."""
        first = text[tokens[0][0] : tokens[0][1]]
        if kind == "email":
            return tokens[0][2] in "es"
        if kind in ("phone", "id_number"):
            return tokens[0][2] == "n" and bool((_PHONES if kind == "phone" else _IDS).match(shape_of(first)))
        words = [text[a:b] for a, b, k in tokens if k == "w"]
        if kind == "address":
            return len(words) >= 1 and any(k == "n" for _, _, k in tokens) and any(w.lower() in STREET_WORDS.split() or w.lower().endswith(tuple(STREET_ENDINGS.split())) for w in words)
        return len([w for w in words if len(w) > 1]) >= 2


def fit_field(texts: list[str], names: Names, seen_as: Names | None = None, start: Field | None = None) -> Field:
    """Train on pattern labels: the chain by stochastic gradient ascent of its likelihood, then the skip potentials.

    The labels know all ``names``, the features those of ``seen_as``. Weights begin with those of ``start``.
    """
    seen_as = seen_as or names
    tokens = [tokens_of(t) for t in texts]
    keep = [k for k, ts in enumerate(tokens) if ts]
    types = [[token_type(texts[k][a:b], kind) for a, b, kind in tokens[k]] for k in keep]
    gold = [np.array(_labels(tokens[k], pattern_spans(texts[k], names))) for k in keep]
    vocabulary = {"": 0}
    for row in types:
        for x in row:
            vocabulary.setdefault(x, len(vocabulary))
    own = [type_features(x, seen_as) if x else ["space"] for x in vocabulary]
    seen = Counter(f for fs in own for f in fs)
    features: dict[str, int] = {}
    for fs in own:
        for f in fs:
            # A word seen in one form only and ending as a surname would teach the name itself.
            if not (f.startswith("word=") and (names.is_surname(f[5:]) or names.is_first(f[5:]))) and seen[f]:
                features.setdefault(f, len(features))
    type_at = np.array([k for k, fs in enumerate(own) for f in fs if f in features])
    feature_at = np.array([features[f] for fs in own for f in fs if f in features])
    n = len(LABELS)
    weights, trans = np.zeros((len(ROLES), len(features), n)), np.zeros((n, n))
    if start is not None:
        trans = start.trans.copy()
        both = [f for f in features if f in start.features]
        weights[:, [features[f] for f in both]] = start.weights[:, [start.features[f] for f in both]]
    square_w, square_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    rows = [np.array([vocabulary[x] for x in row]) for row in types]
    order = np.argsort([len(r) for r in rows], kind="stable")
    batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for at in rng.permutation(len(batches)):
            part = batches[at]
            ids, y = _pad([rows[k] for k in part], 0), _pad([gold[k] for k in part], 0)
            real = np.arange(ids.shape[1]) < np.array([len(rows[k]) for k in part])[:, None]
            tables = np.zeros((len(ROLES), len(vocabulary), n))
            for r in range(len(ROLES)):
                np.add.at(tables[r], type_at, weights[r][feature_at])
            fw, bw, p = _chain(_unary(tables, ids), trans, real)
            g = (np.eye(n)[y] - p) * real[..., None]
            grad_w = np.zeros_like(weights)
            wide = np.zeros((ids.shape[0], ids.shape[1] + 4), np.int64)
            wide[:, 2:-2] = ids
            for k, r in enumerate(ROLES):
                by_type = np.zeros((len(vocabulary), n))
                np.add.at(by_type, wide[:, 2 + r : 2 + r + ids.shape[1]].ravel(), g.reshape(-1, n))
                np.add.at(grad_w[k], feature_at, by_type[type_at])
            pairs = fw[:, :-1, :, None] * np.exp(trans) * bw[:, 1:, None, :]
            pairs /= pairs.sum((2, 3), keepdims=True)
            hard = np.eye(n)[y[:, :-1]][..., None] * np.eye(n)[y[:, 1:]][:, :, None, :]
            grad_t = ((hard - pairs) * real[:, 1:, None, None]).sum((0, 1))
            grad_w -= DECAY * len(part) * weights
            square_w += grad_w**2
            square_t += grad_t**2
            weights += RATE * grad_w / np.sqrt(square_w)
            trans += RATE * grad_t / np.sqrt(square_t)
    field = Field(weights, features, trans, np.zeros((n, n)), seen_as)
    field.skip = _fit_skip(field, types, gold)
    field.names = names
    return field


def _fit_skip(field: Field, types: list[list[str]], gold: list[np.ndarray]) -> np.ndarray:
    """Skip potentials, symmetric, by pseudo-likelihood: each end's label given the chain's belief and the other end's label.

    Potentials shrink to zero, so links say only what the chain does not know.
    """
    n = len(LABELS)
    belief, mine, other = [], [], []
    for k in range(0, len(types), 256):
        part = range(k, min(k + 256, len(types)))
        ids = _pad([field.ids(types[j]) for j in part], 0)
        p = _chain(_unary(field.tables, ids), field.trans, np.arange(ids.shape[1]) < np.array([len(types[j]) for j in part])[:, None])[2]
        for row, j in enumerate(part):
            for a, b in field._links(types[j]):
                for x, y in ((a, b), (b, a)):
                    belief.append(p[row, x])
                    mine.append(gold[j][x])
                    other.append(gold[j][y])
    skip = np.zeros((n, n))
    if belief:
        base, want, other = np.log(np.array(belief) + 1e-12), np.eye(n)[mine], np.array(other)
        for _ in range(SKIP_STEPS):
            s = base + skip[other]
            q = np.exp(s - s.max(1, keepdims=True))
            grad = np.zeros((n, n))
            np.add.at(grad, other, want - q / q.sum(1, keepdims=True))
            grad = (grad + grad.T) / 2 / max(1, len(mine)) ** 0.5 - SKIP_DECAY * skip
            skip += SKIP_RATE * grad
    return skip


def _texts(items: DataFrame) -> DataFrame:
    return distinct_items(items, "source", "source_id", "content", "recipients").select("id", "content", "recipients")


def fit(items: DataFrame, entities: DataFrame, most_texts: int = MOST_TEXTS) -> Field:
    """A field trained on at most ``most_texts`` distinct contents and recipients, three of four contents, by smallest hash.

    PARTS tasks train at once, each on its part of the texts; weights are averaged over the parts that have them.
    """
    names = learn_names(entities)
    some = lambda column, n: column.where("length(t) BETWEEN 3 AND 400").distinct().orderBy(F.xxhash64("t"), "t").limit(n)
    contents = some(items.select(F.col("content").alias("t")).where(F.col("t").rlike(r"\d{3}|\d\d \d\d|@|\bdot\b|\p{Lu}\p{L}+,? \p{Lu}|\p{L}{4} \d")), most_texts * 3 // 4)
    others = some(items.select(F.explode("recipients").alias("t")).where("NOT t RLIKE '^(me|u[0-9]+|grp:.*)$'"), most_texts // 4)
    sample = stage(contents.unionByName(others).distinct().withColumn("part", F.pmod(F.xxhash64("t", F.lit(3)), F.lit(PARTS)).cast("int")), "sample")
    field = Field(np.zeros((len(ROLES), 0, len(LABELS))), {}, np.zeros((len(LABELS),) * 2), np.zeros((len(LABELS),) * 2), names)
    for _ in range(MIXES):
        field = _mixed(sample, field)
    return field


def _mixed(sample: DataFrame, start: Field) -> Field:
    """One round: every part trains from ``start``, then each weight is averaged in Spark."""
    shared = sample.sparkSession.sparkContext.broadcast(start)
    size = len(ROLES) * len(LABELS)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        old = shared.value
        seen_as = Names(old.names.first, old.names.endings, int(rows["part"].iloc[0]))
        new = fit_field(sorted(rows["t"]), old.names, seen_as, old if old.features else None)
        square = [(kind, k, row) for kind, m in (("trans", new.trans), ("skip", new.skip)) for k, row in enumerate(m.tolist())]
        names = [(f"f:{f}", 0, new.weights[:, k].ravel().tolist()) for f, k in new.features.items()]
        return pd.DataFrame([*square, *names], columns=["name", "k", "w"])

    rows = sample.repartition(PARTS, "part").groupBy("part").applyInPandas(train, "name string, k int, w array<double>")
    mean = rows.groupBy("name", "k").agg(*[F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(size)])
    found = mean.orderBy("name", "k").toPandas()  # as many rows as the sample has features
    values, at = found[[f"w{i}" for i in range(size)]].to_numpy(float), found["name"].to_numpy()
    is_feature = np.array([x.startswith("f:") for x in at], bool)
    features = {x[2:]: k for k, x in enumerate(at[is_feature])}
    weights = values[is_feature].reshape(-1, len(ROLES), len(LABELS)).transpose(1, 0, 2)
    square = lambda kind, old: values[at == kind][:, : len(LABELS)] if (at == kind).any() else old
    return Field(np.ascontiguousarray(weights), features, square("trans", start.trans), square("skip", start.skip), start.names)


def find(items: DataFrame, entities: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """(item_id, field_name, pii_kind, found_text): each personal datum of an item's content and recipients, once.

    found_text is copied from the text. Null contents and recipients hold nothing; an empty entities table
    leaves names unknown. Texts are labelled one by one, so no key can be hot; the trained field sent to the
    tasks is bounded by ``most_texts``.
    """
    field = items.sparkSession.sparkContext.broadcast(fit(items, entities, most_texts))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, of = [], []
            for item, content, recipients in zip(b["id"], b["content"], b["recipients"]):
                if content:
                    texts.append(content)
                    of.append((item, "content"))
                for r in recipients if recipients is not None else ():
                    if r:
                        texts.append(r)
                        of.append((item, "recipients"))
            rows = {(*o, kind, t[x:y]) for o, t, found in zip(of, texts, field.value.spans(texts)) for x, y, kind in found}
            yield pd.DataFrame(sorted(rows), columns=["item_id", "field_name", "pii_kind", "found_text"], dtype=object)

    return _texts(items).mapInPandas(label, "item_id string, field_name string, pii_kind string, found_text string")


def redact(items: DataFrame, entities: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """(item_id, content, recipients) with each personal datum replaced by its kind in square brackets."""
    field = items.sparkSession.sparkContext.broadcast(fit(items, entities, most_texts))

    def masked(text: str, found: list[tuple[int, int, str]]) -> str:
        for x, y, kind in reversed(found):
            text = f"{text[:x]}[{kind.upper()}]{text[y:]}"
        return text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = [c or "" for c in b["content"]]
            lists = [[x or "" for x in r] if r is not None else [] for r in b["recipients"]]
            spans = iter(field.value.spans(contents + [x for r in lists for x in r]))
            text = [masked(c, next(spans)) for c in contents]
            others = [[masked(x, next(spans)) for x in r] for r in lists]
            yield pd.DataFrame({"item_id": b["id"], "content": [None if c is None else t for c, t in zip(b["content"], text)], "recipients": others})

    return _texts(items).mapInPandas(cut, "item_id string, content string, recipients array<string>")
