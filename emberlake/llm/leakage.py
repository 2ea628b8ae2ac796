"""Corpus documents that contain passages of held-out test items, by spaced-seed hashing.

Fixed masks pick word positions and ignore others; a window of words is hashed over the picked positions
only, so a changed word at an ignored one does no harm. Windows of the corpus that share a hash with a
window of a test item make candidate pairs, and each pair is verified around its hits with tolerance for
single words changed, added or lost.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.bits import among, bit_table
from emberlake.session import stage

#: Picked (1) and ignored (0) positions. Weight 8: chance hits stay rare in templated prose.
MASKS = ("11111111", "111101111", "11101110011")
LEAST_WORDS = 15
#: Words of a row between two edits that the chain of runs is made of, and how far apart two runs may be.
RUN, GAP, SHIFT = 4, 6, 2
#: Share of matched words in a passage with edits.
DENSITY = 0.7
#: A first line that opens so many test items is a stock instruction.
STOCK_ITEMS = 3

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_known: dict[str, int] = {}


def words_of(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text; case, punctuation, layout and markup leave no trace."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    if len(_known) > 500_000:
        _known.clear()
    out = []
    for w in _WORD.findall(text.replace("­", "").lower()):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows under all masks, and where each begins."""
    hashes, places = [], []
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            n = len(words) - len(mask) + 1
            if n <= 0:
                continue
            h = np.full(n, k + 1, dtype=np.uint64)
            for i, bit in enumerate(mask):
                if bit == "1":
                    h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
            hashes.append(h)
            places.append(np.arange(n))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def longest_overlap(doc: np.ndarray, item: np.ndarray) -> int:
    """The most matched words of a passage that both share.

    Exact runs of at least RUN words chain where the next begins within GAP words in both texts and
    the two distances differ by at most SHIFT; a chain counts if DENSITY of its words match. Every chain is
    looked at, from each of its beginnings, but for those that another one outdoes.
    """
    if len(doc) < RUN or len(item) < RUN:
        return 0
    with np.errstate(over="ignore"):
        grams = []
        for w in (doc, item):
            h = np.zeros(len(w) - RUN + 1, np.uint64)
            for i in range(RUN):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - RUN + 1 + i]
            grams.append(h)
    where: dict[int, list[int]] = {}
    for j, g in enumerate(grams[1].tolist()):
        where.setdefault(g, []).append(j)
    hits = [(int(i), j) for i in np.flatnonzero(np.isin(grams[0], grams[1])) for j in where[int(grams[0][i])]]
    seen = set(hits)
    runs = []
    for i, j in hits:
        if (i - 1, j - 1) not in seen:
            k = 1
            while (i + k, j + k) in seen:
                k += 1
            runs.append((i, j, k + RUN - 1))
    best = max((n for _, _, n in runs), default=0)
    # Chains by where they end in both texts: (begin in the document, begin in the item, matched words).
    ends: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, j, n in runs:
        chains = [(i, j, n)]
        for di in range(-min(RUN, n - 1), GAP + 1):
            for dj in range(max(-min(RUN, n - 1), di - SHIFT), min(GAP, di + SHIFT) + 1):
                over = max(0, -di, -dj)  # words that both runs claim
                chains += [(b, c, m + n - over) for b, c, m in ends.get((i - di, j - dj), ())]
        best = max([best, *(m for b, c, m in chains if m >= DENSITY * max(i + n - b, j + n - c))])
        at = ends.setdefault((i + n, j + n), [])
        at += chains
        if len(at) > 1:  # a chain that begins later with as many matched words leaves another nothing
            at.sort(key=lambda x: (-x[2], -x[0], -x[1]))
            kept: list[tuple[int, int, int]] = []
            for x in at:
                if not any(y[0] >= x[0] and y[1] >= x[1] for y in kept):
                    kept.append(x)
            ends[i + n, j + n] = kept
    return best


def _hashed_items(items: DataFrame) -> DataFrame:
    """(eval_id, words) of the test items without their stock instruction."""
    head = F.trim(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))))
    rows = items.where("text IS NOT NULL").select("eval_id", "text", head.alias("head"))
    stock = rows.where("text LIKE '%\n%'").groupBy("head").agg(F.count_distinct("text").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("head", F.lit(True).alias("is_stock"))
    own = F.when(F.col("is_stock"), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))
    rows = rows.join(stock, "head", "left").select("eval_id", own.alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"eval_id": b["eval_id"], "words": [words_of(t).tobytes() for t in b["text"]]})

    return rows.mapInPandas(hashed, "eval_id long, words binary")


def _item_seeds(items: DataFrame) -> DataFrame:
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [np.unique(seeds_of(np.frombuffer(w, np.uint64))[0]).view(np.int64) for w in b["words"]]
            yield pd.DataFrame({"eval_id": np.repeat(b["eval_id"].to_numpy(), [len(s) for s in own]), "seed": np.concatenate([*own, np.empty(0, np.int64)])})

    return items.mapInPandas(seeds, "eval_id long, seed long")


def leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, eval_id, n_words) for each document that holds a passage of a test item.

    A passage is ``least_words`` or more words of the item's text in a row, or as many in a longer one in which single
    words are changed, added or lost; n_words are the matched ones. Null and empty texts hold nothing. Of
    the items, hashes go to the tasks as a bit table of bounded size, which lets no shared hash slip; the hits
    that pass it are joined with the items' hashes by shuffle, so neither side is ever held whole.
    """
    spark = documents.sparkSession
    hashed = stage(_hashed_items(items), "items")
    seeds = stage(_item_seeds(hashed), "item_seeds")
    table = spark.sparkContext.broadcast(bit_table(seeds, seeds.count()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = table.value
        for b in batches:
            ids, kept, found = [], [], []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words = words_of(text)
                own, _ = seeds_of(words)
                own = own[among(own, packed)]
                if len(own):
                    ids.append(doc_id)
                    kept.append(words.tobytes())
                    found.append(np.unique(own).view(np.int64))
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "words": pd.Series(kept, dtype=object), "seeds": pd.Series(found, dtype=object)})

    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    near = stage(docs.mapInPandas(scan, "doc_id long, words binary, seeds array<long>"), "near")
    pairs = near.select("doc_id", F.explode("seeds").alias("seed")).join(seeds, "seed").select("doc_id", "eval_id").distinct()
    both = pairs.join(near.select("doc_id", F.col("words").alias("doc_words")), "doc_id").join(hashed.select("eval_id", F.col("words").alias("item_words")), "eval_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [longest_overlap(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64)) for d, i in zip(b["doc_words"], b["item_words"])]
            out = pd.DataFrame({"doc_id": b["doc_id"], "eval_id": b["eval_id"], "n_words": np.array(n, np.int64)})
            yield out[out["n_words"] >= least_words]

    return both.select("doc_id", "eval_id", "doc_words", "item_words").mapInPandas(verify, "doc_id long, eval_id long, n_words long").distinct()
