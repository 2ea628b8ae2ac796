"""Containers of fixed capacity filled with whole texts, shortest pack first over the length histogram."""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.ranks import numbered
from emberlake.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's authors part text before merging; a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANK_BLOCKS = 256

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row; null and empty texts have no tokens. ``tokenizer``: a vocabulary file on every executor."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.array([len(encode(t)) if t else 0 for t in b["text"]], np.int64)})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Packing patterns (lengths with their number, number of packs) for a histogram of lengths up to ``capacity``.

    Lengths are placed longest first, each into the pack with most space left. Where no pack has room,
    new ones open: as many as all texts still to come need, so that a frequent short length does not
    leave a container for each text. Work and result depend on the number of distinct lengths, not of texts.
    """
    heap: list[tuple[int, int]] = []  # space left, negative, and pattern
    patterns: list[list] = []  # lengths, packs

    def put(lengths: Counter, packs: int) -> None:
        if packs:
            heapq.heappush(heap, (-(capacity - sum(k * n for k, n in lengths.items())), len(patterns)))
            patterns.append([lengths, packs])

    later = sum(length * n for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        later -= length * todo
        while todo and heap and -heap[0][0] >= length:
            space, at = heapq.heappop(heap)
            lengths, packs = patterns[at]
            each = min(-space // length, max(1, todo // packs))  # copies that every pack of the pattern takes
            used = min(packs, todo // each)
            patterns[at][1] = packs - used
            if patterns[at][1]:
                heapq.heappush(heap, (space, at))
            put(lengths + Counter({length: each}), used)
            todo -= each * used
        if todo:
            fit = capacity // length
            packs = min(todo, max(-(-todo // fit), -(-(todo * length + later) // capacity)))
            low, more = divmod(todo, packs)
            put(Counter({length: low}), packs - more)
            put(Counter({length: low + 1}), more)
    return [(lengths, packs) for lengths, packs in patterns if packs]


def _slots(patterns: list[tuple[Counter, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, packs, first container), by rank: which texts of that length go where."""
    taken: Counter = Counter()
    out: dict[int, list] = {}
    container = 0
    for lengths, packs in patterns:
        for length, each in lengths.items():
            for _ in range(each):
                out.setdefault(length, []).append((taken[length], packs, container))
                taken[length] += packs
        container += packs
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """Assign ``sizes(doc_id, n_tokens)`` to containers of each ``limits(limit_name, capacity_tokens)``.

    Returns (limit_name, container_id, doc_id, piece_no, token_from, token_to): token_to is exclusive.
    Texts longer than a container are cut into full pieces and a rest, all others stay whole. Texts without
    tokens take no space and stand in container 0. Rows without n_tokens count as empty; every row is placed,
    repeated doc_ids each for themselves. Limits without a positive capacity are left out. Only the
    histogram comes to the driver: at most a row for each length up to a capacity. The slots sent back are
    bounded by it too.
    """
    spark = sizes.sparkSession
    caps = {r["limit_name"]: r["capacity_tokens"] for r in limits.where("capacity_tokens > 0").groupBy("limit_name").agg(F.min("capacity_tokens").alias("capacity_tokens")).collect()}
    if not caps:
        return spark.createDataFrame([], "limit_name string, container_id long, doc_id long, piece_no int, token_from long, token_to long")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(int(c)).cast("long").alias("cap")) for k, c in sorted(caps.items())]))
    n = F.coalesce("n_tokens", F.lit(0))
    whole = sizes.select("doc_id", n.alias("n"), each.alias("l")).select("doc_id", "n", "l.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("cap")) - 1).cast("int")
    pieces = whole.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).withColumn("token_from", F.col("piece_no") * F.col("cap"))
    pieces = pieces.withColumn("token_to", F.least(F.col("n"), F.col("token_from") + F.col("cap"))).withColumn("length", (F.col("token_to") - F.col("token_from")).cast("int"))
    pieces = pieces.select("limit_name", "doc_id", "piece_no", "token_from", "token_to", "length")
    counts: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in pieces.where("length > 0").groupBy("limit_name", "length").count().collect():
        counts[r["limit_name"]][r["length"]] = r["count"]
    slots = spark.sparkContext.broadcast({k: _slots(pack_histogram(h, caps[k])) for k, h in counts.items()})
    block = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(RANK_BLOCKS))
    ranked = numbered(pieces, ["limit_name", "length"], block, ["doc_id", "piece_no"], "rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.zeros(len(b), np.int64)
            for (limit, length), rows in b.groupby(["limit_name", "length"]).indices.items():
                if length:
                    table = slots.value[limit][length]
                    rank = b["rank"].to_numpy()[rows] - 1
                    k = np.searchsorted(table[:, 0], rank, side="right") - 1
                    at[rows] = table[k, 2] + rank - table[k, 0]
            yield b.assign(container_id=at)[["limit_name", "container_id", "doc_id", "piece_no", "token_from", "token_to"]]

    return ranked.mapInPandas(place, "limit_name string, container_id long, doc_id long, piece_no int, token_from long, token_to long")


def fill_report(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, n_containers, n_pieces, n_tokens, unused_share) of an assignment."""
    per = placed.groupBy("limit_name").agg(F.countDistinct(F.when(F.col("token_to") > F.col("token_from"), F.col("container_id"))).alias("n_containers"), F.count("*").alias("n_pieces"), F.sum(F.col("token_to") - F.col("token_from")).alias("n_tokens"))
    return per.join(limits.groupBy("limit_name").agg(F.min("capacity_tokens").alias("cap")), "limit_name").select("limit_name", "n_containers", "n_pieces", "n_tokens", F.try_subtract(F.lit(1.0), F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("cap"))).alias("unused_share"))


def pack_documents(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack`` over the token counts of ``documents(doc_id, text)``, which are taken once."""
    return pack(stage(token_counts(documents, tokenizer), "tokens"), limits)
