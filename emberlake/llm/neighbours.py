"""The most similar vectors of every vector: a small-world graph per shard, shard results merged.

Equal directions are folded into one vector first. A coarse clustering of a bounded sample parts the
vectors into shards of bounded size; each shard's graph is kept as flat arrays in a table. Every vector then
searches the graphs of its own cell and of the cells whose centre is almost as near, in chunks of bounded
size, and the results of its shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm import hnsw
from emberlake.session import stage

#: Vectors of a shard; a cell of more than MOST_SHARDS_IN_ONE times as many is parted by hash, and its queries visit all parts.
SHARD, MOST_SHARDS_IN_ONE = 8000, 3
#: Vectors that the coarse clustering is fitted on, and the most cells; every vector is indexed.
MOST_SAMPLED, SAMPLED_A_CELL, MOST_CELLS, FIT_ROUNDS = 50_000, 256, 4096, 10
#: A cell is searched too if its centre is at most this much less similar than the nearest one.
MARGIN = 0.08
#: Queries that one task takes to one graph.
CHUNK = 20_000
#: Digits to which equal directions agree.
DIGITS = 6


def unit_vectors(vectors: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """(id, h, v) of the usable rows: ``dim`` finite values, not all zero. v: unit length, float32 bytes; h: hash of the direction."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            right = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(lists), 0), dim), pc.is_valid(ids))
            ids, lists = ids.filter(right), lists.filter(right)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            scale = np.abs(x).max(1, initial=0)
            good = np.isfinite(x).all(1) & (scale > 0)
            x, ids = x[good] / scale[good, None], ids.filter(pa.array(good))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            rounded = (np.rint(x * 10**DIGITS) + 0.0).astype(np.int32)
            h = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rounded], np.uint64).view(np.int64)
            unit = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array(h), pa.array([r.tobytes() for r in unit], pa.binary())], ["id", "h", "v"])

    return vectors.select(F.col(id_column).cast("string"), vector_column).mapInArrow(convert, "id string, h long, v binary")


def _matrix(rows, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column of their bytes, which lie one behind the other."""
    parts = [np.zeros((0, dim), np.float32)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[c.offset] : ends[c.offset + len(c)]].view(np.float32).reshape(-1, dim))
    return np.concatenate(parts)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(FIT_ROUNDS if cells > 1 else 0):
        own = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
    return centres


def _sampled(vectors: DataFrame, id_column: str, vector_column: str, dim: int, n: int, wanted: int) -> np.ndarray:
    """About ``wanted`` usable vectors, by the hash of their ids; never more than twice as many come to the driver."""
    share = max(1, n // wanted)
    rows = vectors.where(F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(share)) == 0)
    found = unit_vectors(rows, id_column, vector_column, dim).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(2 * wanted)
    return _matrix([r["v"] for r in found.select("v").collect()], dim)


def nearest(directions: DataFrame, sample: np.ndarray, n: int, dim: int, k: int, shard: int = SHARD, margin: float = MARGIN) -> DataFrame:
    """(h, near, sim): for each of ``directions(id, h, v)`` and each shard it visits, the ``k`` most similar others there; repeats of h count once.

    ``n``: the number of distinct h; ``sample``: vectors that the cells are fitted on. The number of shards grows
    with n, their size does not. Each vector goes to its own shard's graph, and as a visitor to those of near
    cells. A shard that few visit is built and searched in one task. Of one that more than CHUNK visit, as
    the sample foretells, the graph is kept in a table and its visitors come in chunks.
    """
    spark = directions.sparkSession
    none = spark.createDataFrame([], "h long, near long, sim float")
    if not len(sample):
        return none
    fitted = _centres(sample, max(1, min(MOST_CELLS, ceil(n / shard), len(sample))))
    s = sample @ fitted.T
    weight = n / len(sample)
    size = np.bincount(s.argmax(1), minlength=len(fitted)) * weight
    parts = np.where(size > MOST_SHARDS_IN_ONE * shard, np.ceil(size / shard), 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])  # the number of each cell's first shard
    shards = int(parts.sum())
    near_cells = s >= s.max(1)[:, None] - margin
    visitors = np.repeat(near_cells.sum(0) * weight, parts)
    crowded = visitors > 2 * CHUNK
    shared = spark.sparkContext.broadcast((fitted, parts, first))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts, first = shared.value
        seen: set[int] = set()
        for b in batches:
            h, at = np.unique(b.column("h").to_numpy(), return_index=True)
            fresh = np.array([x not in seen for x in h.tolist()], bool)  # a direction of very many copies travels once per task
            h, at = h[fresh], at[fresh]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(h.tolist())
            if not len(h):
                continue
            v = b.column("v").take(pa.array(at))
            s = _vectors(v, dim) @ centres.T
            home = s.argmax(1)
            own = first[home] + h % parts[home]
            rows, cell = np.nonzero(s >= s.max(1)[:, None] - margin)
            each = parts[cell]
            rows, to = np.repeat(rows, each), np.repeat(first[cell], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            away = to != own[rows]
            to, rows = np.concatenate([own, to[away]]), np.concatenate([np.arange(len(h)), rows[away]])
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(to)) < len(h)), pa.array(h[rows]), v.take(pa.array(rows))], ["shard", "is_own", "h", "v"])

    sent = directions.select("h", "v").mapInArrow(send, "shard long, is_own boolean, h long, v binary")

    schema = pa.schema([("h", pa.int64()), ("near", pa.int64()), ("sim", pa.float32())])

    def result(h: np.ndarray, hs: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.Table:
        near = np.where(ids >= 0, hs[np.maximum(ids, 0)], 0) if len(hs) else np.zeros(ids.shape, np.int64)
        keep = (ids >= 0) & (near != h[:, None])
        keep &= np.cumsum(keep, 1) <= k
        return pa.Table.from_arrays([pa.array(h[np.nonzero(keep)[0]]), pa.array(near[keep]), pa.array(sims[keep])], schema=schema)

    def once(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Each h once, in order, with its vector."""
        h, at = np.unique(t.column("h").to_numpy(), return_index=True)
        return h, _vectors(t.column("v"), dim)[at]

    def grown(own: pa.Table) -> tuple[np.ndarray, hnsw.Graph]:
        hs, x = once(own)
        return hs, hnsw.build(x)

    def inside(hs: np.ndarray, graph: hnsw.Graph) -> pa.Table:
        return result(hs, hs, *graph.search(graph.vectors, k + 1, np.arange(len(hs))))

    def visited(hs: np.ndarray, graph: hnsw.Graph, asked: pa.Table) -> pa.Table:
        h, x = once(asked)
        return result(h, hs, *graph.search(x, k)) if len(hs) and len(h) else schema.empty_table()

    def build_and_search(t: pa.Table) -> pa.Table:
        own = t.filter(t.column("is_own"))
        if not len(own):
            return schema.empty_table()
        hs, graph = grown(own)
        return pa.concat_tables([inside(hs, graph), visited(hs, graph, t.filter(pc.invert(t.column("is_own"))))])

    quiet = sent if not crowded.any() else sent.where(~F.col("shard").isin([int(x) for x in np.flatnonzero(crowded)]))
    met = quiet.repartition(shards, "shard").groupBy("shard").applyInArrow(build_and_search, "h long, near long, sim float")
    if crowded.any():
        met = met.unionByName(_crowded(sent.where(F.col("shard").isin([int(x) for x in np.flatnonzero(crowded)])), {int(x): ceil(visitors[x] / CHUNK) for x in np.flatnonzero(crowded)}, grown, inside, visited, schema))
    return met


def _crowded(sent: DataFrame, chunks: dict[int, int], grown, inside, visited, schema: pa.Schema) -> DataFrame:
    """(h, near, sim) for shards of very many visitors: graphs go to a table, and each chunk of visitors to one task."""

    def build(own: pa.Table) -> pa.Table:
        hs, graph = grown(own)
        vectors, links, size, layers, entry = graph.to_bytes()
        return pa.Table.from_pydict({"shard": own.column("shard")[:1], "hs": [hs.tobytes()], "vectors": [vectors], "links": [links], "layers": pa.array([layers], pa.int32()), "entry": pa.array([entry], pa.int32()), "n": pa.array([size], pa.int32())})

    def opened(t: pa.Table) -> tuple[np.ndarray, hnsw.Graph]:
        j = t.slice(0, 1).to_pylist()[0]
        return np.frombuffer(j["hs"], np.int64), hnsw.Graph.from_bytes(j["vectors"], j["links"], j["n"], j["layers"], j["entry"])

    def search(jobs: pa.Table, asked: pa.Table) -> pa.Table:
        return visited(*opened(jobs), asked) if len(jobs) else schema.empty_table()

    many = F.element_at(F.create_map(*[F.lit(x) for c, n in chunks.items() for x in (c, n)]), F.col("shard"))
    graphs = sent.where("is_own").repartition(len(chunks), "shard").groupBy("shard").applyInArrow(build, "shard long, hs binary, vectors binary, links binary, layers int, entry int, n int")
    graphs = stage(graphs, "graphs")
    jobs = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), many - 1)))
    asked = sent.where("NOT is_own").withColumn("chunk", F.pmod(F.xxhash64("h"), many.cast("long")).cast("int"))
    key, width = ["shard", "chunk"], sum(chunks.values())
    own = graphs.groupBy("shard").applyInArrow(lambda t: inside(*opened(t)), "h long, near long, sim float")
    return own.unionByName(jobs.repartition(width, *key).groupBy(*key).cogroup(asked.repartition(width, *key).groupBy(*key)).applyInArrow(search, "h long, near long, sim float"))


def neighbour_pairs(vectors: DataFrame, id_column: str, vector_column: str, dim: int = 64, k: int = 5) -> DataFrame:
    """(a, b): pairs of ids, the smaller first, of which one is among the other's ``k`` most similar by cosine.

    Rows with null ids, or vectors null, of another length, with values null or not finite, or all zero take
    no part. Repeated rows count once; of one id's different vectors the one of smallest hash counts. Equal directions
    are most similar to each other, the smaller ids first. A group of copies of any size gives each member at
    most ``k`` pairs, by way of its ``k + 1`` smallest ids, which are found without gathering the group in one
    task. Neighbours are found and paired by number; ids join at the end.
    """
    rows = unit_vectors(vectors, id_column, vector_column, dim)
    members = stage(rows.select("id", "h").groupBy("id").agg(F.min("h").alias("h")), "members")
    smallest = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, k + 1)
    sizes = members.groupBy("h").agg(F.count("*").alias("m"), F.min("id").alias("first"))
    sizes = stage(sizes, "sizes")
    copies = members.join(sizes.where("m > 1").select("h"), "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1024)))
    for salt in (F.col("salt"), F.pmod("salt", F.lit(32))):
        copies = copies.groupBy("h", salt.alias("salt")).agg(smallest("id").alias("ids")).select("h", "salt", F.explode("ids").alias("id"))
    # A small table as a rule; its size on disk decides how it joins.
    several = stage(copies.groupBy("h").agg(smallest("id").alias("ids")), "copies")
    n = sizes.count()
    cells = max(1, ceil(n / SHARD))
    sample = _sampled(vectors, id_column, vector_column, dim, n, min(MOST_SAMPLED, max(1000, SAMPLED_A_CELL * cells)))
    met = nearest(rows, sample, n, dim, k)
    # The copies of a neighbour fill as many of the k places as there are of them, the own ones the first places.
    sized = met.join(several.select(F.col("h").alias("near"), F.size("ids").alias("m")), "near", "left").join(several.select("h", F.size("ids").alias("own")), "h", "left")
    m, own = F.coalesce("m", F.lit(1)), F.coalesce("own", F.lit(1))
    best = Window.partitionBy("h").orderBy(F.desc("sim"), "near")
    before = F.coalesce(F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = sized.withColumns({"m": m, "own": own}).withColumn("slots", F.least("m", k - (F.col("own") - 1) - before)).where("slots > 0")
    slots = stage(slots.select("h", "near", "m", "own", "slots"), "slots")  # read twice below
    plain = slots.where("m = 1 AND own = 1").select(F.least("h", "near").alias("h"), F.greatest("h", "near").alias("near")).distinct()
    firsts = sizes.select("h", "first")
    one = plain.join(firsts, "h").select("near", F.col("first").alias("x")).join(firsts.withColumnRenamed("h", "near"), "near").select("x", F.col("first").alias("y"))
    # Where copies are on either side: all members of the group, and as many of the other's ids as there are slots.
    rest = slots.where("m > 1 OR own > 1").select("h", "near", "slots")
    rest = rest.join(firsts, "h").join(several, "h", "left").select("near", "slots", F.explode(F.coalesce("ids", F.array("first"))).alias("x"))
    rest = rest.join(firsts.withColumnRenamed("h", "near"), "near").join(several.withColumnRenamed("h", "near"), "near", "left")
    rest = rest.select("x", F.explode(F.slice(F.coalesce("ids", F.array("first")), F.lit(1), F.col("slots").cast("int"))).alias("y"))
    same = members.join(several, "h").select(F.col("id").alias("x"), F.explode(F.slice(F.filter("ids", lambda y: y != F.col("id")), 1, k)).alias("y"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    return one.select(*pair).unionByName(rest.unionByName(same).select(*pair).distinct())
