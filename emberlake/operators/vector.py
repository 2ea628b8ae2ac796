"""Exact nearest neighbours of a stated set of query vectors, by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.lexical import top_k

QUERY_BLOCK = 2048


def knn(vectors: DataFrame, queries: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` vectors nearest to each query by L2 distance, itself included; ties by id.

    ``vectors(id, embedding)`` and ``queries(query_id, embedding)``; ids are numbers or texts. Vectors without id, null or of another length take no part.
    Queries form blocks of bounded size; each batch of vectors meets every block by one matrix product and keeps
    its best ``k``, so no pair of rows is ever a row.
    """
    right = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    kind = lambda df, c: "long" if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") else "string"
    of_query, of_id = kind(queries, "query_id"), kind(vectors, "id")
    q = queries.where(right).select(F.col("query_id").cast(of_query), "embedding").where("query_id IS NOT NULL")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packed = q.groupBy("block").agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
    v = vectors.where(right).select(F.col("id").cast(of_id), "embedding").where("id IS NOT NULL").withColumn("part", F.spark_partition_id())
    v = v.withColumn("part", F.concat_ws("-", "part", F.pmod(F.xxhash64("id"), F.lit(8)))).groupBy("part", F.floor(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / (1 << 17)).alias("sub")).agg(F.collect_list(F.struct("id", "embedding")).alias("v"))
    jobs = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, asked in zip(b["v"], b["q"]):
                rows = sorted(rows, key=lambda r: r["id"])
                ids = np.array([r["id"] for r in rows])
                x = np.array([r["embedding"] for r in rows], np.float64)
                qs = np.array([r["embedding"] for r in asked], np.float64)
                d = np.sqrt(np.maximum(0, (qs**2).sum(1)[:, None] + (x**2).sum(1) - 2 * qs @ x.T))
                d = np.round(d, 6)
                n = min(k, len(ids))
                best = np.argsort(d, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"query_id": np.repeat([r["query_id"] for r in asked], n), "id": ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})

    found = jobs.select("v", "q").mapInPandas(nearest, f"query_id {of_query}, id {of_id}, distance double")
    return top_k(found, k, score=F.col("distance").asc())


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_other(found: DataFrame) -> DataFrame:
    """(query_id, id, similarity) of each query's nearest vector but itself, from ``knn`` of unit vectors with k of 2 or more."""
    best = found.where("id <> query_id").groupBy("query_id").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select("query_id", "b.id", F.round(1 - F.col("b.distance") * F.col("b.distance") / 2, 6).alias("similarity"))
