"""Reading the corpus tables and the rules every operator shares about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_key() -> Column:
    """An item's identity. Rows without an id are told apart by source and source_id."""
    return F.coalesce(F.col("id"), F.concat(F.lit("?"), F.col("source"), F.lit(":"), F.col("source_id")))


def distinct_items(items: DataFrame, *columns: str) -> DataFrame:
    """One row per item id with the asked columns; second deliveries fold into the earliest one.

    The aggregation combines on the map side, so copies of one id never travel. Where deliveries
    disagree, the values of the earliest ``ingested_at`` count. Rows whose id, source and source_id
    are all null are one item.
    """
    values = F.struct(*[F.col(c) for c in columns if c != "id"])
    return (
        items.groupBy(item_key().alias("id"))
        .agg(F.min_by(values, F.coalesce(F.col("ingested_at"), F.lit("9999-12-31").cast("timestamp"))).alias("v"))
        .select("id", "v.*")
    )
