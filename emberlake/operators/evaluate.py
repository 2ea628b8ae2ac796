"""Ranking and classification measures, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.blocks import row_numbers, running_sum


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket of a key: the first 15 hex digits of its sha1, modulo."""
    return F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long") % buckets


def split_name(key: Column, train: int = 80, dev: int = 10) -> Column:
    b = hash_bucket(key)
    return F.when(b < train, "train").when(b < train + dev, "dev").otherwise("holdout")


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """One row of hit@1, recall@10, MRR over ``ranks(rank)``: the 1-based rank of the right answer, null if absent."""
    r = F.col("rank")
    return ranks.agg(
        F.count("*").alias("n"), F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("hit_at_1"),
        F.avg(F.when(r <= 10, 1.0).otherwise(0.0)).alias("recall_at_10"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
    ).withColumn("quality", 0.7 * F.col("hit_at_1") + 0.3 * F.col("mrr"))


def ranks_of(results: DataFrame, right: DataFrame, case: str = "query_id") -> DataFrame:
    """(``case``, rank): the best rank in ``results(case, id, rank)`` of one of the answers ``right(case, id)``, null where none was found; a row for each case of ``right``."""
    hits = results.join(right.select(case, "id").distinct(), [case, "id"]).groupBy(case).agg(F.min("rank").alias("rank"))
    return right.select(case).distinct().join(hits, case, "left")


def auc(scores: DataFrame) -> DataFrame:
    """One row: the probability that a positive outranks a negative of ``scores(score, label)``, ties counting half.

    Rows combine to counts per distinct score first; the running sum goes over those, by blocks of equal range
    in which the score falls, so no task orders all rows.
    """
    per = scores.where("score IS NOT NULL AND label IS NOT NULL").groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"))
    per = per.withColumn("block", F.floor(F.col("score") * 1000))
    blocks = per.groupBy("block").agg(F.sum("q").alias("q"))
    below = blocks.select("block", F.coalesce(F.sum("q").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("inside", inside).join(below, "block")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("q") / 2))
    return rows.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(wins, F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row: agreement of two raters beyond chance over ``pairs(a, b)`` of booleans; null where chance alone agrees."""
    c = pairs.where("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if("a").alias("ya"), F.count_if("b").alias("yb"))
    po, pe = F.col("same") / F.col("n"), (F.col("ya") * F.col("yb") + (F.col("n") - F.col("ya")) * (F.col("n") - F.col("yb"))) / (F.col("n") * F.col("n"))
    return c.select(F.col("n").cast("long").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) over equal bins of ``scores(score in 0..1, label)``; 1.0 falls in the last bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scores.where("score BETWEEN 0 AND 1 AND label IS NOT NULL").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: the mean gap of score and rate over ``reliability`` bins, by size."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def precision_recall(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, precision, recall); precision is null where nothing is kept."""
    rows = scores.where("score IS NOT NULL AND label IS NOT NULL").withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("score") >= t)))
    total = scores.where("label").agg(F.count("*").alias("positives"))
    kept = rows.groupBy("threshold").agg(F.count("*").alias("kept"), F.count_if("label").alias("right"))
    return kept.join(F.broadcast(total)).select("threshold", "kept", F.try_divide("right", "kept").alias("precision"), F.try_divide("right", "positives").alias("recall"))


def range_block(df: DataFrame, keys: list[str], column: str, name: str, blocks: int = 256) -> DataFrame:
    """``df`` with ``name``: in which of about ``blocks`` equally full ranges of its group the value of ``column`` lies, rising with it."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(column, F.array(*[F.lit(k / blocks) for k in range(1, blocks)]), F.lit(4 * blocks)).alias("_cuts"))
    cuts = cuts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(cuts, same).withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts", *[f"_k_{k}" for k in keys])


def spearman(scores: DataFrame, group: str, a: str, b: str, tie: str) -> DataFrame:
    """(group, n, rho): rank correlation of two scores inside each group, ties broken by ``tie``; null for one row.

    Rows with a null score take no part. Groups are ranked by ranges of the score, so that few large groups fill many tasks.
    """
    rows = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, a, b, tie)
    for c, rank in ((a, "ra"), (b, "rb")):
        rows = row_numbers(range_block(rows, [group], c, "_range"), [group], -F.col("_range"), [F.desc(c), tie], rank).drop("_range")
    d = rows.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col("ra") - F.col("rb"), F.lit(2))).alias("d2"))
    return d.select(group, F.col("n").cast("long").alias("n"), (1 - F.try_divide(6 * F.col("d2"), F.col("n") * (F.col("n") * F.col("n") - 1))).alias("rho"))


def deciles(values: DataFrame, column: str) -> DataFrame:
    """One row of the nine deciles, interpolated between neighbouring values; nulls where there are no values.

    Equal values are counted together, counts add up by ranges of values, and of all values only those at the wanted places meet.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = running_sum(range_block(counts, [], "v", "_range"), [], F.col("_range"), ["v"], F.col("c"), "upto")
    total = counts.agg(F.sum("c").alias("n"))
    rows = upto.join(F.broadcast(total))  # one row
    out = []
    for k in range(1, 10):
        place = F.lit(k / 10) * (F.col("n") - 1)
        at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v")))
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        out.append((low + part * (F.coalesce(at(F.floor(place) + 1), low) - low)).alias(f"d{k}"))
    return rows.agg(*out)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows by smallest hash of seed and key: the same ones each time, whatever the partitions."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256), key).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, key: str, each: int, seed: str) -> DataFrame:
    """``each`` rows of every stratum by smallest hash. Rows that cannot be among them are dropped per hash block first."""
    h = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 64, 1))
    near = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))).where(F.col("_k") <= each)
    return near.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_k") <= each).drop("_h", "_b", "_k")


def bootstrap_gain(pairs: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """One row: mean gain of b over a and its 10th percentile over Poisson bootstrap replicates of ``pairs(id, a, b)``.

    Every row's weight in every replicate is drawn from a hash of id and replicate, so the result does not
    depend on partitions; sums combine before the shuffle.
    """
    u = F.pmod(F.xxhash64("id", "r", F.lit(seed)), F.lit(1 << 53)).cast("double") / (1 << 53)
    weight = F.lit(0)
    upto, term = 0.0, 0.36787944117144233  # Poisson with mean 1
    for k in range(0, 8):
        upto += term
        weight = weight + F.when(u >= upto, 1).otherwise(0)
        term /= k + 1
    rows = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    per = rows.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * (F.col("b") - F.col("a"))), F.sum("w")).alias("gain"))
    return per.agg(F.avg("gain").alias("mean_gain"), F.percentile("gain", F.lit(0.1)).alias("p10"))
