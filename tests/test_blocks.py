import random

from pyspark.sql import functions as F

from emberlake.operators import blocks, evaluate


def test_blocks_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(0, 400), k, rng.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, at long, id long, v long")
    block = F.floor(F.col("at") / 50)
    out = blocks.running_sum(df, ["g"], block, ["at", "id"], F.col("v"), "upto")
    out = blocks.neighbours(blocks.row_numbers(out, ["g"], block, ["at", "id"], "no"), ["g"], block, ["at", "id"], ["id"], after=True)
    got = {r["id"]: (r["upto"], r["no"], r["prev"] and r["prev"]["id"], r["next"] and r["next"]["id"]) for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for k, r in enumerate(own):
            want[r[2]] = (sum(x[3] for x in own[: k + 1]), k + 1, own[k - 1][2] if k else None, own[k + 1][2] if k + 1 < len(own) else None)
    assert got == want
    assert blocks.row_numbers(df.limit(0), ["g"], block, ["at"], "no").count() == 0


def test_deciles_and_spearman_of_ties_nulls_and_nothing(spark):
    values = spark.createDataFrame([(float(k % 7),) for k in range(50)] + [(None,)], "x double")
    import numpy as np

    want = np.quantile([k % 7 for k in range(50)], [k / 10 for k in range(1, 10)])
    assert np.allclose(list(evaluate.deciles(values, "x").first()), want)
    assert list(evaluate.deciles(values.limit(0), "x").first()) == [None] * 9
    s = spark.createDataFrame([("g", float(k), float(-k), k) for k in range(20)] + [(None, 1.0, 1.0, 50)], "g string, a double, b double, id long")
    assert {r["g"]: r["rho"] for r in evaluate.spearman(s, "g", "a", "b", "id").collect()} == {"g": -1.0, None: None}
