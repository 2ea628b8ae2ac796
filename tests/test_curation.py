from emberlake.operators import curation


def test_merges(spark):
    links = spark.createDataFrame([("i", 1, 0.5), ("i", 2, 0.9), ("j", 3, None)], "item_id string, entity_id int, confidence double")
    merges = spark.createDataFrame([(1, 2), (2, 2)], "entity_id int, survivor int")
    assert {tuple(r) for r in curation.merged_links(links, merges).select("item_id", "entity_id", "confidence").collect()} == {("i", 2, 0.9), ("j", 3, None)}
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.2), (2, 3, 0.7)], "entity_a int, entity_b int, weight double")
    assert [tuple(r) for r in curation.merged_relations(edges, merges).select("entity_a", "entity_b", "weight").collect()] == [(2, 3, 0.7)]


def test_neighbours_and_folds(spark):
    rows = spark.createDataFrame([("t", k, str(k)) for k in range(6)] + [(None, 1, "x")], "g string, at int, id string")
    left = curation.without_neighbours(rows, rows.where("id = '2'"), "g", "at", "id")
    assert {r["id"] for r in left.collect()} == {"0", "4", "5", "x"}
    out = curation.training_rows(rows.selectExpr("*", "true AS label"), "id", "label", 3)
    assert all(r["n"] == (3 if r["fold"] == "train" else 1) for r in out.groupBy("id", "fold").agg({"*": "count"}).toDF("id", "fold", "n").collect())


def test_consensus_votes_knee(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, verdict boolean")
    assert tuple(curation.consensus(a, a).first()) == (3, 2, 1)
    v = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "id int, vote boolean")
    assert {r["id"]: r["relevant"] for r in curation.votes(v).collect()} == {1: False, 2: True}
    assert curation.knee(spark.createDataFrame([(1, 0.5), (2, 0.991), (9, 1.0)], "k int, score double")).first()["k"] == 2
    assert curation.movement(spark.createDataFrame([(5, 2), (1, None), (1, 4)], "before int, after int")).first().asDict() == {"up": 1, "down": 1, "same": 0, "into_top3": 1}
