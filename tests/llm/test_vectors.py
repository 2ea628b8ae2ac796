import numpy as np
import pytest

from emberlake.llm import hnsw, neighbours


def _clustered(n, dim=16, size=20, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // size), dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n", [1, 2, 7, 600, 3000])
def test_graph_recall(n):
    x = _clustered(n)
    g = hnsw.build(x)
    k = min(6, n)
    ids, sims = hnsw.Graph.from_bytes(*[g.to_bytes()[i] for i in (0, 1, 2, 3, 4)]).search(x, k, np.arange(n))
    s = x @ x.T
    true = np.argsort(-s, 1)[:, :k]
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(ids, true)]) >= 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def _brute(rows, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("crowd", [neighbours.CHUNK, 40])
def test_pairs_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "CHUNK", crowd)
    x = _clustered(1200)
    rows = {f"v{k:04}": [float(a) for a in v] for k, v in enumerate(x)}
    rows |= {"copy1": [2 * a for a in rows["v0003"]], "copy2": rows["v0003"]}
    table = [(i, v, "clash") for i, v in rows.items()] + [("v0001", rows["v0001"], "again"), ("bad1", None, ""), ("bad2", [1.0], ""), ("bad3", [0.0] * 16, ""), ("bad4", [float("nan")] * 16, ""), ("bad5", [None] * 16, ""), (None, rows["v0001"], "")]
    df = spark.createDataFrame(table, "id string, e array<float>, h string")
    real = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a: real(*a, shard=300))
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "id", "e", 16).collect()}
    want = _brute(rows, 5)
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9
    assert ("copy1", "copy2") in got and ("copy1", "v0003") in got


def test_many_copies_and_empty(spark):
    df = spark.createDataFrame([(f"c{k:03}", [1.0, 2.0]) for k in range(40)] + [("z", [1.0, 0.0])], "id string, e array<double>")
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "id", "e", 2).collect()}
    want = {(min(a, b), max(a, b)) for a in (f"c{k:03}" for k in range(40)) for b in [x for x in (f"c{k:03}" for k in range(6)) if x != a][:5]}
    assert {p for p in got if "z" not in p} == want and {p for p in got if "z" in p} == {(f"c{k:03}", "z") for k in range(5)}
    assert neighbours.neighbour_pairs(df.limit(0), "id", "e", 2).count() == 0
