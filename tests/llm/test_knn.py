import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import knn
from corpusloom.llm.vamana import Graph

CHUNKS = "id string, embedding array<float>"


def clustered(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base + rng.normal(size=base.shape) * 0.35])
    return (x * rng.uniform(0.2, 6, (len(x), 1))).astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    out = set()
    for i, row in enumerate(g):
        for j in sorted(range(len(row)), key=lambda j: (-row[j], ids[j]))[:k]:
            if row[j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def rows(ids, x):
    return [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]


def test_recall_against_brute_force(spark):
    x = clustered()
    ids = [f"c{i:05}" for i in range(len(x))]
    got = {tuple(r) for r in knn.near_pairs(spark.createDataFrame(rows(ids, x), CHUNKS)).collect()}
    want = brute(ids, x, 10, 0.9)
    assert len(want) > 400 and len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_recall_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 300)
    x = clustered(seed=4)
    ids = [f"c{i:05}" for i in range(len(x))]
    got = {tuple(r) for r in knn.near_pairs(spark.createDataFrame(rows(ids, x), CHUNKS)).collect()}
    want = brute(ids, x, 10, 0.9)
    assert len(got & want) / len(want) >= 0.9


def test_graph_finds_neighbours():
    x = clustered(2001, seed=2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    assert g.deg.max() <= g.degree and ((g.out >= -1) & (g.out < len(x))).all()
    ids, _ = g.search(x[:300], 20)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :3]
    assert np.mean([len(set(t) & set(i)) / 3 for t, i in zip(true.tolist(), ids.tolist(), strict=True)]) > 0.9


def test_unusable_vectors_copies_and_clashing_columns(spark):
    x = clustered(60, seed=5)
    data = rows([f"c{i:02}" for i in range(60)], x)
    data += [("null", None), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), (None, x[0].tolist()), data[0], data[0]]
    hole = [1.0] * 64
    hole[3] = None
    df = spark.createDataFrame([*data, ("hole", hole)], CHUNKS).withColumns({c: F.lit("x") for c in ("cell", "v", "member", "h", "similarity", "neighbour")})
    got = {tuple(r) for r in knn.near_pairs(df).collect()}
    assert got == brute([d[0] for d in data[:60]], x, 10, 0.9)
    assert knn.near_pairs(df.limit(0)).count() == 0
    assert knn.near_pairs(spark.createDataFrame([("a", [0.0] * 64)], CHUNKS)).count() == 0


@pytest.mark.parametrize("floor", [2000, 20])
def test_many_copies_of_one_vector(spark, monkeypatch, floor):
    """A third of all rows hold one vector; below and above the size from which copies are kept out of the index."""
    monkeypatch.setattr(knn, "COPY_ROWS", floor)
    x = clustered(201, seed=6)
    x = np.concatenate([x, np.repeat(x[:1], 100, axis=0)])
    ids = [f"c{i:03}" for i in range(301)]
    got = {tuple(r) for r in knn.near_pairs(spark.createDataFrame(rows(ids, x), CHUNKS)).collect()}
    first = [ids[0], *ids[201:]]
    want = {(min(a, b), max(a, b)) for a in first for b in [i for i in first if i != a][:10]}
    assert {p for p in got if p[0] in first and p[1] in first} == want


def test_neighbours_of_every_vector(spark):
    x = clustered(90, seed=7)
    ids = [f"c{i:02}" for i in range(90)]
    n = knn.neighbours(spark.createDataFrame(rows(ids, x), CHUNKS), k=5).groupBy("id").count().collect()
    assert len(n) == 90 and {r["count"] for r in n} == {5}


def test_crowded_cells_are_split(spark, monkeypatch):
    """One dense direction holds most rows: its cell is split until every part is small, and neighbours are still found."""
    monkeypatch.setattr(knn, "SHARD_ROWS", 150)
    monkeypatch.setattr(knn, "MOST_ROWS", 300)
    monkeypatch.setattr(knn, "CELLS", 2)
    monkeypatch.setattr(knn, "PARTS", 3)
    monkeypatch.setattr(knn, "SALT_ROWS", 400)
    rng = np.random.default_rng(8)
    axis = rng.normal(size=64)
    base = axis * 3 + rng.normal(size=(700, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2, rng.normal(size=(200, 64))]) * rng.uniform(0.3, 4, (1600, 1))
    ids = [f"c{i:05}" for i in range(len(x))]
    got = {tuple(r) for r in knn.near_pairs(spark.createDataFrame(rows(ids, x.astype(np.float32)), CHUNKS), 10, 0.93).collect()}
    want = brute(ids, x, 10, 0.93)
    assert len(want) > 1000 and len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


@pytest.mark.parametrize("floor", [2000, 20])
def test_one_direction_at_many_lengths(spark, monkeypatch, floor):
    """Copies are found by their direction, whatever their length."""
    monkeypatch.setattr(knn, "COPY_ROWS", floor)
    x = clustered(201, seed=6)
    rng = np.random.default_rng(1)
    x = np.concatenate([x, x[:1] * rng.uniform(0.01, 50, (100, 1))]).astype(np.float32)
    ids = [f"c{i:03}" for i in range(301)]
    got = {tuple(r) for r in knn.near_pairs(spark.createDataFrame(rows(ids, x), CHUNKS)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    h = knn.hashes(u.astype(np.float32))
    assert len(set(h[[0, *range(201, 301)]].tolist())) <= 4  # rounding may part a few
    first = {ids[0], *ids[201:]}
    alike = {p for p in got if p[0] in first and p[1] in first}
    every = {i for p in alike for i in p}
    assert every == first and len(alike) >= 100 * 10 * 0.9


def test_large_graph():
    """Recall of a graph of 30,000 nodes, as many as no shard holds."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(3000, 64))
    x = (centres[rng.integers(3000, size=30_000)] + rng.normal(size=(30_000, 64)) * 0.4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, knn.DEGREE, knn.BEAM)
    q = np.arange(0, 30_000, 60)
    ids, _ = g.search(x[q], knn.SEARCH_BEAM)
    true = np.argsort(-(x[q] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & set(i)) / 10 for t, i in zip(true.tolist(), ids.tolist(), strict=True)]) >= 0.95
