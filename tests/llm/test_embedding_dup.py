import random

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import embedding_dup as E


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x = np.vstack((x, x[:80] + 0.09 * rng.normal(size=(80, 16)), x[0] + 0.06 * rng.normal(size=(90, 16)), x[:5]))
    ids = random.Random(1).sample(range(10_000), len(x))
    got = {r.id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= E.THRESHOLD
    root = list(range(len(x)))
    for _ in range(20):
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
    least = {r: min(ids[i] for i in range(len(x)) if root[i] == r) for r in set(root)}
    assert got == {ids[i]: (int(near[i].sum()) - 1, least[root[i]]) for i in range(len(x))}


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 0.0]), (3, [3e200, 1e190]), (4, [5e-324, 0.0]), (5, [0.0, 1e308]), (6, [0.0, 2.0])]
    got = {r.id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_more_cells_than_before_lose_nothing(spark, monkeypatch):
    """Clustered vectors in some five hundred cells."""
    monkeypatch.setattr(E, "TILE", 8)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(500, 12)), 8, axis=0) + 0.12 * rng.normal(size=(4000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(E.pivots(df.select(F.col("vec_id").alias("node"), F.lit(x[0].tobytes()).alias("vec")), 300)[12]) == 300
    got = {r.id: r.n_links for r in E.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == dict(enumerate(((u @ u.T >= E.THRESHOLD).sum(1) - 1).tolist()))


def test_bounds_lose_nothing():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 40)) * rng.choice([1e-6, 1, 1e6], size=(200, 1))
    b = np.vstack((a[:100] * 3 + 0.0, rng.normal(size=(50, 40))))
    i, j = E.close_pairs(a, b, 0.3)
    exact = E.unit(a) @ E.unit(b).T >= 0.3
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(exact))))


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [1.0, 0.0], 0), (8, [1.0, 0.1, 0.0], 0), (9, [], 0), (None, [0.0, 1.0], 0), (9, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 8, 9)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (7, 2, 1, False), (None, 1, 9, False), (9, 1, 9, True), *alone], key=str)
    assert E.near_vectors(df.limit(0)).collect() == []
