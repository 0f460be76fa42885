"""Clustering against a plain implementation; curve, boxes and odd rows."""

import hashlib
from collections import Counter

import numpy as np

from tidemark.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, cluster int, `a.b` string, X int"


def rows(n, dims=64, centres=None, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.15, (n, dims)) if centres is None else rng.normal(0, 1, (centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, 0.02, (n, dims))
    return [(i, v.astype(np.float32).tolist(), 1, "x", 2) for i, v in enumerate(x)]


def plain(table, k, dims, rounds=3):
    kept = [(r[0], [int(np.floor(64 * float(x))) for x in r[1]]) for r in table if r[1] and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [r[1] for r in start]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids)) for _, x in kept]
        if turn < rounds:
            for i in range(len(centroids)):
                if members := [x for (_, x), (_, j) in zip(kept, own) if j == i]:
                    centroids[i] = [sum(col) // len(members) for col in zip(*members)]
    sums = Counter()
    for d, i in own if kept else ():
        sums[i] += d
    return Counter((key, i, d, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for (key, _), (d, i) in zip(kept, own)) if kept else Counter()


def test_against_plain(spark):
    table = rows(700) + rows(90, centres=3, seed=4)
    zero, big = [0.0] * 64, [1e6, -1e6] * 32
    odd = [(1000 + i, v, 1, None, 0) for i, v in enumerate([None, [], [1.0] * 63, [None, *zero[1:]], [float("nan"), *zero[1:]], [float("inf"), *zero[1:]], zero, zero, big])]
    table += odd + [(None, zero, 1, "", 1), (5, zero, 1, "", 1)] + [table[3]] * 300
    df = spark.createDataFrame(table, SCHEMA).repartition(7)
    assert Counter(tuple(r) for r in cl.cluster(df).collect()) == plain(table, 16, 64)
    assert Counter(tuple(r) for r in cl.cluster(df, block=5, k=3).collect()) == plain(table, 3, 64)


def test_few_and_none(spark):
    table = rows(5)
    assert Counter(tuple(r) for r in cl.cluster(spark.createDataFrame(table, SCHEMA)).collect()) == plain(table, 16, 64)
    empty = spark.createDataFrame([], SCHEMA)
    assert cl.cluster(empty).collect() == [] and len(cl.cluster(empty).columns) == 6


def test_curve_is_a_hilbert_curve():
    """All cells once, and each step to a neighbour along one axis."""
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2), (5, 2), (7, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = [bytes(k) for k in cl.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all(), (dims, bits)


def test_boxes_lose_no_centroid():
    rng = np.random.default_rng(7)
    for _ in range(400):
        dims, size = int(rng.integers(1, 6)), int(rng.choice([3, 50, 2**27]))
        c, x = rng.integers(-size, size + 1, (6, dims)), rng.integers(-size, size + 1, (8, dims)) // int(rng.integers(1, 9))
        c[3] = c[1]  # ties
        among = cl.candidates(x.min(axis=0), x.max(axis=0), c)
        got = cl.nearest(x, c, among)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c)) for v in x]
        assert list(zip(got[1].tolist(), got[0].tolist())) == want


def test_boxes_prune_clustered_vectors(spark):
    clustered, uniform = (spark.createDataFrame(t, SCHEMA) for t in (rows(4000, centres=16), rows(1000)))
    assert cl.compared(clustered) < 0.35 and cl.compared(uniform) <= 1
