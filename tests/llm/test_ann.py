"""Nearest neighbours against brute force: recall, scores, ties, vectors that take no part."""

import numpy as np

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def _frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0) for i, v in zip(ids, vectors)], SCHEMA)


def _exact(ids, vectors, k=5):
    v = np.array(vectors, np.float32).astype(float)
    out = {}
    for i in ids:
        if i % 50 == 0:
            q = v[ids.index(i)]
            pairs = sorted((-(q @ v[j]) / np.sqrt((q @ q) * (v[j] @ v[j])), o) for j, o in enumerate(ids) if o != i)
            out[i] = pairs[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24)) * 2
    vectors = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    vectors[2000:2600] = vectors[7]  # one vector that a fifth of the rows share
    ids = list(range(3000))
    got = {}
    for r in ann.nearest(_frame(spark, ids, vectors)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    exact = _exact(ids, vectors)
    assert set(got) == set(exact)
    hits = 0
    for q, pairs in exact.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        found = [got[q][k] for k in range(1, 6)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += sum(abs(s + e) < 1e-12 for (_, s), (e, _) in zip(found, pairs))
        for i, s in found:
            a, b = vectors[q].astype(float), vectors[i].astype(float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert hits / (5 * len(exact)) >= 0.9
    assert [i for i, _ in (got[2000][k] for k in range(1, 6))] == [7, 2001, 2002, 2003, 2004]  # ties to the smaller id


def test_vectors_without_part_and_small_tables(spark):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 50, 50, None]
    vectors = [[1, 0], [2, 0], [0, 0], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [0, 1], [0, 1], [1, 1]]
    rows = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(_frame(spark, ids, vectors)).collect())
    assert rows == [(0, 1, 1, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(_frame(spark, [0], [[1, 2]])).count() == 0


def _index(x, queries):
    """(recall of the five nearest, pairs compared as a share of brute force) of the index over unit vectors."""
    graph = ann.CentroidGraph(ann.halved(x, 1 << round(np.log2(len(x) / ann.LIST_SIZE)))).measure(x[:: len(x) // ann.PROBES])
    lists = len(graph.centroids)
    held = np.zeros((len(x), lists), bool)
    for at in range(0, len(x), 1024):
        ids, kept = ann.lists_holding(graph, x[at : at + 1024])
        row, column = np.nonzero(kept)
        held[at + row, ids[row, column]] = True
    sizes, hits, pairs = held.sum(axis=0), 0, 0
    for at in range(0, len(queries), 64):
        own = queries[at : at + 64]
        ids, kept = ann.lists_scanned(graph, x[own])
        scores = x[own] @ x.T
        scores[np.arange(len(own)), own] = -2
        for i, top in enumerate(np.argsort(-scores, axis=1)[:, :5]):
            asked = ids[i][kept[i]]
            pairs += sizes[asked].sum()
            hits += held[top][:, asked].any(axis=1).sum()
    return hits / (5 * len(queries)), pairs / (len(queries) * len(x))


def test_recall_and_work_on_uniform_and_clustered_vectors():
    """At 50,000 vectors the index compares under 0.15 of all pairs and finds nine of ten neighbours."""
    rng = np.random.default_rng(6)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    recall, work = _index(unit(rng.normal(size=(50_000, 64))), np.arange(0, 50_000, 125))
    assert recall >= 0.9 and work < 0.15
    centres = rng.normal(size=(500, 64))
    recall, work = _index(unit(centres[rng.integers(0, 500, 20_000)] + 0.4 * rng.normal(size=(20_000, 64))), np.arange(0, 20_000, 100))
    assert recall >= 0.95 and work < 0.05


def test_queries_that_find_too_few_are_held_against_all(spark):
    """Lists that one key's vectors fill: every query still gets its five neighbours."""
    rng = np.random.default_rng(8)
    crowd = np.tile(rng.normal(size=(1, 12)), (900, 1)) + rng.normal(size=(900, 12)) * 1e-3
    vectors = np.concatenate([crowd, rng.normal(size=(12, 12))]).astype(np.float32)
    ids = [50] * 900 + list(range(100, 112))
    got = {}
    for r in ann.nearest(_frame(spark, ids, vectors)).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(set(x)) for q, x in got.items()} == {50: 5, 100: 5}


def test_graph_finds_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.CentroidGraph(ann.halved(x, 256))
    ids, far = graph.nearest(x[:200], 8)
    true = np.argsort(-(x[:200] @ graph.centroids.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, true)]) > 0.9
    assert (np.diff(far, axis=1) >= 0).all() and all(len(set(r)) == 8 for r in ids.tolist())


def test_ratios_decide():
    """The ratios are those of the data: lists are dropped by them, and not every vector is at a boundary."""
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(6_000, 64)), rng.normal(size=(60, 64))[rng.integers(0, 60, 6_000)] + 0.2 * rng.normal(size=(6_000, 64))):
        x = ann._unit(x)
        graph = ann.CentroidGraph(ann.halved(x[:4_000], 512)).measure(x[:1_000])
        _, held = ann.lists_holding(graph, x[4_000:])
        assert 0.1 < (held.sum(axis=1) < ann.REPLICAS).mean() < 0.6 and (held.sum(axis=1) == 1).any()
        _, scanned = ann.lists_scanned(graph, x[4_000:])
        n = scanned.sum(axis=1)
        assert n.min() < 0.7 * n.max() and (n < scanned.shape[1]).mean() > 0.3 and n.min() >= ann.LEAST
