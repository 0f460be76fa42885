"""Repeated rows take no places from other neighbours."""

import numpy as np

from tests.llm.test_ann import _exact, _frame
from tidemark.llm import ann


def _lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_every_row_five_times(spark):
    vectors = np.random.default_rng(2).normal(size=(120, 8)).astype(np.float32)
    ids = list(range(120))
    once = _lists(ann.nearest(_frame(spark, ids, vectors)).collect())
    assert once == {q: [i for _, i in pairs] for q, pairs in _exact(ids, vectors).items()}  # few lists: all are scanned
    assert _lists(ann.nearest(_frame(spark, ids * 5, np.concatenate([vectors] * 5))).collect()) == once


def test_one_key_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 8)).astype(np.float32)
    near = vectors[0] + rng.normal(size=(60, 8)).astype(np.float32) * 0.01  # sixty different vectors of one key
    ids = list(range(120)) + [7] * 60
    got = _lists(ann.nearest(_frame(spark, ids, np.concatenate([vectors, near]))).collect())
    others = [(-(vectors[0] @ vectors[j]) / np.linalg.norm(vectors[j]), j) for j in range(1, 120) if j != 7]
    assert got[0] == [7] + [j for _, j in sorted(others)[:4]]
    assert all(len(set(x)) == 5 for x in got.values())
