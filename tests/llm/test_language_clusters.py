"""Outliers make no centroid of their own, and texts that are never rejected set no distance."""

import numpy as np

from wardloom.llm import langid


def test_clusters_hold_many_texts():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(0, 0.05, (203, 40)))
    for i in range(200):
        x[i, i % 2] += 1
    for i in range(3):
        x[200 + i, 30 + i] += 5
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c, of = langid._cluster(x, 4)
    sizes = np.bincount(of, minlength=len(c))
    assert len(c) >= 2 and sizes.sum() == 203 and sizes.min() >= 203 / 50
    assert of[0] != of[1]
    assert np.allclose(langid._cluster(x[:1], 4)[0], x[:1]) and len(langid._cluster(np.repeat(x[:1], 5, axis=0), 4)[0]) == 1
