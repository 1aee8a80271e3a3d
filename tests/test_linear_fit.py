"""The linear fit, whose sums go in several blocks, against the conditions that its solution meets."""

import numpy as np

from wardloom.operators import probes as P


def test_sums_of_several_blocks(spark):
    dim, n = 140, 300
    assert (dim + 1) * (dim + 2) // 2 + dim + 1 > P.BLOCK
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    frame = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "v array<double>, a int").repartition(5)
    w = P.fit_linear(frame, "v", ["a"])["a"]
    a = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(n)])
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    gradient = a.T @ (weight * (1 / (1 + np.exp(-a @ w)) - y)) + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-6
    assert P.fit_linear(frame.where("a = 1"), "v", ["a"]) == {}
