"""The convolutional network: gradients, independence of partitions, learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.operators import network as nw

TINY = (nw.Conv(3), nw.Pool(), nw.Conv(4, 2), nw.Dense(5), nw.Dropout(0.4))


@pytest.mark.parametrize("layers", [TINY, (nw.Dense(4),), (nw.Conv(2, 3), nw.Conv(3, 2), nw.Pool(3), nw.Dense(3, relu=False)), ()])
def test_gradient_is_numeric(layers):
    rng = np.random.default_rng(1)
    network = nw.Network(9, 3, layers)
    weights = network.drawn(2) + rng.normal(0, 0.05, network.size)
    x, y = rng.random((4, 9, 9, 1)), np.array([0, 2, 1, 1])
    loss = lambda w: network.gradient(w, x, y, np.random.default_rng(7))[1]
    found = network.gradient(weights, x, y, np.random.default_rng(7))[0]
    for k in rng.choice(network.size, min(60, network.size), replace=False):
        step = np.zeros(network.size)
        step[k] = 1e-6
        assert found[k] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-6, abs=2e-5)


def test_convolution_by_force():
    rng = np.random.default_rng(3)
    x, w, b = rng.random((2, 5, 5, 1)), rng.normal(size=(9, 2)), rng.normal(size=2)
    network = nw.Network(5, 2, (nw.Conv(2),))
    weights = np.concatenate([w.ravel(), b, np.zeros(network.size - 20)])
    _, trail = network.forward(weights, x)
    for n, i, j, f in np.ndindex(2, 3, 3, 2):
        value = (x[n, i : i + 3, j : j + 3, 0].ravel() * w[:, f]).sum() + b[f]
        assert trail[0][3][n, i, j, f] == (value > 0)


def test_published_layers_and_sizes():
    assert nw.Network(128, 16).size == 320 + 18496 + 36928 + (28 * 28 * 64 * 64 + 64) + 65 * 16
    with pytest.raises(ValueError, match="too small"):
        nw.Network(8, 3)


def shapes(spark, n=240, side=10):
    """Bars that lie, stand, or are not there."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        image, kind = rng.random((side, side)) * 0.3, k % 3
        if kind < 2:
            image[rng.integers(1, side - 1), :] += 0.7
        rows.append((k, None if kind == 2 else kind, (image.T if kind else image).ravel().tolist()))
    return spark.createDataFrame(rows, "img_id long, label int, tensor array<double>")


def test_same_weights_for_any_partitioning_and_tree(spark, monkeypatch):
    rows, training = shapes(spark, 90), nw.Training(epochs=2, steps=2)
    monkeypatch.setattr(nw, "BLOCK_ROWS", 10)
    found = [nw.train(rows.repartition(p), 10, training, TINY) for p in (1, 8)]
    assert np.array_equal(found[0].weights, found[1].weights) and found[0].history == found[1].history
    monkeypatch.setattr(nw, "BRANCHES", 2)
    tree = nw.train(rows.repartition(3), 10, training, TINY)
    assert np.allclose(tree.weights, found[0].weights, rtol=0, atol=1e-9)


def test_it_learns_and_keeps_a_history(spark):
    rows = shapes(spark)
    trained = nw.train(rows, 10, nw.Training(epochs=12, steps=3, rate=0.01), (nw.Conv(6), nw.Pool(), nw.Dense(16), nw.Dropout(0.1)))
    history = nw.history_rows(trained, rows).orderBy("epoch").collect()
    assert len(history) == 12 and history[-1]["val_accuracy"] > 0.9 and history[-1]["loss"] < history[0]["loss"]
    found = nw.predict(trained, rows)
    assert found.columns == ["img_id", "label", "predicted"]
    assert found.agg(F.avg(F.col("label").eqNullSafe(F.col("predicted")).cast("double"))).first()[0] > 0.95


def test_odd_tables(spark):
    rows = shapes(spark, 4)
    empty = nw.train(rows.limit(0), 10, nw.Training(epochs=1, steps=1), TINY)
    assert np.array_equal(empty.weights, nw.Network(10, 1, TINY).drawn(42))
    assert nw.predict(nw.train(rows, 10, nw.Training(epochs=1, steps=1), TINY), rows.limit(0)).count() == 0
    twice = nw.train(rows.unionByName(rows), 10, nw.Training(epochs=1, steps=1, validation=0), TINY)
    assert twice.history[0][2] == 0 and sum(h[1] for h in twice.history) <= 1
