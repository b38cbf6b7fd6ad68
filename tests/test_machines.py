"""Kernel and linear machines against plain solvers and the conditions of optimality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.operators import machines as mc


def clouds(n=150, classes=3, seed=1, spread=0.9, width=2):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return rng.normal(size=(n, width)) * spread + np.stack([np.cos(2 * np.pi * y / classes), np.sin(2 * np.pi * y / classes)] + [0 * y] * (width - 2), axis=1), y


def objective(x, y, alpha, gamma):
    v = alpha * y
    return alpha.sum() - v @ mc.rbf(x, x, gamma) @ v / 2


def projected(x, y, kernel, rounds=40_000):
    """The dual by projected gradient steps; the projection on box and balance by bisection."""
    q = np.outer(y, y) * mc.rbf(x, x, kernel.gamma)
    step, alpha = 1 / np.linalg.eigvalsh(q)[-1], np.zeros(len(y))
    for _ in range(rounds):
        free = alpha + step * (1 - q @ alpha)
        lo, hi = -1e3, 1e3
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (y * np.clip(free - mid * y, 0, kernel.cost)).sum() > 0 else (lo, mid)
        alpha = np.clip(free - lo * y, 0, kernel.cost)
    return alpha


@pytest.mark.parametrize("cost", [0.5, 10.0])
def test_dual_against_projected_gradients(cost):
    x, place = clouds(40, 2)
    y, kernel = np.where(place == 0, 1.0, -1.0), mc.Kernel(cost=cost, gamma=0.5, tolerance=1e-6)
    alpha, bias = mc.solve_dual(x, y, kernel)
    assert abs((alpha * y).sum()) < 1e-9 and alpha.min() >= 0 and alpha.max() <= cost
    assert objective(x, y, alpha, 0.5) == pytest.approx(objective(x, y, projected(x, y, kernel, 4000), 0.5), rel=1e-3)
    margin = y * (mc.rbf(x, x, 0.5) @ (alpha * y) + bias)
    assert (margin[alpha == 0] > 1 - 1e-4).all() and (margin[alpha == cost] < 1 + 1e-4).all()
    assert np.allclose(margin[(alpha > 0) & (alpha < cost)], 1, atol=1e-4)


def frame(spark, x, y):
    return spark.createDataFrame([(f"{k}", int(c), v.tolist()) for k, (c, v) in enumerate(zip(y, x, strict=True))], "id string, place int, x array<double>")


def test_cascade_reaches_the_optimum_of_all_rows(spark):
    x, place = clouds(240)
    kernel, pairs = mc.Kernel(gamma=0.5, tolerance=1e-4, block_rows=20), [(0, 1), (0, 2), (1, 2)]
    machines = mc.cascade(frame(spark, x, place), pairs, kernel)
    for k, (a, b) in enumerate(pairs):
        own = np.isin(place, (a, b))
        xs, y = x[own], np.where(place[own] == a, 1.0, -1.0)
        alpha, bias = mc.solve_dual(xs, y, kernel)
        vectors, weights, found_bias = machines[k]
        assert objective(vectors, np.sign(weights), np.abs(weights), 0.5) == pytest.approx(objective(xs, y, alpha, 0.5), rel=1e-4)
        assert found_bias == pytest.approx(bias, abs=5e-3)
        margin = y * mc._decide(xs, machines[k], 0.5)
        inside = np.array([not (np.abs(vectors - v).sum(axis=1) == 0).any() for v in xs])
        assert (margin[inside] > 1 - 1e-3).all()


def test_kernel_predictions(spark):
    x, place = clouds(300, spread=0.3)
    rows = [(k, None if c == 1 else int(c), v.tolist()) for k, (c, v) in enumerate(zip(place, x, strict=True))]
    table = spark.createDataFrame([*rows, *rows[:20]], "vec_id long, label int, vector array<double>")
    found = mc.kernel_predictions(table, table, mc.Kernel(gamma=mc.scale_gamma(table), block_rows=50))
    assert found.count() == 320
    assert found.agg(F.avg(F.col("label").eqNullSafe(F.col("predicted")).cast("double"))).first()[0] > 0.97
    one = table.filter("label = 2")
    assert {r["predicted"] for r in mc.kernel_predictions(one, table, mc.Kernel()).collect()} == {2}
    assert {r["predicted"] for r in mc.kernel_predictions(table.limit(0), one, mc.Kernel()).collect()} == {None}


def test_scale_gamma(spark):
    table = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "vector array<double>")
    assert mc.scale_gamma(table) == pytest.approx(1 / (2 * np.var([1, 2, 3, 6])))
    assert mc.scale_gamma(spark.createDataFrame([([1.0, 1.0],)], "vector array<double>")) == 1.0


def plain_squared_hinge(x, y, cost):
    """Newton's method with whole Hessians; the bias is a component like the others."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    loss = lambda w: w @ w / 2 + cost * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(200):
        short = np.maximum(0, 1 - y * (x @ w))
        g = w - 2 * cost * x.T @ (short * y)
        if np.abs(g).max() < 1e-9:
            break
        near = x[short > 0]
        p = -np.linalg.solve(np.eye(len(w)) + 2 * cost * near.T @ near, g)
        t = 1.0
        while loss(w + t * p) > loss(w) + 1e-4 * t * g @ p:
            t /= 2
        w = w + t * p
    return w


@pytest.mark.parametrize("cost", [1.0, 20.0])
def test_squared_hinge_against_a_plain_solver(spark, cost, monkeypatch):
    monkeypatch.setattr(mc, "BRANCHES", 2)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((200, 12)) < 0.3, rng.normal(size=(200, 12)), 0)
    place = (x @ rng.normal(size=(12, 3)) + rng.normal(size=(200, 3)) * 0.5).argmax(axis=1)
    rows = [(k, int(c), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for k, (c, v) in enumerate(zip(place, x, strict=True))]
    table = spark.createDataFrame(rows, "id long, place int, at array<int>, x array<double>")
    original = mc._Rows.__init__
    monkeypatch.setattr(mc._Rows, "__init__", lambda self, r, terms, classes, block_rows=40: original(self, r, terms, classes, block_rows))
    w = mc.squared_hinge(table, 12, 3, mc.Linear(cost=cost, tolerance=1e-6))
    for k in range(3):
        assert np.abs(w[k] - plain_squared_hinge(x, np.where(place == k, 1.0, -1.0), cost)).max() < 1e-3
    found = mc.linear_predictions(table.withColumn("label", F.col("place").cast("string")), w, ["0", "1", "2"]).orderBy("id").collect()
    assert [int(r["predicted"]) for r in found] == (x @ w[:, :-1].T + w[:, -1]).argmax(axis=1).tolist()


def test_linear_machine_on_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, place int, at array<int>, x array<double>")
    assert not mc.squared_hinge(empty, 3, 2).any()
    bare = spark.createDataFrame([(1, 0, [], []), (2, 0, [], []), (3, 1, [1], [2.0])], empty.schema)
    w = mc.squared_hinge(bare, 3, 2)
    assert w.shape == (2, 4) and w[0, -1] > w[1, -1]
    assert mc.linear_predictions(empty.withColumn("label", F.lit("a")), w, ["a", "b"]).count() == 0


def test_dual_by_parts_is_the_dual_of_the_whole_matrix(monkeypatch):
    x, place = clouds(400, 2, width=5)
    y, kernel = np.where(place == 0, 1.0, -1.0), mc.Kernel(gamma=0.3, tolerance=1e-5)
    whole, bias = mc.solve_dual(x, y, kernel)
    seen, original = [], mc.rbf
    monkeypatch.setattr(mc, "WHOLE_ROWS", 100)
    monkeypatch.setattr(mc, "PART_BYTES", 40 * 8 * 400)
    monkeypatch.setattr(mc, "rbf", lambda a, b, gamma: seen.append(len(a) * len(b)) or original(a, b, gamma))
    for start in (None, whole):
        seen.clear()
        alpha, found = mc.solve_dual(x, y, kernel, start)
        assert max(seen) <= 40 * 400  # never the whole matrix
        assert objective(x, y, alpha, 0.3) == pytest.approx(objective(x, y, whole, 0.3), rel=1e-6)
        assert found == pytest.approx(bias, abs=1e-3) and abs((alpha * y).sum()) < 1e-9


def test_predictions_bring_no_support_vectors_to_the_driver(spark, monkeypatch):
    x, place = clouds(120, spread=0.3)
    table = spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(place, x, strict=True))], "vec_id long, label int, vector array<double>")
    kernel = mc.Kernel(gamma=0.5, block_rows=30)
    once = sorted(map(tuple, mc.kernel_predictions(table, table, kernel).collect()))
    monkeypatch.setattr(mc, "cascade", lambda *a: pytest.fail("the model came to the driver"))
    monkeypatch.setattr(mc, "GROUP_ROWS", 25)  # many groups of rows and of support vectors
    assert sorted(map(tuple, mc.kernel_predictions(table, table, kernel).collect())) == once


@pytest.mark.parametrize(("held", "copies"), [(1 << 28, 0), (1 << 20, 0), (1, 0), (1 << 28, 40)])
def test_active_sets_reach_the_optimum_of_the_whole_dual(monkeypatch, held, copies):
    x, place = clouds(700, 2, spread=2.0, width=6 if copies else 26)
    x[600 : 600 + copies], place[600 : 600 + copies] = x[:copies], 1 - place[:copies]  # the same rows in both classes
    y, kernel = np.where(place == 0, 1.0, -1.0), mc.Kernel(gamma=1 / (4 * x.shape[1]))
    whole, bias = mc.solve_dual(x, y, kernel)
    monkeypatch.setattr(mc, "HELD_BYTES", held)
    monkeypatch.setattr(mc, "TILE", 100)
    if not copies:  # sets that do not settle are solved on by the plain solver
        monkeypatch.setattr(mc, "solve_dual", lambda *a: pytest.fail("the sets did not settle"))
    alpha, found = mc.solve_pair(x.astype(np.float32), y, kernel)
    assert abs((alpha * y).sum()) < 1e-8 and alpha.min() >= 0 and alpha.max() <= kernel.cost
    assert mc._gap(y, alpha, y * (mc.rbf(x, x, kernel.gamma) @ (alpha * y)) - 1, kernel.cost) < 2 * kernel.tolerance
    assert objective(x, y, alpha, kernel.gamma) == pytest.approx(objective(x, y, whole, kernel.gamma), rel=1e-4)
    assert found == pytest.approx(bias, abs=5e-3)


def test_pairs_that_fit_need_no_cascade_and_predict_alike(spark, monkeypatch):
    x, place = clouds(900, spread=0.3)
    table = spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(place, x, strict=True))], "vec_id long, label int, vector array<double>")
    kernel, original = mc.Kernel(gamma=0.5, block_rows=700), mc.cascaded
    monkeypatch.setattr(mc, "cascaded", lambda *a: pytest.fail("a cascade of pairs that fit"))
    whole = sorted(map(tuple, mc.kernel_predictions(table, table, kernel).collect()))
    monkeypatch.setattr(mc, "cascaded", original)
    monkeypatch.setattr(mc, "PAIR_ROWS", 100)
    cascade = sorted(map(tuple, mc.kernel_predictions(table, table, kernel).collect()))
    assert len(whole) == 900 and sum(a != b for a, b in zip(whole, cascade, strict=True)) <= 2  # values at the border, within the tolerance
