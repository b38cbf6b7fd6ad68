"""Exact nearest neighbours against brute force, and what is left out on the way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclens.operators import neighbours as nb

SCHEMA = "vec_id long, label int, vector array<double>"


def by_force(train, test, k):
    out = {}
    for i, label, v in test:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 9), j) for j, _, w in train)[:k]
        out[(i, label)] = [j for _, j in near]
    return out


def got(found):
    out = {}
    for r in found.best.orderBy("id", "label", "r").collect():
        out.setdefault((r["id"], r["label"]), []).append(r["t_id"])
    return out


def clustered(n, seed=1, width=3, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 20
    return [(k, int(k % centres), (middle[k % centres] + rng.normal(size=width)).tolist()) for k in range(n)]


def grid(n):
    rng = np.random.default_rng(2)
    return [(k, int(rng.integers(3)), rng.integers(0, 3, 4).astype(float).tolist()) for k in range(n)]


def hot(n):
    return [(k, k % 4, [1.0, 2.0] if k % 3 else [float(k), -float(k % 7)]) for k in range(n)]  # most rows are one point


@pytest.mark.parametrize("make", [clustered, grid, hot])
@pytest.mark.parametrize("block_rows", [16, 1000])
def test_neighbours_by_force(spark, make, block_rows):
    rows = make(260)
    train, test = rows[60:], rows[:60]
    found = nb.neighbours(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA).repartition(3), 5, block_rows=block_rows)
    assert got(found) == by_force(train, test, 5)


def test_votes(spark):
    rows = grid(120)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["vec_id"]: r["predicted"] for r in nb.knn_predictions(frame.filter("vec_id >= 30"), frame.filter("vec_id < 30"), block_rows=16).collect()}
    label = {i: c for i, c, _ in rows}
    for (i, _), near in by_force(rows[30:], rows[:30], 5).items():
        votes = [label[j] for j in near]
        assert found[i] == min(set(votes), key=lambda x: (-votes.count(x), x))


def test_excluded_blocks_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(nb, "VISITORS", 20)
    rows = clustered(1300)
    train, test = rows[100:], rows[:100]
    found = nb.neighbours(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), 5, block_rows=50)
    assert got(found) == by_force(train, test, 5)
    assert found.pairs_compared() < 0.4 * len(train) * len(test)


def test_no_task_gets_every_visitor_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(nb, "VISITORS", 8)
    met = []
    original = nb.cut
    monkeypatch.setattr(nb, "cut", lambda df, name: met.append((name, out := original(df, name))) or out)
    rows = hot(200)
    nb.neighbours(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), 5, block_rows=20)
    sizes = [df.agg(F.max(F.size("visitor_items"))).first()[0] for name, df in met if name == "visitors"]
    assert len(sizes) == 2 and max(sizes) < 40  # 200 queries in 25 slots
    blocks = next(df for name, df in met if name == "blocks")
    assert blocks.agg(F.max(F.size("block_items"))).first()[0] < 60


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, None, [0.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 2.0]), (4, 2, None), (None, 2, [0.0, 0.0])], SCHEMA)
    found = nb.neighbours(frame, frame, 5)
    assert got(found) == {(1, None): [1, 2, 3], (2, 1): [2, 1, 3], (3, 1): [3, 2, 1]}
    assert {r["vec_id"]: r["predicted"] for r in nb.knn_predictions(frame, frame).collect()} == {1: 1, 2: 1, 3: 1}
    assert nb.knn_predictions(frame.limit(0), frame).count() == nb.knn_predictions(frame, frame.limit(0)).count() == 0


def test_visits_of_many_rings_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(nb, "AT_ONCE", 64)
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, rng.normal(size=16).tolist()) for k in range(600)]
    asked = nb._rows(spark.createDataFrame(rows[:100], SCHEMA), "vec_id", "vector", "label").withColumn("far", F.lit(float("inf")))
    blocks, rings = nb.partitioned(nb._rows(spark.createDataFrame(rows[100:], SCHEMA), "vec_id", "vector", "label"), 8)
    kept = []

    class Seen:
        def __init__(self, frame):
            self.sparkSession, self.frame = frame.sparkSession, frame

        def mapInArrow(self, run, schema):
            kept.append([b.num_rows for b in run(iter(self.frame.toArrow().to_batches()))])
            return self.frame.mapInArrow(run, schema)

    visits = nb._visits(Seen(asked), rings, 5, False)
    n = blocks.count()
    assert visits.count() == sum(kept[0]) == 100 * n
    assert max(kept[0]) < 64 + n


def test_queries_that_visit_every_block_are_written_once(spark, monkeypatch):
    met = []
    original = nb.cut
    monkeypatch.setattr(nb, "cut", lambda df, name: met.append((name, out := original(df, name))) or out)
    rng = np.random.default_rng(6)
    rows = [(k, k % 3, rng.normal(size=16).tolist()) for k in range(500)]
    found = nb.neighbours(spark.createDataFrame(rows[100:], SCHEMA), spark.createDataFrame(rows[:100], SCHEMA), 5, block_rows=20)
    assert got(found) == by_force(rows[100:], rows[:100], 5)
    assert found.pairs_compared() > 0.5 * 100 * 400  # little is excluded
    groups = [df for name, df in met if name == "visitors"][1]
    assert groups.agg(F.sum(F.size("visitor_items"))).first()[0] == 100


@pytest.mark.parametrize("width", [2, 40])
def test_rounding_of_the_first_look_loses_nothing(spark, width):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=width) * 1e4  # far from the origin, where single precision tells little apart
    rows = [(k, 1, (np.float32(middle) + np.float32(rng.integers(0, 3, width))).astype(float).tolist()) for k in range(150)]
    rows += [(150 + k, 2, (rng.normal(size=width) * (1e12 if k == 7 else 1)).tolist()) for k in range(150)]
    train, test = rows[::2], rows[1::2]
    found = nb.neighbours(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), 5, block_rows=30)
    ours, theirs = got(found), by_force([r for r in train], test, 5)
    assert {i: v for i, v in ours.items() if i[0] != 157} == {i: v for i, v in theirs.items() if i[0] != 157}


def test_blocks_grow_with_the_tables():
    assert nb._grown(512, 40_000, 64) == 512 and nb._grown(512, 200_000, 64) == 512 * 6 and nb._grown(512, 10**9, 64) == 512 * nb.LARGEST
    assert nb._grown(8, 200, 16) == 8


def test_many_candidates_are_compared_a_few_at_a_time():
    """Peak memory of a block's comparison: before, 2^16 pairs of vectors were held at once."""
    import tracemalloc

    rng = np.random.default_rng(11)
    x, rows = rng.normal(size=(512, 128)), rng.normal(size=(600, 128))
    labels = pa.array(np.arange(600) % 3)
    best = nb.Best(np.arange(512), pa.array(np.zeros(512, dtype=np.int64)), x, 300, np.full(512, np.inf))
    tracemalloc.start()
    try:
        best.look(np.arange(600), labels, rows, np.arange(512))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20
    exact = np.round(((x[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2), 9)
    assert (best.near == np.lexsort((np.broadcast_to(np.arange(600), exact.shape), exact), axis=1)[:, :300]).all()


def test_batches_of_large_rows_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = spark.createDataFrame([(k, k % 2, [float(k), 1.0]) for k in range(20)], "vec_id long, label int, vector array<double>")
    nb.neighbours(rows.filter("vec_id >= 5"), rows.filter("vec_id < 5"), 2)
    assert int(spark.conf.get(key)) <= 8 << 20


def test_vectors_are_written_not_held_in_memory(spark):
    """What is held in the executors' memory stays there beside all that follows."""
    from doclens import session

    rows = spark.createDataFrame([(k, k % 3, [float(k), float(k * k % 7)]) for k in range(60)], "vec_id long, label int, vector array<float>")
    before = len(session._held)
    assert nb.knn_predictions(rows.filter("vec_id % 5 > 0"), rows.filter("vec_id % 5 = 0")).count() == 12
    assert len(session._held) == before
