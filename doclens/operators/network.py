"""A convolutional network trained by synchronous data-parallel gradient descent (M10), and its training history.

Images are packed once into blocks by a hash of their id, a bounded number of rows each, sorted by id. In every step each
block's gradient is computed where the block lies, from weights that are broadcast (their size is that of the network,
whatever the data), and gradients are added up by a tree of shuffles, BRANCHES blocks at a time in order of their number. A
sum's order does not depend on how blocks are spread, so the weights are the same for any number of partitions, and a task
that is run again adds the same. The driver sees one gradient a step and applies Adam to it.

Defined cases. A null label is a class of its own, and sorts first. A null tensor raises. Rows that share an id are rows of
their own. Without training rows the weights stay as they were drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.session import hold

BLOCK_ROWS = 512
BRANCHES = 32
#: Images that go through the layers together.
PART = 64


@dataclass(frozen=True)
class Conv:
    filters: int
    size: int = 3


@dataclass(frozen=True)
class Pool:
    size: int = 2


@dataclass(frozen=True)
class Dense:
    units: int
    relu: bool = True


@dataclass(frozen=True)
class Dropout:
    rate: float


Layer = Conv | Pool | Dense | Dropout

#: The published network, but for its last layer, which has a unit a class.
DOCUMENT_LAYERS: tuple[Layer, ...] = (Conv(32), Pool(), Conv(64), Pool(), Conv(64), Dense(64), Dropout(0.3))


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """Every k x k window of (n, h, w, c) as a row: (n, h - k + 1, w - k + 1, c * k * k)."""
    seen = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))
    return seen.reshape(*seen.shape[:3], -1)


class Network:
    """Layers on images of one channel, softmax at the end; weights are one flat vector."""

    def __init__(self, side: int, classes: int, layers: tuple[Layer, ...] = DOCUMENT_LAYERS):
        self.side, self.layers = side, (*layers, Dense(classes, relu=False))
        self.shapes: list[tuple[int, ...]] = []
        self.limits: list[float] = []
        h, c, flat = side, 1, 0
        for layer in self.layers:
            if isinstance(layer, Conv):
                self.shapes += [(c * layer.size**2, layer.filters), (layer.filters,)]
                self.limits += [(6 / ((c + layer.filters) * layer.size**2)) ** 0.5, 0.0]
                h, c = h - layer.size + 1, layer.filters
            elif isinstance(layer, Pool):
                h //= layer.size
            elif isinstance(layer, Dense):
                self.shapes += [(flat or h * h * c, layer.units), (layer.units,)]
                self.limits += [(6 / sum(self.shapes[-2])) ** 0.5, 0.0]
                flat = layer.units
            if h < 1:
                raise ValueError(f"images of side {side} are too small for these layers")
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def drawn(self, seed: int) -> np.ndarray:
        """Uniform weights scaled by fan-in and fan-out, biases 0."""
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-limit, limit, shape).ravel() for shape, limit in zip(self.shapes, self.limits, strict=True)])

    def _split(self, weights: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            yield weights[at : at + n].reshape(shape)
            at += n

    def forward(self, weights: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Log-probabilities, and what each layer needs to go back. With rng, units are dropped out."""
        own, trail = self._split(weights), []
        for layer in self.layers:
            if isinstance(layer, Conv):
                w, b = next(own), next(own)
                seen = _windows(x, layer.size)
                y = seen @ w + b
                trail.append((seen, w, x.shape, y > 0))
                x = np.maximum(y, 0)
            elif isinstance(layer, Pool):
                k, (n, h, v, c) = layer.size, x.shape
                cells = x[:, : h // k * k, : v // k * k].reshape(n, h // k, k, v // k, k, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, h // k, v // k, c, k * k)
                best = cells.argmax(axis=-1)
                trail.append((best, x.shape))
                x = np.take_along_axis(cells, best[..., None], axis=-1)[..., 0]
            elif isinstance(layer, Dense):
                w, b = next(own), next(own)
                flat = x.reshape(len(x), -1)
                y = flat @ w + b
                trail.append((flat, w, x.shape, y > 0))
                x = np.maximum(y, 0) if layer.relu else y
            else:
                kept = None if rng is None else (rng.random(x.shape) >= layer.rate) / (1 - layer.rate)
                trail.append(kept)
                x = x if kept is None else x * kept
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True)), trail

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, float, int]:
        """Sum over the images of the gradient of the cross entropy, of the cross entropy, and of right answers."""
        log_p, trail = self.forward(weights, x, rng)
        rows = np.arange(len(y))
        loss, right = -float(log_p[rows, y].sum()), int((log_p.argmax(axis=1) == y).sum())
        d = np.exp(log_p)
        d[rows, y] -= 1
        out: list[np.ndarray] = []
        for layer, kept in zip(reversed(self.layers), reversed(trail), strict=True):
            if isinstance(layer, Dense):
                flat, w, shape, open_ = kept
                d = d.reshape(len(d), -1) * open_ if layer.relu else d
                out += [d.sum(axis=0), flat.T @ d]
                d = (d @ w.T).reshape(shape)
            elif isinstance(layer, Dropout):
                d = d if kept is None else d * kept
            elif isinstance(layer, Pool):
                best, (n, h, v, c) = kept
                k = layer.size
                cells = np.zeros((*best.shape, k * k))
                np.put_along_axis(cells, best[..., None], d.reshape(best.shape)[..., None], axis=-1)
                d = np.zeros((n, h, v, c))
                d[:, : h // k * k, : v // k * k] = cells.reshape(n, h // k, v // k, c, k, k).transpose(0, 1, 4, 2, 5, 3).reshape(n, h // k * k, v // k * k, c)
            else:
                seen, w, shape, open_ = kept
                d = d.reshape(open_.shape) * open_
                k, (oh, ow) = layer.size, d.shape[1:3]
                out += [d.sum(axis=(0, 1, 2)), seen.reshape(-1, seen.shape[-1]).T @ d.reshape(-1, d.shape[-1])]
                back = (d @ w.T).reshape(*d.shape[:3], shape[3], k, k)
                d = np.zeros(shape)
                for i in range(k):
                    for j in range(k):
                        d[:, i : i + oh, j : j + ow] += back[..., i, j]
        return np.concatenate([g.ravel() for g in reversed(out)]), loss, right


@dataclass(frozen=True)
class Training:
    """Epochs, steps an epoch (each takes its share of every block), share of rows held out for validation, and Adam's numbers."""

    epochs: int = 15
    steps: int = 4
    validation: float = 0.2
    rate: float = 0.002
    beta1: float = 0.9
    beta2: float = 0.999
    seed: int = 42


def _blocks(rows: DataFrame, id_col: str, label: str, tensor: str, labels: list, validation: float, seed: int) -> tuple[DataFrame, int]:
    """Rows (block, items) of rows sorted by id; and how many blocks there are at most."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    place = F.coalesce(*(F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in enumerate(labels)), F.lit(0))
    held_out = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) < int(validation * (1 << 20))
    item = F.struct(F.col(id_col).alias("id"), place.alias("y"), held_out.alias("v"), F.col(tensor).cast("array<float>").alias("x"))
    dealt = rows.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block"), item.alias("i"))
    return hold(dealt.groupBy("block").agg(F.sort_array(F.collect_list("i")).alias("items"))), n


def _unpacked(column: pa.Array, row: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    items = column[row].values
    x = items.field("x")
    if x.null_count:
        raise ValueError("an image without a tensor")
    return x.flatten().to_numpy().astype(float).reshape(len(items), side, side, 1), items.field("y").to_numpy(zero_copy_only=False), items.field("v").to_numpy(zero_copy_only=False)


_SUMS = "block int, gradient binary, loss double, right long, n long"


def _added(parts: DataFrame, n: int) -> tuple[np.ndarray | None, float, int, int]:
    """The one total of rows of _SUMS, by a tree: BRANCHES blocks of a level, in their order, make one of the next."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        total = None
        for g in group.column("gradient"):
            own = np.frombuffer(g.as_py(), dtype=float)
            total = own.copy() if total is None else total + own
        loss = 0.0
        for x in group.column("loss").to_pylist():
            loss += x
        counts = [sum(group.column(c).to_pylist()) for c in ("right", "n")]
        return pa.Table.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "gradient": [total.tobytes()], "loss": [loss], "right": pa.array(counts[:1], pa.int64()), "n": pa.array(counts[1:], pa.int64())})

    while True:
        n = -(-n // BRANCHES)
        parts = parts.withColumn("block", F.floor(F.col("block") / BRANCHES).cast("int")).groupBy("block").applyInArrow(add, _SUMS) if n > 1 else parts
        if n <= 1:
            break
    rows = parts.collect()  # BRANCHES rows at most, each of the network's size
    rows.sort(key=lambda r: r["block"])
    total, loss = None, 0.0
    for r in rows:
        own = np.frombuffer(r["gradient"], dtype=float)
        total = own.copy() if total is None else total + own
        loss += r["loss"]
    return total, loss, sum(r["right"] for r in rows), sum(r["n"] for r in rows)


def _pass(blocks: DataFrame, n: int, network: Network, weights: np.ndarray, step: int | None, training: Training, epoch: int) -> tuple[np.ndarray | None, float, int, int]:
    """Sums over the training rows of a step, or over the validation rows where step is None."""
    held = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                x, y, held_out = _unpacked(batch.column("items"), row, network.side)
                chosen = np.flatnonzero(held_out) if step is None else np.flatnonzero(~held_out)[step :: training.steps]
                rng = None if step is None else np.random.default_rng([training.seed, epoch, step, block])
                total, loss, right = np.zeros(network.size if step is not None else 0), 0.0, 0
                for at in range(0, len(chosen), PART):
                    part = chosen[at : at + PART]
                    if step is None:
                        log_p, _ = network.forward(held.value, x[part])
                        loss -= float(log_p[np.arange(len(part)), y[part]].sum())
                        right += int((log_p.argmax(axis=1) == y[part]).sum())
                    else:
                        g, more, good = network.gradient(held.value, x[part], y[part], rng)
                        total, loss, right = total + g, loss + more, right + good
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "gradient": [total.tobytes()], "loss": [loss], "right": pa.array([right], pa.int64()), "n": pa.array([len(chosen)], pa.int64())})

    try:
        return _added(blocks.mapInArrow(run, _SUMS), n)
    finally:
        held.unpersist()


@dataclass
class Trained:
    network: Network
    weights: np.ndarray
    labels: list
    history: list[tuple[int, float, float, float, float]]


def train(rows: DataFrame, side: int, training: Training | None = None, layers: tuple[Layer, ...] = DOCUMENT_LAYERS, id_col: str = "img_id", label: str = "label", tensor: str = "tensor") -> Trained:
    """The network trained on rows (id, label, tensor of side x side values), and its history: epoch, accuracy, val_accuracy, loss, val_loss."""
    training = training or Training()
    labels = [r[0] for r in rows.select(label).distinct().orderBy(F.asc_nulls_first(label)).collect()]  # classes are few
    network = Network(side, max(1, len(labels)), layers)
    blocks, n = _blocks(rows, id_col, label, tensor, labels, training.validation, training.seed)
    weights, history, m, v, turn = network.drawn(training.seed), [], np.zeros(network.size), np.zeros(network.size), 0
    for epoch in range(training.epochs):
        sums = np.zeros(3)
        for step in range(training.steps):
            total, loss, right, count = _pass(blocks, n, network, weights, step, training, epoch)
            sums += (loss, right, count)
            if not count:
                continue
            turn, g = turn + 1, total / count
            m, v = training.beta1 * m + (1 - training.beta1) * g, training.beta2 * v + (1 - training.beta2) * g * g
            weights = weights - training.rate * (m / (1 - training.beta1**turn)) / (np.sqrt(v / (1 - training.beta2**turn)) + 1e-7)
        _, val_loss, val_right, val_n = _pass(blocks, n, network, weights, None, training, epoch)
        loss, right, count = sums
        history.append((epoch, *(float(x) for x in (right / max(1, count), val_right / max(1, val_n), loss / max(1, count), val_loss / max(1, val_n)))))
    return Trained(network, weights, labels, history)


def history_rows(trained: Trained, rows: DataFrame) -> DataFrame:
    """epoch, accuracy, val_accuracy, loss, val_loss, rounded to 6 digits: a row an epoch."""
    table = rows.sparkSession.createDataFrame(trained.history, "epoch long, accuracy double, val_accuracy double, loss double, val_loss double")
    return table.select("epoch", *(F.round(c, 6).alias(c) for c in ("accuracy", "val_accuracy", "loss", "val_loss")))


def predict(trained: Trained, rows: DataFrame, id_col: str = "img_id", label: str = "label", tensor: str = "tensor") -> DataFrame:
    """id, label and the likeliest label as predicted; ties to the label that sorts first."""
    held = rows.sparkSession.sparkContext.broadcast(trained.weights)
    network = trained.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(float).reshape(batch.num_rows, network.side, network.side, 1)
            found = [network.forward(held.value, x[at : at + PART])[0].argmax(axis=1) for at in range(0, len(x), PART)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(np.concatenate(found) if found else [], pa.int32())], ["id", "label", "place"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, label)]
    chosen = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(tensor).cast("array<float>").alias("x"))
    placed = chosen.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, place int")
    name = F.element_at(F.array(*(F.lit(v).cast(kinds[1]) for v in trained.labels or [None])), F.col("place") + 1)
    return placed.select(F.col("id").alias(id_col), F.col("label").alias(label), name.alias("predicted"))
