"""Support vector machines as the published models use them (M5, M7, M11): an RBF kernel one-vs-one, and a squared hinge one-vs-rest.

Kernel machine. Every pair of classes has a dual problem over its rows. Where all pairs fit (PAIR_ROWS, PAIR_BYTES) a task
solves a whole one by active sets, on kernel values of which HELD_BYTES are held. Else rows are dealt to blocks of a bounded size by a hash
of their id and a cascade keeps what matters: every block of a pair is solved by itself, the support vectors of two blocks
make one block of the next level, and the last block's solution is the pair's machine. Then all rows of the pair are held
against it where they lie; those that violate the optimality conditions go to the last block, which is solved again, until
none is left: the solution is then that of the whole dual problem. Pairs, blocks and the check of all rows are Spark tasks;
the driver sees counts and one bias a pair. A last block holds support vectors and violators alone; one of more than
WHOLE_ROWS rows is solved by working sets, and of its kernel matrix only PART_BYTES are held at once. Values of all pairs'
machines are sums over groups of rows and groups of support vectors (GROUP_BYTES of vectors each), so a vector that
supports several machines meets a row once, and neither the rows nor the model come to one place.

Linear machine. Coefficients minimise |w|^2 / 2 + C sum max(0, 1 - y (w.x + b))^2 for each class against the rest, with
the bias regularised like a coefficient. A Newton iteration's gradient and its products with the Hessian are sums over the
rows, all classes at once, added up per task and then by a tree; the driver holds one matrix of classes x terms.

Defined cases. A null class is a class. A single class is predicted for every row. Repeated rows count as often as they are
there. Ties in votes go to the class that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.session import cut, give_back, hold

# ---- the kernel machine -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kernel:
    """Cost of a violation, width of the kernel exp(-gamma |x - y|^2), tolerance of the optimality conditions, rows a block."""

    cost: float = 10.0
    gamma: float = 1.0
    tolerance: float = 1e-3
    block_rows: int = 1000
    most_rounds: int = 50


def scale_gamma(rows: DataFrame, vector: str = "vector") -> float:
    """1 / (components x population variance of all values): the gamma that libraries call scale. 1 where all values are equal."""
    found = rows.select(F.explode(F.col(vector).cast("array<double>")).alias("x")).agg(F.var_pop("x").alias("v")).first()["v"]
    width = rows.select(F.size(vector)).first()
    return 1.0 / (width[0] * found) if width and found else 1.0


#: Rows whose kernel matrix is held whole; bytes of it that are held else; bytes of vectors, and rows, of a group at most.
WHOLE_ROWS, PART_BYTES, GROUP_BYTES, GROUP_ROWS = 2048, 64 << 20, 32 << 20, 8192


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    out = 2 * a @ b.T
    out -= (a * a).sum(axis=1)[:, None]
    out -= (b * b).sum(axis=1)[None, :]
    np.minimum(out, 0, out=out)
    out *= gamma
    return np.exp(out, out=out)


def solve_dual(x: np.ndarray, y: np.ndarray, kernel: Kernel, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """alpha and bias of the machine on rows x with y of -1 or 1: the most violating pair, second-order choice, until within tolerance."""
    n, c = len(y), kernel.cost
    alpha = np.zeros(n) if start is None else start.copy()
    if len(set(y.tolist())) < 2:
        return np.zeros(n), float(y[0]) if n else 0.0
    if n > WHOLE_ROWS:
        gradient = _solved_by_parts(x, y, kernel, alpha)
    else:
        q = rbf(x, x, kernel.gamma)
        gradient = y * (q @ (alpha * y)) - 1.0
        _steps(q, y, alpha, gradient, c, kernel.tolerance)
    return alpha, _bias(y, alpha, gradient, c)


def _bias(y: np.ndarray, alpha: np.ndarray, gradient: np.ndarray, c: float) -> float:
    score = -y * gradient
    free = (alpha > 0) & (alpha < c)
    if free.any():
        return float(score[free].mean())
    up, low = _movable(y, alpha, c)
    return float((score[up].max() + score[low].min()) / 2)


def _movable(y: np.ndarray, alpha: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    return ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0)), ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))


def _steps(q: np.ndarray, y: np.ndarray, alpha: np.ndarray, gradient: np.ndarray, c: float, tolerance: float) -> None:
    """Moves alpha and gradient, which are changed, pair by pair until no pair violates by the tolerance."""
    for _ in range(1000 * len(y) + 1000):
        score = -y * gradient
        up, low = _movable(y, alpha, c)
        i = int(np.where(up, score, -np.inf).argmax())
        gap = score[i] - score
        if np.where(low, gap, -np.inf).max() < tolerance:
            break
        curve = np.maximum(2 - 2 * q[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(gap[j] / curve[j], room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        for k, room in ((i, room_i), (j, room_j)):
            if step == room:  # exactly on a bound, whatever the rounding
                alpha[k] = 0.0 if alpha[k] < c / 2 else c
        gradient += step * y * (q[i] - q[j])


def _solved_by_parts(x: np.ndarray, y: np.ndarray, kernel: Kernel, alpha: np.ndarray) -> np.ndarray:
    """Solves for alpha, which is changed, by working sets of the worst violators of either side and of rows of the set before; the gradient."""
    n, c = len(y), kernel.cost
    size = max(16, min(1024, PART_BYTES // (8 * n)))
    gradient, set_ = np.full(n, -1.0), np.zeros(0, dtype=np.int64)
    begun = np.flatnonzero(alpha)
    for at in range(0, len(begun), size):
        part = begun[at : at + size]
        gradient += y * ((alpha * y)[part] @ rbf(x[part], x, kernel.gamma))
    for _ in range(1000 * (n // size + 1) + 1000):
        score = -y * gradient
        up, low = _movable(y, alpha, c)
        above, below = np.where(up, score, -np.inf), np.where(low, score, np.inf)
        gap = above.max() - below.min()
        if gap < kernel.tolerance:
            break
        fresh = np.concatenate([np.argpartition(-above, size // 4)[: size // 4], np.argpartition(below, size // 4)[: size // 4], [above.argmax(), below.argmin()]])
        kept = set_[(alpha[set_] > 0) & (alpha[set_] < c)]
        set_ = np.unique(np.concatenate([fresh, kept[: size - len(fresh)]]))
        q = rbf(x[set_], x, kernel.gamma)
        before, own = alpha[set_].copy(), gradient[set_].copy()
        after = before.copy()
        _steps(q[:, set_], y[set_], after, own, c, max(kernel.tolerance / 2, gap / 10))
        alpha[set_] = after
        gradient += y * (((after - before) * y[set_]) @ q)
    return gradient


def _floats(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 0))


def _solved(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """rows (pair, block, id, y, x, alpha): every block solved from where its alphas are; only support vectors stay."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x, y = _floats(group.column("x"), group.num_rows), group.column("y").to_numpy()
        start = group.column("alpha").to_numpy()
        if abs((start * y).sum()) > 1e-9:
            start = None  # two blocks' alphas balance each by itself, so their union does; a violator's is 0
        alpha, bias = solve_dual(x, y, kernel, start)
        out = group.drop_columns(["alpha"]).append_column("alpha", pa.array(alpha)).append_column("bias", pa.array(np.full(len(y), bias)))
        keep = alpha > 0 if (alpha > 0).any() else np.arange(len(y)) == 0  # one class alone: a row that carries the bias
        return out.filter(pa.array(keep)).select(["pair", "block", "id", "y", "x", "alpha", "bias"])

    return rows.groupBy("pair", "block").applyInArrow(run, "pair int, block int, id string, y double, x array<double>, alpha double, bias double")


# ---- a pair's whole dual, by active sets ---------------------------------------------------------------------------

#: Rows of a pair that are solved at once, and bytes of their vectors, at most: beyond, blocks go through the cascade.
PAIR_ROWS, PAIR_BYTES = 32768, 128 << 20
#: Bytes of kernel values of free rows that a task holds at most; others are computed when they are needed.
HELD_BYTES = 256 << 20
#: Rows of a tile of the kernel matrix; rows to which all are compared for the preconditioner; rows that are solved pair by pair.
TILE, LANDMARKS, FEW_ROWS = 512, 512, 256


def _kernel32(a: np.ndarray, b: np.ndarray, gamma: float, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= np.float32(2 * gamma)
    out -= (np.float32(gamma) * aa)[:, None]
    out -= (np.float32(gamma) * bb)[None, :]
    np.minimum(out, 0, out=out)
    return np.exp(out, out=out)


class _Gram:
    """Products of the kernel matrix of rows with vectors: values in single precision, as libraries hold them, sums in double. Tiles are computed and let go."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma, self.n = np.ascontiguousarray(x, dtype=np.float32), gamma, len(x)
        self.squares = (self.x * self.x).sum(axis=1)

    def _tile(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return _kernel32(self.x[a], self.x[b], self.gamma, self.squares[a], self.squares[b])

    def dot(self, v: np.ndarray) -> np.ndarray:
        """The matrix times v. Of rows where v is not 0, a tile serves both of its sides."""
        out, v = np.zeros(self.n), v.astype(np.float32)
        some, none = np.flatnonzero(v), np.flatnonzero(v == 0)
        parts = [some[at : at + TILE] for at in range(0, len(some), TILE)]
        for i, a in enumerate(parts):
            for b in parts[: i + 1]:
                own = self._tile(a, b)
                out[a] += own @ v[b]
                if a is not b:
                    out[b] += v[a] @ own
            for at in range(0, len(none), TILE):
                out[none[at : at + TILE]] += v[a] @ self._tile(a, none[at : at + TILE])
        return out

    def among(self, free: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """v -> about the product of the matrix of the free rows alone with v: single precision where HELD_BYTES hold it, else 16 bits of it, else what they do not hold anew."""
        rows = np.flatnonzero(free)
        parts = [slice(at, min(len(rows), at + TILE)) for at in range(0, len(rows), TILE)]
        short = 2 * len(rows) * (len(rows) + TILE) > HELD_BYTES
        held, room = {}, HELD_BYTES
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                room -= (2 if short else 4) * (a.stop - a.start) * (b.stop - b.start)
                if room < 0:
                    break
                own = self._tile(rows[a], rows[b])
                held[i, j] = np.rint(own * np.float32(65535)).astype(np.uint16) if short else own

        def times(v: np.ndarray) -> np.ndarray:
            out, v = np.zeros(len(v)), v.astype(np.float32)
            for i, a in enumerate(parts):
                for j, b in enumerate(parts[: i + 1]):
                    own = held.get((i, j))
                    if own is None:
                        own = self._tile(rows[a], rows[b])
                    elif short:
                        own = own * np.float32(1 / 65535)
                    out[a] += own @ v[b]
                    if i != j:
                        out[b] += v[a] @ own
            return out

        return times


def _gap(y: np.ndarray, alpha: np.ndarray, gradient: np.ndarray, c: float) -> float:
    """By how much the most violating pair violates the conditions of optimality."""
    score = -y * gradient
    up, low = _movable(y, alpha, c)
    return float(score[up].max() - score[low].min()) if up.any() and low.any() else 0.0


def _balanced(y: np.ndarray, alpha: np.ndarray, c: float) -> np.ndarray:
    """alpha within its bounds and with the labels' sums equal: what is missing is dealt to the rows that have room."""
    alpha = np.clip(alpha, 0, c)
    for _ in range(50):
        over = float((alpha * y).sum())
        if abs(over) < 1e-10:
            return alpha
        free = (alpha > 0) & (alpha < c)
        if not free.any():
            up, low = _movable(y, alpha, c)
            free = low if over > 0 else up
        alpha[free] = np.clip(alpha[free] - y[free] * over / free.sum(), 0, c)
    return alpha if abs((alpha * y).sum()) < 1e-9 else np.zeros(len(y))


def _preconditioner(low_rank: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The inverse of low_rank.T low_rank + diag(rest)."""
    scale = 1 / np.sqrt(rest)
    g = low_rank * scale  # in double precision: what the inverse leaves of a row is a small difference
    inner = g @ g.T
    inner[np.diag_indices(len(inner))] += 1
    half = np.linalg.inv(np.linalg.cholesky(inner))

    def apply(v: np.ndarray) -> np.ndarray:
        v = v * scale
        return (v - (half.T @ (half @ (g @ v))) @ g) * scale

    return apply


def active_sets(gram: _Gram, y: np.ndarray, kernel: Kernel, most_rounds: int = 60) -> np.ndarray:
    """alpha of the whole dual: rows are taken to be at a bound or free, the free ones' equations and the balance are solved by
    conjugate gradients, and values and gradients say which rows change sides, until none violates. The best found if they do not settle."""
    n, c, tolerance = len(y), kernel.cost, kernel.tolerance
    marks = np.unique(np.linspace(0, n - 1, min(n, LANDMARKS)).astype(np.int64))
    near = gram._tile(marks, slice(None)).astype(float)
    corner = near[:, marks] + 1e-4 * np.eye(len(marks))
    low_rank = np.linalg.solve(np.linalg.cholesky(corner), near).astype(np.float32)
    del near
    rest = np.maximum(1 - (low_rank * low_rank).sum(axis=0, dtype=float), 0.02)
    beta, low, up, product = np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n)
    best, least = np.zeros(n), np.inf
    for turn in range(most_rounds):
        free = ~(low | up)
        before = beta
        beta = np.where(free, beta, np.where(up, c * y, 0.0))
        product = product + gram.dot(beta - before)  # the rows that went to a bound, of which there are ever fewer
        if free.any():
            times, apply = gram.among(free), _preconditioner(low_rank[:, free], rest[free])
            ones = apply(np.ones(int(free.sum())))
            whole = ones.sum()
            moved = ones * (-beta.sum() / whole)
            left = (y - product)[free] - times(moved)
            ahead = apply(left)
            ahead -= ones * (ahead.sum() / whole)
            step, size, first = ahead, left @ ahead, None
            for _ in range(12 if turn == 0 else 60):
                off = np.abs(left - (ones @ left) / whole).max()
                first = off if first is None else first
                if off < max(tolerance / 4, (0.02 if turn < 3 else 0.003) * first):
                    break
                turned = times(step)
                curve = step @ turned
                if not curve > 0 or not size > 0:
                    break
                moved += step * (size / curve)
                last, left = left, left - turned * (size / curve)
                ahead = apply(left)
                ahead -= ones * (ahead.sum() / whole)
                now = left @ ahead
                step, size = ahead + step * max(0.0, (now - last @ ahead) / size), now
            beta[free] += moved
            after = np.zeros(n)
            after[free] = moved
            product = product + gram.dot(after)
        bias = float(np.median((y - product)[free if free.any() else slice(None)]))
        gradient, alpha = y * (product + bias) - 1, y * beta
        now_low, now_up = alpha - gradient <= 0, alpha - gradient >= c
        worst = max(np.where(free, np.maximum(np.maximum(-alpha, alpha - c), np.abs(gradient)), np.where(low, -gradient, gradient)).max(), 0.0)
        if worst < least:
            best, least = alpha, worst
        if worst < 4 * tolerance:
            found = _balanced(y, alpha, c)
            if _gap(y, found, y * gram.dot(found * y) - 1, c) < tolerance:
                return found
        if (now_low == low).all() and (now_up == up).all() and worst < tolerance / 4:
            break
        low, up = now_low, now_up
    return _balanced(y, best, c)


def solve_pair(x: np.ndarray, y: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, float]:
    """alpha and bias of the machine on all rows of a pair, within the tolerance: by active sets, and pair by pair from there where those do not settle."""
    if len(y) <= FEW_ROWS or len(set(y.tolist())) < 2:
        return solve_dual(x.astype(float), y, kernel)
    gram = _Gram(x, kernel.gamma)
    alpha = active_sets(gram, y, kernel)
    gradient = y * gram.dot(alpha * y) - 1
    if _gap(y, alpha, gradient, kernel.cost) < kernel.tolerance:
        return alpha, _bias(y, alpha, gradient, kernel.cost)
    del gram
    return solve_dual(x.astype(float), y, kernel, alpha)


def solved_pairs(rows: DataFrame, pairs: list[tuple[int, int]], kernel: Kernel) -> DataFrame:
    """The support vectors (pair, id, y, alpha, bias) of rows (id, place, x): a task solves a pair's whole dual, so no row is left to check."""
    spark, n = rows.sparkSession, len(pairs)
    # A pair takes long, whatever its bytes, so each gets a task of its own: numbers that the hash deals to as many partitions.
    dealt_to = spark.range(64 * n).select(F.col("id").cast("int").alias("slot"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("slot").alias("slot"))
    slots = {r["p"]: r["slot"] for r in dealt_to.collect()}  # a row a pair
    slot = [slots.get(k, -1 - k) for k in range(n)]
    told = spark.createDataFrame([(k, slot[k], c, 1.0 if c == a else -1.0) for k, (a, b) in enumerate(pairs) for c in (a, b)], "pair int, slot int, place int, y double")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x, y = _floats(group.column("x"), group.num_rows), group.column("y").to_numpy()
        group = group.select(["pair", "id", "y"])
        alpha, bias = solve_pair(x, y, kernel)
        out = group.append_column("alpha", pa.array(alpha)).append_column("bias", pa.array(np.full(len(y), bias)))
        del x
        give_back()
        return out.filter(pa.array(alpha > 0 if (alpha > 0).any() else np.arange(len(y)) == 0))

    dealt = rows.join(F.broadcast(told), "place").select("slot", "pair", "id", "y", F.col("x").cast("array<float>").alias("x"))
    return dealt.repartition(n, "slot").groupBy("slot").applyInArrow(run, "pair int, id string, y double, alpha double, bias double")


def machines_of(rows: DataFrame, pairs: list[tuple[int, int]], kernel: Kernel) -> DataFrame:
    """The support vectors (pair, id, y, alpha, bias, perhaps x) of rows, by pairs at once or, where one is too large for a task, by the cascade."""
    sizes = dict(rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())
    width = rows.select(F.size("x")).first()
    most = max(sizes[a] + sizes[b] for a, b in pairs)
    if most <= PAIR_ROWS and 4 * most * max(1, width[0] if width else 1) <= PAIR_BYTES:
        return cut(solved_pairs(rows, pairs, kernel), "machines")
    return cascaded(rows, pairs, kernel)


def _decide(x: np.ndarray, machine: tuple, gamma: float) -> np.ndarray:
    vectors, weights, bias = machine
    out = np.empty(len(x))
    for at in range(0, len(x), 1024):
        out[at : at + 1024] = rbf(x[at : at + 1024], vectors, gamma) @ weights + bias
    return out


def cascade(rows: DataFrame, pairs: list[tuple[int, int]], kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Support vectors, alpha * y and bias by pair, brought to the driver: for models that fit there."""
    machines: dict[int, tuple] = {}
    held: dict[int, list] = {}
    for r in cascaded(rows, pairs, kernel).orderBy("pair", "id").toLocalIterator():
        held.setdefault(r["pair"], []).append(r)
    for pair, found in held.items():
        machines[pair] = (np.array([r["x"] for r in found]), np.array([r["alpha"] * r["y"] for r in found]), found[0]["bias"])
    return machines


def cascaded(rows: DataFrame, pairs: list[tuple[int, int]], kernel: Kernel) -> DataFrame:
    """The support vectors (pair, id, y, x, alpha, bias) of rows (id: a string of each row's own, place: number of the class, x)."""
    spark = rows.sparkSession
    rows = cut(rows.select("id", "place", "x"), "rows")
    sizes = dict(rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())
    blocks = [max(1, -(-(sizes[a] + sizes[b]) // kernel.block_rows)) for a, b in pairs]
    numbers = spark.createDataFrame([(k, c, 1.0 if c == a else -1.0, blocks[k]) for k, (a, b) in enumerate(pairs) for c in (a, b)], "pair int, place int, y double, blocks int")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    level = cut(_solved(rows.join(F.broadcast(numbers), "place").select("pair", block, "id", "y", "x", F.lit(0.0).alias("alpha")), kernel), "cascade")
    most = max(blocks, default=1)
    while most > 1:
        most = -(-most // 2)
        level = cut(_solved(level.withColumn("block", F.floor(F.col("block") / 2).cast("int")).drop("bias"), kernel), "cascade")
    for _ in range(kernel.most_rounds):
        # Support vectors were solved within the tolerance, so what violates joins them, with an alpha of 0.
        fresh = cut(_violators(rows, numbers, level, kernel, len(pairs), block), "violators")
        if fresh.isEmpty():
            return level
        level = cut(_solved(level.drop("bias").withColumn("block", F.lit(0)).unionByName(fresh), kernel), "cascade")
    raise RuntimeError(f"rows still violate the conditions after {kernel.most_rounds} rounds")


def _violators(rows: DataFrame, numbers: DataFrame, level: DataFrame, kernel: Kernel, n_pairs: int, block: F.Column) -> DataFrame:
    """Rows outside the pairs' machines that are on the wrong side of their margin by more than the tolerance: the worst of each block."""
    sums = _sums(rows.select(F.col("id").alias("key"), "x"), level, rows, n_pairs, kernel.gamma)
    told = F.broadcast(numbers.join(_biases(level), "pair"))
    margin = F.col("y") * (F.element_at("sums", F.col("pair") + 1) + F.col("bias"))
    found = rows.select("id", "place").join(sums.withColumnRenamed("key", "id"), "id").join(told, "place").select("pair", "id", "y", block, margin.alias("margin"))
    bad = found.filter(F.col("margin") < 1 - 2 * kernel.tolerance).join(level.select("pair", "id"), ["pair", "id"], "left_anti")
    worst = F.row_number().over(Window.partitionBy("pair", "block").orderBy("margin", "id"))
    taken = bad.withColumn("r", worst).filter(F.col("r") <= max(8, kernel.block_rows // 4))
    return taken.join(rows.select("id", "x"), "id").select("pair", F.lit(0).alias("block"), "id", "y", "x", F.lit(0.0).alias("alpha"))


def _biases(level: DataFrame) -> DataFrame:
    return level.groupBy("pair").agg(F.first("bias").alias("bias"))


def _sums(rows: DataFrame, level: DataFrame, vectors: DataFrame, n_pairs: int, gamma: float) -> DataFrame:
    """key and `sums`, the value of each pair's machine without its bias, of rows (key, x). vectors (id, x) has the support vectors' components.

    Groups of rows meet groups of support vectors; the parts of a row's sums are added up in the order of the groups.
    """
    by_pair = level.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pair", F.col("alpha") * F.col("y")))).alias("m"))
    weights = by_pair.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_pairs - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("w"))
    width = rows.select(F.size("x")).first()
    per = max(1, min(GROUP_ROWS, GROUP_BYTES // (4 * max(1, width[0] if width else 1))))
    n_rows, n_vectors = max(1, -(-rows.count() // per)), max(1, -(-weights.count() // per))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(place("key", n_rows).alias("of"), every(n_vectors).alias("by"), F.col("key").alias("own"), F.col("x").cast("array<float>").alias("row"))
    right = vectors.select("id", "x").join(weights, "id").select(every(n_rows).alias("of"), place("id", n_vectors).alias("by"), F.col("id").alias("other"), F.col("x").cast("array<float>").alias("vector"), "w")

    def meet(key: tuple, rows: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("other")
        x, v, w = _floats(rows.column("row"), rows.num_rows), _floats(vectors.column("vector"), vectors.num_rows), _floats(vectors.column("w"), vectors.num_rows)
        out, xx, vv = np.zeros((len(x), n_pairs)), (x * x).sum(axis=1), (v * v).sum(axis=1)
        for at in range(0, len(x) if len(v) else 0, 512):
            out[at : at + 512] = _kernel32(x[at : at + 512], v, gamma, xx[at : at + 512], vv).astype(float) @ w
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_pairs, pa.int32()), pa.array(out.ravel()))
        return pa.table({"of": pa.array([key[0].as_py()] * len(x), pa.int32()), "by": pa.array([key[1].as_py()] * len(x), pa.int32()), "key": rows.column("own").cast(pa.string()), "sums": lists})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("by", "ascending")])
        out = _floats(group.column("sums"), group.num_rows).reshape(-1, n_vectors, n_pairs).sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n_pairs, pa.int32()), pa.array(out.ravel()))
        return pa.table({"key": group.column("key").take(pa.array(np.arange(len(out)) * n_vectors)), "sums": lists})

    parts = left.groupBy("of", "by").cogroup(right.groupBy("of", "by")).applyInArrow(meet, "of int, by int, key string, sums array<double>")
    return parts.groupBy("of").applyInArrow(add, "key string, sums array<double>")


def kernel_predictions(train: DataFrame, test: DataFrame, kernel: Kernel, vector: str = "vector", label: str = "label", id_col: str = "vec_id") -> DataFrame:
    """id, label, predicted: one vote a pair of classes; ties to the class that sorts first."""
    labels = [r[0] for r in train.select(label).distinct().orderBy(F.asc_nulls_first(label)).collect()]  # classes are few
    pairs = [(a, b) for a in range(len(labels)) for b in range(a + 1, len(labels))]
    kind = test.schema[label].dataType.simpleString()
    name = F.element_at(F.array(*(F.lit(v).cast(kind) for v in labels or [None])), F.col("place") + 1)
    if not pairs:
        return test.withColumn("place", F.lit(0)).select(id_col, label, name.alias("predicted"))
    number = F.coalesce(*(F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in enumerate(labels)), F.lit(0))
    copy = F.row_number().over(Window.partitionBy(id_col).orderBy(label, vector))  # rows of one id stay apart
    rows = cut(train.select(F.concat_ws("#", F.col(id_col).cast("string"), copy).alias("id"), number.alias("place"), F.col(vector).cast("array<double>").alias("x")), "rows")
    level = machines_of(rows, pairs, kernel)
    biases = dict(_biases(level).collect())  # one a pair of classes
    asked = cut(test.select(F.monotonically_increasing_id().cast("string").alias("key"), F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _floats(batch.column("sums"), batch.num_rows)
            votes = np.zeros((batch.num_rows, len(labels)), dtype=np.int32)
            for k, (a, b) in enumerate(pairs):
                first = sums[:, k] + biases[k] > 0 if batch.num_rows else np.zeros(0, dtype=bool)
                votes[:, a] += first
                votes[:, b] += ~first
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(votes.argmax(axis=1).astype(np.int32))], ["key", "place"])

    found = _sums(asked.select("key", "x"), level, rows, len(pairs), kernel.gamma).mapInArrow(run, "key string, place int")
    return asked.select("key", "id", "label").join(found, "key").select(F.col("id").alias(id_col), F.col("label").alias(label), name.alias("predicted"))


# ---- the linear machine -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    cost: float = 1.0
    tolerance: float = 1e-4
    most_rounds: int = 60
    most_products: int = 40


_SUM = "part int, total binary"
BRANCHES = 32


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of the arrays of rows of _SUM, BRANCHES at a time in their order."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        total = sum((np.frombuffer(t.as_py(), dtype=float) for t in group.column("total")), np.zeros(1))
        return pa.Table.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "total": [total.tobytes()]})

    while n > BRANCHES:
        n = -(-n // BRANCHES)
        parts = parts.withColumn("part", F.floor(F.col("part") / BRANCHES).cast("int")).groupBy("part").applyInArrow(add, _SUM)
    rows = sorted(parts.collect(), key=lambda r: r["part"])  # BRANCHES at most
    return sum((np.frombuffer(r["total"], dtype=float) for r in rows), np.zeros(1)) if rows else None


class _Rows:
    """Sparse rows with their class, packed into blocks, over which sums are taken."""

    def __init__(self, rows: DataFrame, terms: int, classes: int, block_rows: int = 2000):
        self.shape = (classes, terms + 1)
        self.n = max(1, -(-rows.count() // block_rows))
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(self.n)).cast("int").alias("part"), F.struct("id", "place", "at", "x").alias("i"))
        self.blocks = hold(dealt.groupBy("part").agg(F.sort_array(F.collect_list("i")).alias("items")))

    def total(self, f: Callable, *given: np.ndarray) -> np.ndarray:
        """Sum over blocks of f(times, back, place, *given): times multiplies the block's rows (with a 1 for the bias) by a matrix of classes x terms, back its transpose."""
        held, width = self.blocks.sparkSession.sparkContext.broadcast(given), self.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    items = batch.column("items")[row].values
                    n, at, x = len(items), items.field("at"), items.field("x")
                    of = np.repeat(np.arange(n), np.diff(at.offsets.to_numpy()))
                    at, x = at.flatten().to_numpy(), x.flatten().to_numpy()

                    def times(w: np.ndarray, n: int = n, of: np.ndarray = of, at: np.ndarray = at, x: np.ndarray = x) -> np.ndarray:
                        return np.stack([np.bincount(of, weights=x * v[at], minlength=n) + v[-1] for v in w])

                    def back(r: np.ndarray, of: np.ndarray = of, at: np.ndarray = at, x: np.ndarray = x) -> np.ndarray:
                        return np.stack([np.append(np.bincount(at, weights=x * v[of], minlength=width - 1), v.sum()) for v in r])

                    total = f(times, back, items.field("place").to_numpy(), *held.value)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([batch.column("part")[row].as_py()], pa.int32()), "total": [np.asarray(total, dtype=float).tobytes()]})

        try:
            return _tree_sum(self.blocks.mapInArrow(run, _SUM), self.n)
        finally:
            held.unpersist()


def _signs(place: np.ndarray, classes: int) -> np.ndarray:
    return np.where(place[None, :] == np.arange(classes)[:, None], 1.0, -1.0)


def squared_hinge(rows: DataFrame, terms: int, classes: int, how: Linear | None = None) -> np.ndarray:
    """Coefficients, a row a class with the bias last, of rows (id, place, at: term numbers, x: their values).

    Newton's method with conjugate gradients: a round costs one pass for loss and gradient, one a Hessian product, and one for
    the loss along the step at several lengths.
    """
    how = how or Linear()
    w = np.zeros((classes, terms + 1))
    if not classes:
        return w
    data, size = _Rows(rows, terms, classes), classes * (terms + 1)

    def first(times, back, place, w):
        short = np.maximum(0, 1 - _signs(place, classes) * times(w))
        return np.concatenate([(short * short).sum(axis=1), back(-2 * short * _signs(place, classes)).ravel()])

    def curved(times, back, place, w, p):
        active = _signs(place, classes) * times(w) < 1
        return back(2 * active * times(p)).ravel()

    lengths = 0.5 ** np.arange(12)

    def along(times, back, place, w, p):
        y = _signs(place, classes)
        here, step = y * times(w), y * times(p)
        return np.stack([(np.maximum(0, 1 - here - t * step) ** 2).sum(axis=1) for t in lengths], axis=1).ravel()

    goal = None
    for _ in range(how.most_rounds):
        found = data.total(first, w)
        if found is None or len(found) < classes + size:
            return w
        loss = how.cost * found[:classes] + (w * w).sum(axis=1) / 2
        g = w + how.cost * found[classes:].reshape(w.shape)
        norm = np.sqrt((g * g).sum(axis=1))
        goal = norm * how.tolerance if goal is None else goal
        open_ = norm > goal
        if not open_.any():
            break
        # All classes' directions at once; a class that is done has none.
        p, r = np.zeros_like(w), np.where(open_[:, None], -g, 0)
        d, rr = r.copy(), (r * r).sum(axis=1)
        for _ in range(how.most_products):
            going = np.sqrt(rr) > 0.05 * norm
            if not (going & open_).any():
                break
            h = d + how.cost * data.total(curved, w, d).reshape(w.shape)
            curve = (d * h).sum(axis=1)
            a = np.where(going & (curve > 0), rr / np.where(curve > 0, curve, 1), 0)
            p, r = p + a[:, None] * d, r - a[:, None] * h
            after = (r * r).sum(axis=1)
            d = np.where(going[:, None], r + (after / np.where(rr > 0, rr, 1))[:, None] * d, d)
            rr = after
        losses = how.cost * data.total(along, w, p).reshape(classes, -1)
        losses += ((w[:, None, :] + lengths[None, :, None] * p[:, None, :]) ** 2).sum(axis=2) / 2
        enough = losses <= loss[:, None] + 0.01 * lengths * (g * p).sum(axis=1)[:, None]
        step = np.where(enough.any(axis=1), lengths[enough.argmax(axis=1)], 0.0)
        if not step.any():
            break
        w = w + step[:, None] * p
    return w


def linear_predictions(rows: DataFrame, w: np.ndarray, labels: list) -> DataFrame:
    """id, label, predicted of rows (id, label, at, x): the class of the largest value, ties to the one that sorts first."""
    held = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, n = batch.column("at"), batch.column("x"), batch.num_rows
            of = np.repeat(np.arange(n), np.diff(at.offsets.to_numpy()))
            at, x = at.flatten().to_numpy(), x.flatten().to_numpy()
            values = np.stack([np.bincount(of, weights=x * v[at], minlength=n) + v[-1] for v in held.value])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(values.argmax(axis=0).astype(np.int32))], ["id", "label", "place"])

    kind = rows.schema["label"].dataType.simpleString()
    found = rows.select("id", "label", "at", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label {kind}, place int")
    return found.select("id", "label", F.element_at(F.array(*(F.lit(v).cast(kind) for v in labels or [None])), F.col("place") + 1).alias("predicted"))
