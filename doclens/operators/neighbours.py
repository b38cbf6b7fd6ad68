"""Exact nearest neighbours by a pivot-partitioned join.

Training rows go to the cell of their nearest pivot, and within it to rings of equal size by their distance from it; a ring
of more than a block's rows is dealt to blocks by a hash. A query first looks at the nearest ring or two, which bounds the
distance of its k-th neighbour, and then at every ring that the bound does not exclude: a ring between the radii lo and hi
cannot hold a row nearer than max(d - hi, lo - d), d being the query's distance from the pivot, nor than the distance from
the plane between that pivot and the query's own. What is excluded cannot hold a neighbour, so the result is exact.

First visitors of a block come in groups of a bounded size, each joined with a copy of the block on (block, slot), so neither
a block that all queries visit first nor a cell that holds most rows is one task; a block has as many slots as its visitors
fill. For the second look queries lie in groups by their own cell. Groups and blocks meet as a product of bounded partitions
that are shuffled once each: where nothing can be excluded, the pairs are all looked at, but no copy of a group or of a block
is written for them. A group brings the blocks that its bounds leave, and a task keeps the k best of each of its queries, so
what comes out is k rows a query and partition of blocks. A pair has some MB, so batches are bounded by bytes, and Python workers
give back what a stage leaves in them. Pivots and rings' radii are bounded in number (MOST_PIVOTS, RINGS
each) and broadcast. Vectors travel as packed bytes, of 4 where that is exact. Of equal vectors in a block the k with the
smallest ids stay, as no other can be among the k nearest.

Defined cases. Rows whose vector or id is null, on either side, are left out. Ties in distance (to 9 digits of its square)
go by training id, a number; ties in votes to the smallest label. Test rows that share id and label are one. Without
training rows nothing is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.session import bound_batches, cut, give_back

MOST_PIVOTS, RINGS = 1024, 16
#: Queries that visit a block together, and rows of a block, at least; times by which both grow, and groups or blocks from which they do.
VISITORS, BLOCK_ROWS = 1024, 512
LARGEST, ENOUGH = 8, 64
#: Entries of a table of queries x rings, and visits, that a task holds at once.
AT_ONCE = 1 << 14
#: Queries and rows of a partition of the product, about; queries whose best rows a task holds before it writes them.
SIDE_QUERIES, SIDE_ROWS, HELD = 1 << 13, 1 << 15, 1 << 13
#: Numbers of candidates' vectors that are compared at once.
COMPARED_AT_ONCE = 1 << 18


def _grown(least: int, rows: int, enough: int) -> int:
    return least * min(LARGEST, max(1, rows // (least * enough)))


@dataclass
class Best:
    """The k nearest rows so far of each of a group's queries (squared distance, id, label; an infinite distance where there are fewer), and the squared distance that bounds them."""

    ids: np.ndarray
    labels: pa.Array
    x: np.ndarray
    k: int
    far: np.ndarray

    def __post_init__(self) -> None:
        shape = (len(self.ids), self.k)
        self.d, self.near = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max)
        self.label, self.known = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
        self.compared = 0

    def look(self, ids: np.ndarray, labels: pa.Array, rows: np.ndarray, chosen: np.ndarray) -> None:
        """A matrix product finds the candidates among rows, with a margin for its rounding; their distances are then computed directly."""
        self.compared += len(chosen) * len(ids)
        norms = (rows * rows).sum(axis=1)
        most = max((n.max() for n in (norms[np.isfinite(norms)],) if len(n)), default=0.0)
        label, known = pc.fill_null(labels, 0).to_numpy(zero_copy_only=False), labels.is_valid().to_numpy(zero_copy_only=False)
        few = max(1, (1 << 20) // max(1, len(ids)))
        small = rows.astype(np.float32) if most < 1e30 else None
        for at in range(0, len(chosen), few):
            of = chosen[at : at + few]
            x, far = self.x[of], self.far[of]
            own = (x * x).sum(axis=1)
            # Single precision finds candidates as well, where its rounding is far below the distances that bound them.
            margin = (1e-6 + 2.5e-7 * rows.shape[1]) * (1 + most + own)
            single = small is not None and own.max(initial=0.0) < 1e30 and bool((margin <= 0.01 * far).all())
            margin = margin if single else 1e-7 * (1 + most + own)
            if single:
                rough = x.astype(np.float32) @ small.T
                rough *= -2
                rough += norms.astype(np.float32)
            else:
                rough = norms - 2 * x @ rows.T
            rough_far = far + margin - own
            hit = rough <= rough_far[:, None].astype(rough.dtype)
            if np.count_nonzero(hit) > 4 * self.k * len(of) and len(ids) > self.k:
                last = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
                hit = rough <= np.minimum(rough_far, last + 2 * margin)[:, None].astype(rough.dtype)
            q, j = np.nonzero(hit)
            most_pairs = max(1, COMPARED_AT_ONCE // max(1, rows.shape[1]))
            for part in range(0, len(q), most_pairs):
                self._add(of[q[part : part + most_pairs]], j[part : part + most_pairs], ids, label, known, rows)

    def _add(self, q: np.ndarray, j: np.ndarray, ids: np.ndarray, label: np.ndarray, known: np.ndarray, rows: np.ndarray) -> None:
        exact = np.round(((rows[j] - self.x[q]) ** 2).sum(axis=1), 9)
        met = np.unique(q)
        of = np.concatenate([np.repeat(met, self.k), q])
        d, near = np.concatenate([self.d[met].ravel(), exact]), np.concatenate([self.near[met].ravel(), ids[j]])
        c, there = np.concatenate([self.label[met].ravel(), label[j]]), np.concatenate([self.known[met].ravel(), known[j]])
        order = np.lexsort((near, d, of))
        begins = np.searchsorted(of[order], met)
        best = order[(begins[:, None] + np.arange(self.k)).ravel()].reshape(len(met), self.k)
        self.d[met], self.near[met], self.label[met], self.known[met] = d[best], near[best], c[best], there[best]
        self.far[met] = np.minimum(self.far[met], self.d[met, -1] * (1 + 2e-6) + 2e-6)

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.d))
        compared = np.zeros(len(q), dtype=np.int64)
        compared[:1] = self.compared
        labels = pa.array(self.label[q, place], mask=~self.known[q, place])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), self.labels.take(pa.array(q)), pa.array(self.near[q, place]), labels, pa.array(self.d[q, place]), pa.array(compared)], ["id", "label", "t_id", "t_label", "d", "compared"])


FOUND = "id long, label long, t_id long, t_label long, d double, compared long"


def _packed(x: np.ndarray) -> tuple[bytes, bool]:
    """The bytes of the vectors, and whether they are of 8 bytes a number."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    wide = not bool((small == x).all())
    return (x if wide else small).tobytes(), wide


def _unpacked(batch: pa.RecordBatch, row: int, items: str, v: str, wide: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    found = batch.column(items)[row].values
    kind = np.float64 if batch.column(wide)[row].as_py() else np.float32
    x = np.frombuffer(batch.column(v)[row].as_buffer(), dtype=kind).reshape(len(found), -1)
    return found.field("id").to_numpy(), found.field("label"), x.astype(np.float64)


def _items(ids: pa.Array, labels: pa.Array) -> pa.Array:
    both = pa.StructArray.from_arrays([ids, labels], ["id", "label"])
    return pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(gap, 0))


@dataclass
class Rings:
    """The pivots, and of every ring: its pivot's number, its own, the radii between which it lies, its rows and blocks."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    blocks: np.ndarray

    def least(self, x: np.ndarray) -> np.ndarray:
        """By query and ring, a distance below which no row of the ring lies."""
        d = _distances(x, self.pivots)
        out = np.maximum(d[:, self.cell] - self.hi, self.lo - d[:, self.cell])
        if len(self.pivots) > 1:
            own = d.argmin(axis=1)
            apart = _distances(self.pivots, self.pivots)[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (d**2 - d[np.arange(len(x)), own][:, None] ** 2) / (2 * apart), 0)
            out = np.maximum(out, plane[:, self.cell])
        return np.maximum(out, 0)

    def least_of(self, x: np.ndarray, own: int, place: int) -> np.ndarray:
        """The same for one ring, of queries whose nearest pivot is `own`."""
        cell = self.cell[place]
        d, apart = _distances(x, self.pivots[[cell, own]]), _distances(self.pivots[[cell]], self.pivots[[own]])[0, 0]
        plane = (d[:, 0] ** 2 - d[:, 1] ** 2) / (2 * apart) if apart > 0 else 0.0
        return np.maximum(np.maximum(d[:, 0] - self.hi[place], self.lo[place] - d[:, 0]), plane)


_ITEM = "id long, label long, v array<double>"
_PACKED = "{0}_items array<struct<id: long, label: long>>, {0}_v binary, {0}_wide boolean"


def _rows(table: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    chosen = table.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    return chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))


def partitioned(rows: DataFrame, block_rows: int, k: int | None = None) -> tuple[DataFrame, Rings]:
    """Blocks (place: the ring's number, chunk, items, vectors) of training rows, and the rings. Of more than k equal vectors in a block those of the k smallest ids stay."""
    n = rows.count()
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, -(-n // block_rows)))).select("v").collect()])
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_vectors(batch.column("v")), held.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "d"])
        give_back()

    placed = cut(rows.mapInArrow(assign, f"{_ITEM}, cell int, d double"), "cells")
    shares = [k / RINGS for k in range(1, RINGS)]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("cn"), F.percentile_approx("d", shares, 1000).alias("q"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("cn") / block_rows).cast("int"))
    edges = F.transform(F.sequence(F.lit(1), rings - 1), lambda k: F.element_at("q", F.ceil(k * RINGS / rings).cast("int")))
    bounds = cells.select("cell", F.when(rings > 1, F.array_distinct(edges)).otherwise(F.array().cast("array<double>")).alias("edges"))
    ringed = placed.join(F.broadcast(bounds), "cell").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("d")))).drop("edges")
    stats = ringed.groupBy("cell", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell", "ring").collect()  # MOST_PIVOTS x RINGS rows
    column = lambda c: np.array([r[c] for r in stats])
    found = Rings(pivots, *(column(c) for c in ("cell", "ring", "lo", "hi", "n")), np.array([-(-r["n"] // block_rows) for r in stats]))
    numbers = F.broadcast(rows.sparkSession.createDataFrame([(r["cell"], r["ring"], k, int(found.blocks[k])) for k, r in enumerate(stats)], "cell int, ring int, place int, blocks int"))
    dealt = ringed.join(numbers, ["cell", "ring"]).select("place", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("chunk"), "id", "label", "v")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, x = (group.column(c).combine_chunks() for c in ("id", "label", "v"))
        x = _vectors(x) + 0.0  # no negative zero
        order = np.lexsort((ids.to_numpy(), *x.T[::-1]))
        x = x[order]
        begins = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        rank = np.arange(len(x)) - np.repeat(begins, np.diff(np.r_[begins, len(x)]))
        kept = np.flatnonzero(rank < (k or len(x)))
        data, wide = _packed(x[kept])
        chosen = pa.array(order[kept])
        return pa.Table.from_pydict({"place": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "block_items": _items(ids.take(chosen), labels.take(chosen)), "block_v": pa.array([data], pa.binary()), "block_wide": pa.array([wide])})

    packed = dealt.groupBy("place", "chunk").applyInArrow(pack, f"place int, chunk int, {_PACKED.format('block')}")
    return cut(packed, "blocks"), found


def _visits(queries: DataFrame, rings: Rings, k: int, first: bool) -> DataFrame:
    """place, chunk, id, label, v: the blocks that a query visits; first: one block of rings that hold k rows together, to bound the distance; else all that `far` leaves."""
    held = queries.sparkSession.sparkContext.broadcast(rings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        few = max(1, AT_ONCE // max(1, len(own.cell)))
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                yield from visits(own, batch.slice(at, few))
        give_back()

    def visits(own: Rings, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        least = own.least(_vectors(batch.column("v")))
        far = None if first else batch.column("far").to_numpy(zero_copy_only=False)
        of, places, chunks, n = [], [], [], 0
        for q in range(len(least)):
            if first:
                order = np.argsort(least[q], kind="stable")
                rings_ = order[: 1 + int(np.searchsorted(np.cumsum(own.n[order] // own.blocks[order]), k))]
                parts = np.zeros(len(rings_), dtype=np.int32)
            else:
                rings_ = np.flatnonzero(least[q] <= far[q])
                parts = np.concatenate([np.arange(b, dtype=np.int32) for b in own.blocks[rings_]])
                rings_ = np.repeat(rings_, own.blocks[rings_])
            of.append(np.full(len(rings_), q))
            places.append(rings_.astype(np.int32))
            chunks.append(parts)
            n += len(parts)
            if n >= AT_ONCE or q + 1 == len(least):
                taken = batch.select(["id", "label", "v"]).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(chunks)), *taken.columns], ["place", "chunk", "id", "label", "v"])
                of, places, chunks, n = [], [], [], 0

    return queries.mapInArrow(run, f"place int, chunk int, {_ITEM}")


def _open_blocks(own: Rings, x: np.ndarray, far: np.ndarray) -> np.ndarray:
    """By number of a block, whether the bounds leave it for any of the queries x."""
    open_, few = np.zeros(len(own.cell), dtype=bool), max(1, AT_ONCE // max(1, len(own.cell)))
    for at in range(0, len(far), few):
        open_ |= (own.least(x[at : at + few]) <= far[at : at + few, None]).any(axis=0)
    return np.repeat(open_, own.blocks)


def _grouped(queries: DataFrame, by: list[str], most: int, rings: Rings | None = None) -> DataFrame:
    """Queries (id, label, v, far) packed to groups of about `most` with the same values of `by` at the most: by, slot, visitor_items, visitor_v, visitor_wide, far.

    With rings also `wanted`, the blocks that a group's bounds leave, in the same call: a Python worker more a task is memory.
    """
    held = queries.sparkSession.sparkContext.broadcast(rings) if rings is not None else None
    slots = queries.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("slots"))
    dealt = queries.join(slots, by).withColumn("slot", F.pmod(F.xxhash64("id", F.lit(5)), F.col("slots")).cast("int"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        ids, labels, x, far = (group.column(c).combine_chunks() for c in ("id", "label", "v", "far"))
        data, wide = _packed(_vectors(x))
        named = {c: pa.array([v.as_py()], pa.int32()) for c, v in zip([*by, "slot"], key, strict=True)}
        bounds = pa.array([far.to_numpy().tobytes()], pa.binary())
        out = {**named, "visitor_items": _items(ids, labels), "visitor_v": pa.array([data], pa.binary()), "visitor_wide": pa.array([wide]), "far": bounds}
        if held is not None:
            wanted = _open_blocks(held.value, _vectors(x), far.to_numpy())
            out["wanted"] = pa.ListArray.from_arrays(pa.array([0, len(wanted)], pa.int32()), pa.array(wanted))
        return pa.Table.from_pydict(out)

    kinds = ", ".join(f"{c} int" for c in [*by, "slot"])
    wanted = ", wanted array<boolean>" if held is not None else ""
    return dealt.select(*by, "slot", "id", "label", "v", "far").groupBy(*by, "slot").applyInArrow(pack, f"{kinds}, {_PACKED.format('visitor')}, far binary{wanted}")


def _group(batch: pa.RecordBatch, row: int, k: int) -> tuple[Best, np.ndarray]:
    """A group's queries, and the distances that bound their k nearest rows."""
    ids, labels, x = _unpacked(batch, row, "visitor_items", "visitor_v", "visitor_wide")
    far = np.frombuffer(batch.column("far")[row].as_buffer(), dtype=np.float64)
    return Best(ids, labels, x, k, far * far), far


def _first_bounds(asked: DataFrame, blocks: DataFrame, rings: Rings, k: int, most: int) -> DataFrame:
    """id, label, far: a distance within which a query has k rows, infinite where the block that it looks at holds fewer."""
    visits = cut(_visits(asked, rings, k, True), "visits").withColumn("far", F.lit(float("inf")))
    groups = cut(_grouped(visits, ["place", "chunk"], most), "visitors")
    copies = groups.select("place", "chunk", "slot").join(blocks, ["place", "chunk"])
    pairs = groups.join(copies, ["place", "chunk", "slot"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                best, _ = _group(batch, row, k)
                best.look(*_unpacked(batch, row, "block_items", "block_v", "block_wide"), np.arange(len(best.ids)))
                yield best.rows()
        give_back()

    rough = pairs.select("visitor_items", "visitor_v", "visitor_wide", "far", "block_items", "block_v", "block_wide").mapInArrow(visit, FOUND)
    order = Window.partitionBy("id", "label").orderBy("d", "t_id")
    # The k-th distance found so far; with fewer than k rows there is no bound. The margin is for rounding.
    bounds = rough.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("id", "label").agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("m"))
    return bounds.select("id", "label", F.when(F.col("c") < k, F.lit(float("inf"))).otherwise(F.sqrt("m") * (1 + 1e-6) + 1e-6).alias("far"))


def _groups_of_cells(bounded: DataFrame, rings: Rings, most: int) -> DataFrame:
    """Groups of queries of one cell, with `wanted`: by number of a block, whether the bounds leave it for any of them."""
    held = bounded.sparkSession.sparkContext.broadcast(rings)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _distances(_vectors(batch.column("v")), held.value.pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])
        give_back()

    placed = bounded.select("id", "label", "v", "far").mapInArrow(place, f"{_ITEM}, far double, cell int")
    return _grouped(placed, ["cell"], most, rings)


def _candidates(groups: DataFrame, blocks: DataFrame, rings: Rings, k: int, sides: tuple[int, int]) -> DataFrame:
    """id, label, t_id, t_label, d, compared: the k nearest rows of each query in each partition of blocks; `compared` counts the rows that a group looked at there, on its first row."""
    held = groups.sparkSession.sparkContext.broadcast(rings)
    begins = np.r_[0, np.cumsum(rings.blocks)[:-1]].tolist()
    numbers = groups.sparkSession.createDataFrame(list(enumerate(map(int, begins))), "place int, begin int")
    numbered = blocks.join(F.broadcast(numbers), "place").withColumn("number", F.col("begin") + F.col("chunk"))
    left = groups.repartition(sides[0], "cell", "slot")
    right = numbered.select("place", "number", "block_items", "block_v", "block_wide").repartition(sides[1], "number")
    pairs = left.hint("shuffle_replicate_nl").join(right, F.get("wanted", F.col("number")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_ = held.value, {}
        for batch in batches:
            for row in range(batch.num_rows):
                cell, slot, place = (batch.column(c)[row].as_py() for c in ("cell", "slot", "place"))
                name = cell, slot
                if name not in open_:
                    if open_ and sum(len(b.ids) for b in open_.values()) >= HELD:
                        yield from (b.rows() for b in open_.values())
                        open_ = {}
                    open_[name] = _group(batch, row, k)[0]
                best = open_[name]
                chosen = np.flatnonzero(own.least_of(best.x, cell, place) <= np.sqrt(best.far))
                if len(chosen):
                    best.look(*_unpacked(batch, row, "block_items", "block_v", "block_wide"), chosen)
        yield from (b.rows() for b in open_.values())
        give_back()

    return pairs.select("cell", "slot", "visitor_items", "visitor_v", "visitor_wide", "far", "place", "block_items", "block_v", "block_wide").mapInArrow(compare, FOUND)


@dataclass
class Found:
    """The k nearest training rows of every test row (id, label, t_id, t_label, d, r), and all candidates with `compared`."""

    best: DataFrame
    candidates: DataFrame

    def pairs_compared(self) -> int:
        return self.candidates.agg(F.sum("compared")).first()[0] or 0


def neighbours(train: DataFrame, test: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "vector", label: str = "label", block_rows: int | None = None) -> Found:
    bound_batches(train.sparkSession)
    # Written, not held: what is held in memory stays there while all that follows runs.
    known, asked = cut(_rows(train, id_col, vector, label), "known"), cut(_rows(test, id_col, vector, label).dropDuplicates(["id", "label"]), "asked")
    n_known, n_asked = known.count(), asked.count()
    if not n_known:
        none = test.sparkSession.createDataFrame([], f"{FOUND}, r int")
        return Found(none, none)
    blocks, rings = partitioned(known, block_rows or _grown(BLOCK_ROWS, n_known, ENOUGH), k)
    most = _grown(VISITORS, n_asked, ENOUGH // 4)
    bounds = _first_bounds(asked, blocks, rings, k, most).withColumnsRenamed({"id": "i", "label": "l"})
    bounded = asked.join(bounds, (F.col("id") == F.col("i")) & F.col("label").eqNullSafe(F.col("l")), "left").drop("i", "l").fillna({"far": float("inf")})
    groups = cut(_groups_of_cells(bounded, rings, most), "visitors")
    sides = max(1, -(-n_asked // SIDE_QUERIES)), max(1, -(-n_known // SIDE_ROWS))
    candidates = cut(_candidates(groups, blocks, rings, k, sides), "candidates")
    order = Window.partitionBy("id", "label").orderBy("d", "t_id")
    return Found(candidates.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k), candidates)


def knn_predictions(train: DataFrame, test: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "vector", label: str = "label", block_rows: int | None = None) -> DataFrame:
    """id, label, predicted: majority of the k nearest (Euclidean), vote ties to the smallest label."""
    best = neighbours(train, test, k, id_col, vector, label, block_rows).best
    votes = best.groupBy("id", "label", "t_label").agg(F.count(F.lit(1)).alias("c"))
    kind = dict(train.dtypes)[label]
    out = votes.groupBy("id", "label").agg(F.min_by("t_label", F.struct(-F.col("c"), F.col("t_label"))).alias("predicted"))
    return out.select(F.col("id").alias(id_col), F.col("label").cast(kind).alias(label), F.col("predicted").cast(kind).alias("predicted"))
