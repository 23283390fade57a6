"""Distance work between two sets of vectors, cell by cell, on grids of strips.

Vectors are assigned to the nearest of a number of pivots that grows with the root
of the rows. A query meets only the cells that the triangle inequality cannot rule
out (the partition-based kNN join of Lu et al., VLDB 2012). The pairs of a cell are
cut into a grid: its queries into some strips, its vectors into others, and each pair
of strips is one group of rows. With g groups a vector is copied to about the root of
g of them, however large the cell. Inside its group a task walks over pairs of blocks,
and a kernel reduces each to a few numbers per query: pairs themselves are never
written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltrail.scratch import cut

BLOCK_ROWS = 2048
BLOCK_BYTES = 8 << 20
STRIP_BLOCKS = 16  # most blocks on one side of a group
RUN_PAIRS = 1 << 19  # so many pairs are measured at a time where blocks are small: they stay in the cache
GROUP_PAIRS = 1 << 21  # a group has as many pairs at least, if there are as many
GROUPS_PER_TASK = 4
NEAR_LIST = 64
WIDEN = 0.5  # share of all pairs
_SLACK = 1e-9  # relative room for rounding in pruning bounds

# reach(vectors, their distances to the pivots, cells, further query columns) -> mask
Reach = Callable[[np.ndarray, np.ndarray, "Cells", pa.RecordBatch], np.ndarray]


@dataclass(frozen=True)
class Cells:
    """Base vectors with their ``cell``, and bounds of each cell.

    ``radius`` is the largest member distance to the pivot, ``near`` the smallest
    few, ``count`` the members of each cell.
    """

    rows: DataFrame | None
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    near: np.ndarray
    block_rows: int

    @property
    def total(self) -> int:
        return int(self.count.sum())

    @cached_property
    def gaps(self) -> np.ndarray:
        """Distances between the pivots."""
        return _to_pivots(self.pivots, self.pivots)


@dataclass(frozen=True)
class Block:
    """One side of a block pair inside a kernel."""

    data: pa.Table
    vec: np.ndarray

    def __getitem__(self, name: str) -> np.ndarray:
        return self.data.column(name).to_numpy()

    @cached_property
    def ball(self) -> tuple[np.ndarray, float]:
        """A centre, and the largest distance of a vector to it."""
        center = self.vec.mean(axis=0)
        gap = self.vec - center
        return center, math.sqrt(float((gap * gap).sum(axis=1).max()))

    @cached_property
    def sizes(self) -> np.ndarray:
        """Squares of the vectors."""
        return (self.vec * self.vec).sum(axis=1)

    @cached_property
    def asking(self) -> np.ndarray:
        """The vectors in single precision, with a one."""
        return np.concatenate([self.vec, np.ones((len(self.vec), 1))], axis=1).astype(np.float32)

    @cached_property
    def held(self) -> np.ndarray:
        """The vectors times -2 in single precision, with their squares: the product with ``asking`` lacks only the squares of the queries."""
        return np.concatenate([-2.0 * self.vec, self.sizes[:, None]], axis=1).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """List column to a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def exact_squares(
    a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, step: int = 1 << 16
) -> np.ndarray:
    """Squared distances of chosen pairs from the coordinate gaps.

    Equal vectors get exactly zero, and a pair gets the same value from both ends.
    """
    out = np.empty(len(rows))
    for i in range(0, len(rows), step):
        gap = a[rows[i : i + step]] - b[cols[i : i + step]]
        out[i : i + step] = (gap * gap).sum(axis=1)
    return out


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of one block pair by matrix product, and their rounding room.

    Small values, where the product cancels, are taken from the gaps instead.
    """
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    scale = float(na.max() + nb.max())
    out = np.add.outer(na, nb)
    out -= a @ (2.0 * b).T
    rows, cols = where(out <= 1e-6 * scale)
    out[rows, cols] = exact_squares(a, b, rows, cols)
    return out, 1e-12 * scale


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a mask that holds for few: several times as fast as ``np.nonzero``."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


_SHORT_DIM = 16  # from so many components on, products in single precision save more than their wider room costs
_SHORT_SCALES = (1e-20, 1e30)


def rough_squares(q: Block, b: Block) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared distances of one block pair without the squares of the queries, these squares, and the rounding room.

    Where there are many components the product is in single precision; the room holds for it.
    """
    na, nc = q.sizes, b.sizes
    scale = float(na.max() + nc.max())
    if q.vec.shape[1] >= _SHORT_DIM and _SHORT_SCALES[0] < scale < _SHORT_SCALES[1]:
        return q.asking @ b.held.T, na, 4.0 * (q.vec.shape[1] + 8) * 2.0**-24 * scale
    out = (-2.0 * q.vec) @ b.vec.T
    out += nc[None, :]
    return out, na, 1e-12 * scale


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(a, b)[0])


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs of a block pair are no farther apart than ``eps``, bound included."""
    out, room = squares(a, b)
    limit = eps * eps
    mask = out <= limit
    rows, cols = where(np.abs(out - limit) <= room + 1e-12 * limit)
    mask[rows, cols] = np.sqrt(exact_squares(a, b, rows, cols)) <= eps
    return mask


def block_size(dim: int, rows: int = BLOCK_ROWS) -> int:
    return max(16, min(rows, BLOCK_BYTES // (8 * max(dim, 1))))


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot ``cell`` and distance ``pd`` for every point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _to_pivots(matrix(batch.column("vec")), pivots)
            cell = far.argmin(axis=1)
            near = far[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)],
                names=[*batch.schema.names, "cell", "pd"],
            )

    schema = T.StructType(points.schema.fields + [
        T.StructField("cell", T.IntegerType()), T.StructField("pd", T.DoubleType())
    ])
    return points.mapInArrow(run, schema)


def _to_pivots(vec: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if len(vec) == 0:
        return np.zeros((0, len(pivots)))
    squares = (vec * vec).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * vec @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def pick_pivots(points: DataFrame, rows: int, block_rows: int) -> np.ndarray:
    """Member vectors in hash order, one for each block but at most the root of the rows; all other rows stay in play."""
    wanted = max(1, min(math.ceil(rows / block_rows), math.ceil(math.sqrt(rows))))
    if wanted == 1:
        return np.zeros((1, 0))
    chosen = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
    return np.unique(np.array([list(r.vec) for r in chosen], dtype=np.float64), axis=0)


def make_cells(
    points: DataFrame,
    near_k: int = 1,
    block_rows: int | None = None,
    pivots: np.ndarray | None = None,
) -> Cells:
    """Cells of ``points(id BIGINT, vec ARRAY<DOUBLE>, ...)``.

    Further columns travel with their row into the kernels.
    """
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if shape.n == 0:
        raise ValueError("no vectors to search or cluster")
    block_rows = block_rows or block_size(shape.d)
    if pivots is None:
        pivots = pick_pivots(points, shape.n, block_rows)
    size = len(pivots)
    radius, count = np.zeros(size), np.zeros(size, dtype=np.int64)
    near = np.full((size, min(near_k, NEAR_LIST)), np.inf)
    if size == 1:
        # All queries meet the only cell, so it needs no bounds.
        count[0] = shape.n
        return Cells(points.withColumn("cell", F.lit(0)), pivots, radius, count, near, block_rows)
    assigned = cut(_assign(points, pivots), "cells")
    for row in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("pd").alias("r")).collect():
        radius[row.cell], count[row.cell] = row.r, row.n
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("pd"))
    closest = assigned.select("cell", "pd", rank.alias("r")).filter(F.col("r") <= near.shape[1])
    for row in closest.collect():
        near[row.cell, row.r - 1] = row.pd
    return Cells(assigned.drop("pd"), pivots, radius, count, near, block_rows)


def reach_all(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
    """Every cell: for sums and counts over all pairs."""
    return np.ones(far.shape, dtype=bool)


def reach_within(eps: float) -> Reach:
    """Cells that may hold a vector no farther than ``eps``."""

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        slack = _SLACK * (1.0 + far)
        return far - cells.radius[None, :] <= eps + slack

    return run


def reach_bound(column: str) -> Reach:
    """Cells that may hold a vector no farther than the query's own bound."""

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        bound = rows.column(column).to_numpy(zero_copy_only=False)
        return far - cells.radius[None, :] <= bound[:, None] + _SLACK * (1.0 + far)

    return run


def reach_own(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
    """The cell that the query itself is in."""
    return rows.column("cell").to_numpy(zero_copy_only=False)[:, None] == np.arange(len(cells.pivots))[None, :]


def _least(vec: np.ndarray, far: np.ndarray, cells: Cells) -> np.ndarray:
    """What the distance of a query to the vectors of a cell is at least.

    These lie within the cell's radius, and beyond the plane half way between its pivot and the query's nearest one.
    """
    nearest = far.argmin(axis=1)
    own = far[np.arange(len(far)), nearest]
    room = 1e-12 * (1.0 + (vec * vec).sum(axis=1) + (cells.pivots * cells.pivots).sum(axis=1).max())
    gap = cells.gaps[nearest]
    plane = np.full(far.shape, -np.inf)
    np.divide(far * far - (own * own + room)[:, None], 2.0 * gap, out=plane, where=gap > 1e-6)
    return np.maximum(far - cells.radius[None, :], plane)


def reach_beyond(column: str) -> Reach:
    """Cells other than the query's own that may hold a vector no farther than the query's own bound."""

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        bound = rows.column(column).to_numpy(zero_copy_only=False)
        near = _least(vec, far, cells) <= bound[:, None] + _SLACK * (1.0 + far)
        return near & ~reach_own(vec, far, cells, rows)

    return run


def reach_nearest(k: int) -> Reach:
    """Cells that may hold one of the ``k`` nearest vectors.

    The k-th smallest of (distance to pivot + member's distance to pivot) bounds
    the k-th neighbour from above; members beyond the kept list count with the
    cell's radius.
    """

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        width, wanted = cells.near.shape[1], min(k, cells.total)
        tops = [far + cells.near[None, :, j] for j in range(width)]
        if wanted <= width:  # the kept lists alone hold as many, none of them behind the radius of its cell
            bound = np.partition(np.concatenate(tops, axis=1), wanted - 1, axis=1)[:, wanted - 1 : wanted]
            return far - cells.radius[None, :] <= bound + _SLACK * (1.0 + far)
        weights = [np.ones_like(far)] * width
        rest = np.maximum(cells.count - width, 0)
        tops.append(np.where(rest > 0, far + cells.radius[None, :], np.inf))
        weights.append(np.broadcast_to(rest, far.shape))
        top, weight = np.concatenate(tops, axis=1), np.concatenate(weights, axis=1)
        order = np.argsort(top, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(weight, order, 1), axis=1) >= wanted
        bound = np.take_along_axis(np.take_along_axis(top, order, 1), reached.argmax(1)[:, None], 1)
        return far - cells.radius[None, :] <= bound + _SLACK * (1.0 + far)

    return run


def reach_probes(n: int) -> Reach:
    """The ``n`` cells with the nearest pivots: an approximate search."""

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        order = np.argsort(far, axis=1, kind="stable")[:, :n]
        mask = np.zeros(far.shape, dtype=bool)
        np.put_along_axis(mask, order, True, axis=1)
        return mask

    return run


def _reached(batch: pa.RecordBatch, bounds: Cells, reach: Reach) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a batch and the cells they have to meet, some rows at a time."""
    vec = matrix(batch.column("vec"))
    step = max(1, min(1024, (1 << 22) // len(bounds.pivots)))
    for start in range(0, len(vec), step):
        part = vec[start : start + step]
        far = _to_pivots(part, bounds.pivots)
        mask = reach(part, far, bounds, batch.slice(start, len(part))) & (bounds.count > 0)[None, :]
        row, cell = np.nonzero(mask)
        yield row + start, cell.astype(np.int32)


@dataclass(frozen=True)
class Grid:
    """How the pairs of each cell are cut: strips of queries and of vectors, and the number of its first group."""

    asking: np.ndarray
    held: np.ndarray
    first: np.ndarray

    @property
    def groups(self) -> int:
        return int((self.asking * self.held).sum())


def make_grid(asked: np.ndarray, count: np.ndarray, block_rows: int, tasks: int) -> Grid:
    """Groups of about equal numbers of pairs, a few for each task and as many as bounded strips need.

    ``asked`` and ``count`` are the queries and vectors of each cell. The strips of a cell are such that a
    query and a vector are copied about equally often.
    """
    pairs = asked.astype(float) * count
    share = max(float(GROUP_PAIRS), pairs.sum() / max(1, GROUPS_PER_TASK * tasks))
    wanted = np.maximum(1.0, pairs / share)
    side = np.sqrt(wanted * np.maximum(asked, 1) / np.maximum(count, 1))
    strip = STRIP_BLOCKS * block_rows
    asking = np.ceil(np.clip(side, asked / strip, np.maximum(1, asked)) - 1e-9).astype(np.int64)
    held = np.ceil(np.clip(wanted / np.maximum(side, 1), count / strip, np.maximum(1, count)) - 1e-9).astype(np.int64)
    asking, held = np.maximum(1, asking), np.maximum(1, held)
    sizes = asking * held
    return Grid(asking, held, np.cumsum(sizes) - sizes)


def _strip_of(ids: np.ndarray, strips: np.ndarray, odd: int) -> np.ndarray:
    """A strip for each row by a mix of its id."""
    mixed = (ids.astype(np.uint64) + np.uint64(odd)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % strips.astype(np.uint64)).astype(np.int64)


def _copied(batch: pa.RecordBatch, row: np.ndarray, group: np.ndarray, name: str) -> pa.RecordBatch:
    taken = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(group)], names=[*taken.schema.names, name])


_COPIES = 1 << 14  # rows copied to their groups at a time


def _deal(rows: DataFrame, name: str, places: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], strips: Callable) -> DataFrame:
    """Each row once for every group that it belongs to, with the group in column ``name``.

    ``places`` gives row numbers and cells, ``strips(ids, cells)`` the first group, the step and the number of groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, cell in places(batch):
                first, step, times = strips(ids[row], cell)
                ends = np.cumsum(times)
                for a in range(0, int(ends[-1]) if len(ends) else 0, _COPIES):
                    at = np.arange(a, min(a + _COPIES, int(ends[-1])))
                    k = np.searchsorted(ends, at, side="right")
                    nth = at - (ends[k] - times[k])
                    yield _copied(batch, row[k], first[k] + nth * step[k], name)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField(name, T.LongType())]))


def meet(
    queries: DataFrame,
    cells: Cells,
    reach: Reach,
    kernel: Callable[..., dict[str, np.ndarray] | None],
    schema: str,
    fold: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None,
    place: str | None = None,
    widen: bool = True,
    told: bool = False,
) -> DataFrame:
    """Run ``kernel(query block, base block)`` wherever ``reach`` says they may meet.

    ``queries`` has ``id, vec`` and further columns; the kernel returns columns of
    ``schema`` or None. ``fold`` reduces what a block of queries got from the blocks of its group.
    With ``told`` the kernel gets as its third argument what ``fold`` made of the blocks before, None at first. It then
    takes a run of small blocks of vectors at once, twice as many each time, so that the bound it is told keeps up with them.
    ``place`` names a column that numbers the vectors from 0 on, where all meet all: strips and blocks then hold neighbours.
    Where the cells to meet hold a share of ``WIDEN`` of all pairs, all meet all, as a copy of a query for each cell
    would cost more than the pairs that are spared; ``widen`` is off where ``reach`` chooses what is found.
    """
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = replace(cells, rows=None)
    everywhere = reach is reach_all or len(cells.pivots) == 1
    if everywhere:
        grid = make_grid(np.array([queries.count()]), np.array([cells.total]), cells.block_rows, tasks)
    else:

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, cell in _reached(batch, bounds, reach):
                    found, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["cell", "n"])

        # Which cells a query meets is worked out twice, as that costs less than keeping a copy of it for each cell.
        asked = np.zeros(len(cells.pivots), dtype=np.int64)
        for row in queries.mapInArrow(tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            asked[row.cell] = row.n
        rows = queries.count() if widen else 0
        everywhere = widen and float(asked @ cells.count) >= WIDEN * rows * cells.total
        if everywhere:  # strips of small blocks would be short, and many
            strip_rows = max(cells.block_rows, block_size(cells.pivots.shape[1]))
            grid = make_grid(np.array([rows]), np.array([cells.total]), strip_rows, tasks)
        else:
            grid = make_grid(asked, np.where(asked > 0, cells.count, 0), cells.block_rows, tasks)

    def reached(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _reached(batch, bounds, reach)

    def own_cell(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        row = np.flatnonzero(asked[cell] > 0)
        yield row, cell[row]

    def ask(ids: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = grid.held[cell]
        return grid.first[cell] + _strip_of(ids, grid.asking[cell], 1) * held, np.ones(len(ids), dtype=np.int64), held

    def hold(ids: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return grid.first[cell] + _strip_of(ids, grid.held[cell], 2), grid.held[cell], grid.asking[cell]

    if everywhere:
        asking, held = int(grid.asking[0]), int(grid.held[0])
        strip = F.pmod(F.xxhash64("id", F.lit("asks")), F.lit(asking)) * held
        left = queries.withColumn("_asks", F.explode(F.sequence(strip, strip + (held - 1))) if held > 1 else strip)
        strip = F.pmod(F.xxhash64("id", F.lit("holds")), F.lit(held))
        if place is not None:
            strip = F.floor(F.col(place) * held / F.lit(max(1, cells.total)))
        every = F.explode(F.sequence(strip, strip + (asking - 1) * held, F.lit(held).cast("long"))) if asking > 1 else strip
        right = cells.rows.withColumn("_holds", every)
        right = right.toDF(*right.columns)  # columns of its own, where both sides are one table
    else:
        left, right = _deal(queries, "_asks", reached, ask), _deal(cells.rows, "_holds", own_cell, hold)
    arrow_schema, block_rows = _arrow_schema(spark, schema), cells.block_rows

    def run(asking: pa.Table, members: pa.Table) -> pa.Table:
        if not asking.num_rows or not members.num_rows:
            return arrow_schema.empty_table()
        found = []
        if place is not None:
            members = members.sort_by(place)
        base = [Block(part, matrix(part.column("vec"))) for part in (_runs if told else _blocks)(members, block_rows)]
        for part in _blocks(asking, block_rows):
            query = Block(part, matrix(part.column("vec")))
            if told:
                seen = None
                for block in base:
                    r = kernel(query, block, seen)
                    if len(next(iter(r.values()))):
                        seen = fold(r if seen is None else {c: np.concatenate([seen[c], r[c]]) for c in r})
                if seen is not None:
                    found.append(pa.Table.from_pydict(seen, schema=arrow_schema))
                continue
            results = [r for r in (kernel(query, block) for block in base) if r is not None]
            if results and fold is not None and len(results) > 1:
                results = [fold({c: np.concatenate([r[c] for r in results]) for c in results[0]})]
            found += [pa.Table.from_pydict(r, schema=arrow_schema) for r in results]
        return pa.concat_tables(found) if found else arrow_schema.empty_table()

    return left.groupBy("_asks").cogroup(right.groupBy("_holds")).applyInArrow(run, schema)


_CODE_BITS, _MIX_BITS = 48, 14


def with_place(points: DataFrame, name: str) -> DataFrame:
    """A number in column ``name`` that neighbours among ``points(id, vec, ...)`` have in common: the bits of their coordinates in turn.

    Its last bits are a mix of the id, so rows at one place can be told apart.
    """
    ends = points.select(F.posexplode("vec").alias("k", "x")).groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k").collect()
    lo = np.array([r.lo for r in ends], dtype=float)
    width = np.array([r.hi for r in ends], dtype=float) - lo
    bits = _CODE_BITS // max(1, len(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("vec"))
            share = np.divide(vec - lo, width, out=np.zeros(vec.shape), where=width > 0) if len(vec) else vec
            step = np.clip(np.nan_to_num(share) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            code = np.zeros(len(vec), dtype=np.int64)
            for bit in range(bits - 1, -1, -1):
                for k in range(step.shape[1]):
                    code = (code << 1) | ((step[:, k] >> bit) & 1)
            mixed = _strip_of(batch.column("id").to_numpy(zero_copy_only=False), np.array(1 << _MIX_BITS), 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((code << _MIX_BITS) | mixed)], names=[*batch.schema.names, name])

    return points.mapInArrow(run, T.StructType(points.schema.fields + [T.StructField(name, T.LongType())]))


def _near_order(vec: np.ndarray, size: int) -> np.ndarray:
    """Row numbers such that ``size`` of them in a row are neighbours: halved along the widest side, again and again."""
    order, todo = np.arange(len(vec)), [(0, len(vec))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        own = order[a:b]
        part = vec[own]
        half = size * math.ceil((b - a) / size / 2)
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order[a:b] = own[np.argpartition(part[:, axis], half - 1)]
        todo += [(a, a + half), (a + half, b)]
    return order


def meet_pairs(
    points: DataFrame,
    kernel: Callable[[Iterator[tuple[Block, Block, bool]]], dict[str, np.ndarray]],
    schema: str,
    block_rows: int,
    place: str | None = None,
) -> DataFrame:
    """Run ``kernel`` over pairs of blocks such that every pair of ``points(id, vec, ...)`` is met once, in one direction.

    The third of what the kernel gets tells that both blocks are the same one. Rows are dealt to strips;
    a pair of strips is a group, whose blocks go to one call, so a row is copied once for each strip.
    ``place`` names a column of ``with_place``: strips and blocks then hold neighbours, so that their bounds tell much.
    """
    spark = points.sparkSession
    rows = points.count()
    pairs = rows * rows / 2
    wanted = pairs / max(float(GROUP_PAIRS), pairs / (GROUPS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    strips = max(1, math.ceil(math.sqrt(2 * wanted) - 1e-9), math.ceil(rows / (STRIP_BLOCKS * BLOCK_ROWS)))
    strip, other = F.pmod(F.xxhash64("id", F.lit("pairs")), F.lit(strips)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long")))
    if place is not None and strips > 1:
        ends = points.agg(F.percentile_approx(place, [k / strips for k in range(1, strips)])).first()[0]
        strip = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col(place))).cast("long")
    dealt = points.withColumn("_strip", strip).withColumn("_other", other)
    dealt = dealt.select(*points.columns, "_strip", F.least("_strip", "_other").alias("_lo"), F.greatest("_strip", "_other").alias("_hi"))
    arrow_schema = _arrow_schema(spark, schema)

    def cut_up(rows: pa.Table) -> list[Block]:
        if place is not None and rows.num_rows:
            rows = rows.take(pa.array(_near_order(matrix(rows.column("vec")), block_rows)))
        return [Block(part, matrix(part.column("vec"))) for part in _blocks(rows, block_rows)]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key)
        sides = [cut_up(table.filter(pc.equal(table["_strip"], side))) for side in dict.fromkeys((lo, hi))]
        met = ((a, b, lo == hi and i == j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[-1]) if lo != hi or i <= j)
        return pa.Table.from_pydict(kernel(met), schema=arrow_schema)

    return dealt.groupBy("_lo", "_hi").applyInArrow(run, schema)


def _blocks(rows: pa.Table, size: int) -> list[pa.Table]:
    return [rows.slice(a, size) for a in range(0, rows.num_rows, size)]


def _runs(rows: pa.Table, size: int) -> list[pa.Table]:
    """Runs of 1, 2, 4, ... blocks, of ``RUN_PAIRS`` pairs with a block of queries at most; single blocks where one has as many."""
    found, start, blocks = [], 0, 1
    while start < rows.num_rows:
        found.append(rows.slice(start, blocks * size))
        start += blocks * size
        blocks = max(1, min(2 * blocks, RUN_PAIRS // (size * size)))
    return found


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    # The types that kernels return.
    names = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(),
             "array<double>": pa.list_(pa.float64())}
    fields = [field.strip().split(" ", 1) for field in ddl.split(",")]
    return pa.schema([(name, names[kind.strip()]) for name, kind in fields])
