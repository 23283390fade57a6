"""Hierarchical density clustering, selected by excess of mass.

The spanning tree of mutual reachability grows in Boruvka rounds of block joins: a component
meets its own cells first, then others only as far as the shortest edge found so far.
The tree is then cut into a light and a heavy half by edge length, again and again,
until a part is small enough for one task: inside the light half only components
of at least the smallest cluster size matter, and in the heavy half each component
is one vertex. No task ever holds more than ``PART_EDGES`` edges. Edges of equal
length merge at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.operators.blocks import (
    Block,
    Cells,
    Reach,
    exact_squares,
    make_cells,
    matrix,
    meet,
    reach_beyond,
    reach_own,
    where,
)
from labeltrail.operators.cluster.common import NOISE, Clustering, rank_labels
from labeltrail.operators.cluster.components import components
from labeltrail.operators.cluster.dbscan import min_samples_for
from labeltrail.operators.heavy import lookup
from labeltrail.operators.position import with_position
from labeltrail.operators.search import best_hits, nearest, nearest_fold, nearest_kernel
from labeltrail.scratch import cut

PART_EDGES = 100_000
_EXITS = "kind string, id bigint, m double, name string, parent string"


def min_cluster_size_for(n: int, alpha: float) -> int:
    return max(2, int(n / (10 * alpha)))


def core_distances(reps: DataFrame, min_samples: int, block_rows: int | None = None) -> DataFrame:
    """``id, core``: distance to the ``min_samples``-th other row, copies counted."""
    hits = _neighbours(reps, min_samples + 1, block_rows)
    # The row itself is its own first hit and counts with its other copies only.
    others = F.when(F.col("qid") == F.col("bid"), F.col("w") - 1).otherwise(F.col("w"))
    reached = F.sum(others).over(
        Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    enough = hits.withColumn("reached", reached)
    return enough.groupBy(F.col("qid").alias("id")).agg(
        F.sqrt(
            F.coalesce(F.min(F.when(F.col("reached") >= min_samples, F.col("d2"))), F.max("d2"))
        ).alias("core")
    )


def _neighbours(reps: DataFrame, k: int, block_rows: int | None) -> DataFrame:
    """``qid, bid, d2, w, rank`` of the ``k`` nearest; those of the own cell bound the search in the others."""
    cells = make_cells(reps.select("id", "vec", "w"), k, block_rows)
    if len(cells.pivots) == 1:
        return nearest(reps.select("id", "vec"), cells, k, carry="w")
    schema = "qid bigint, bid bigint, d2 double, w bigint"
    kernel, fold = nearest_kernel(k, "w"), nearest_fold(k)
    asked = cells.rows.select("id", "vec", "cell")
    own = cut(best_hits(meet(asked, cells, reach_own, kernel, schema, fold, widen=False, told=True), k), "own-hits")
    last = F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf")))
    bounds = own.groupBy(F.col("qid").alias("id")).agg(last.alias("bound"))
    bounded = cut(asked.join(bounds, "id"), "bounded")

    def within_bound(q: Block, b: Block, seen: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        hits = kernel(q, b, seen)
        order = np.argsort(q["id"])
        asking = order[np.searchsorted(q["id"], hits["qid"], sorter=order)]
        near = hits["d2"] <= (q["bound"][asking] * (1.0 + 1e-9)) ** 2
        return {c: v[near] for c, v in hits.items()}

    far = meet(bounded, cells, reach_beyond("bound"), within_bound, schema, fold, told=True)
    # Where all meet all, the own cell is met twice.
    return best_hits(own.drop("rank").unionByName(far).repartition("qid").distinct(), k)


_EDGE_ROWS = 128  # with a block of 2048 their distances stay in the cache


def _edge_kernel(q: Block, b: Block):
    """Shortest edge out of each component of the query block."""
    comp, other = q["comp"], b["comp"]
    if comp[0] == other[0] and (comp == comp[0]).all() and (other == other[0]).all():
        return None
    core, core2 = q["core"], q["core"] ** 2
    na, nb = (q.vec * q.vec).sum(axis=1), (b.vec * b.vec).sum(axis=1)
    room = 1e-12 * float(na.max() + nb.max())
    twice, least = -2.0 * b.vec.T, b["core"] ** 2
    names, place = np.unique(comp, return_inverse=True)
    best = np.full(len(names), np.inf)
    found = []
    for a in range(0, len(comp), _EDGE_ROWS):
        part = slice(a, a + _EDGE_ROWS)
        reach = q.vec[part] @ twice
        reach += nb[None, :]
        reach += na[part, None]
        np.maximum(reach, least[None, :], out=reach)
        reach[comp[part, None] == other[None, :]] = np.inf
        top = np.maximum(reach.min(axis=1), core2[part])
        np.minimum.at(best, place[part], top)
        limit = best[place[part]] + 2 * room
        rows = np.flatnonzero((top <= limit) & np.isfinite(top))
        if len(rows):
            at, cols = where(reach[rows] <= limit[rows, None])
            found.append((rows[at] + a, cols))
    if not found:
        return None
    rows, cols = (np.concatenate(c) for c in zip(*found))
    m = np.maximum(np.sqrt(exact_squares(q.vec, b.vec, rows, cols)), np.maximum(core[rows], b["core"][cols]))
    lo, hi = np.minimum(q["id"][rows], b["id"][cols]), np.maximum(q["id"][rows], b["id"][cols])
    comp, other = comp[rows], other[cols]
    order = np.lexsort((hi, lo, m, comp))
    first = order[np.unique(comp[order], return_index=True)[1]]
    return {"comp": comp[first], "m": m[first], "lo": lo[first], "hi": hi[first], "other": other[first]}


def _mixed(reach: Reach, low: np.ndarray, high: np.ndarray) -> Reach:
    """``reach`` without the cells whose rows are all of the query's own component; these go from ``low`` to ``high``."""

    def run(vec: np.ndarray, far: np.ndarray, cells: Cells, rows: pa.RecordBatch) -> np.ndarray:
        comp = rows.column("comp").to_numpy(zero_copy_only=False)[:, None]
        return reach(vec, far, cells, rows) & ((low[None, :] != comp) | (high[None, :] != comp))

    return run


def _to_others(state: DataFrame, marks: list) -> DataFrame:
    """``comp, n, m``: rows of a component, and what its shortest edge to one of the rows ``marks`` of others is at most."""
    pivots, cores, comps = np.array([list(r.vec) for r in marks]), np.array([r.core for r in marks]), np.array([r.comp for r in marks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (pivots * pivots).sum(axis=1)
        for batch in batches:
            step = max(1, min(1024, (1 << 22) // len(pivots)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                vec, own = matrix(part.column("vec")), part.column("comp").to_numpy(zero_copy_only=False)
                core = part.column("core").to_numpy(zero_copy_only=False)
                square = (vec * vec).sum(axis=1)[:, None] + size[None, :]
                far = np.sqrt(np.maximum(square - 2.0 * vec @ pivots.T, 0.0) + 1e-12 * square)
                m = np.maximum(far, np.maximum(core[:, None], cores[None, :]))
                m[own[:, None] == comps[None, :]] = np.inf
                names, place, n = np.unique(own, return_inverse=True, return_counts=True)
                best = np.full(len(names), np.inf)
                np.minimum.at(best, place, m.min(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array(best)], names=["comp", "n", "m"])

    return state.select("vec", "core", "comp").mapInArrow(run, "comp bigint, n bigint, m double")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, root`` of the components of few edges."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([find(v) for v in ids], pa.int64())], names=["id", "root"]
    )


def _roots(edges: DataFrame, part_edges: int) -> DataFrame:
    """``id, root`` of the components of ``edges(a, b)``; a task works on as many edges as on a part of the tree."""
    if edges.count() > part_edges:
        return components(edges)
    return cut(edges.repartition(1).mapInArrow(_linked, "id bigint, root bigint"), "roots")


def spanning_tree(reps: DataFrame, block_rows: int | None = None, part_edges: int = PART_EDGES) -> DataFrame:
    """Edges ``lo, hi, m`` of the tree over ``reps(id, vec, core)``."""
    cells = make_cells(reps.select("id", "vec", "core"), block_rows=block_rows)
    state = cells.rows.withColumn("comp", F.col("id"))
    schema = "comp bigint, m double, lo bigint, hi bigint, other bigint"
    tree: DataFrame | None = None
    one_cell = len(cells.pivots) == 1
    if not one_cell:
        places = reps.sparkSession.createDataFrame([(p.tolist(),) for p in cells.pivots], "vec array<double>")
        marks = cut(cells.rows.join(F.broadcast(places), "vec", "left_semi").select("id"), "marks")

    def shortest(found: DataFrame) -> DataFrame:
        return cut(
            found.groupBy("comp").agg(F.min(F.struct("m", "lo", "hi", "other")).alias("e")).select("comp", "e.*"),
            "shortest",
        )

    while True:
        now = replace(cells, rows=state)
        if one_cell:
            sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
            edges = shortest(meet(state, now, reach_own, _edge_kernel, schema))
        else:
            low, high = np.zeros((2, len(cells.pivots)), dtype=np.int64)
            for r in state.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).collect():
                low[r.cell], high[r.cell] = r.low, r.high
            own = shortest(meet(state, now, _mixed(reach_own, low, high), _edge_kernel, schema, widen=False))
            # What the own cell holds bounds the search in the others, as do the rows at the pivots.
            seen = state.join(F.broadcast(marks), "id", "left_semi").select("vec", "core", "comp").collect()
            bounds = _to_others(state, seen).unionByName(own.select("comp", F.lit(0).cast("bigint").alias("n"), "m"))
            sizes = cut(bounds.groupBy("comp").agg(F.sum("n").alias("n"), F.min("m").alias("bound")), "bounds")
            bounded = cut(lookup(state, sizes, "comp", "n").filter("core <= bound"), "bounded")
            far = meet(bounded, now, _mixed(reach_beyond("bound"), low, high), _edge_kernel, schema)
            edges = shortest(own.unionByName(far))
        if edges.isEmpty():
            break
        chosen = edges.select("lo", "hi", "m")
        tree = chosen if tree is None else tree.unionByName(chosen)
        roots = _roots(edges.select(F.col("comp").alias("a"), F.col("other").alias("b")), part_edges)
        merged = cut(sizes.select("comp", "n").join(roots.select(F.col("id").alias("comp"), "root"), "comp"), "merged")
        if merged.agg(F.count_distinct("root")).first()[0] == 1:
            break
        moved = lookup(state, merged, "comp", "n")
        state = cut(moved.select("id", "vec", "core", "cell", F.col("root").alias("comp")), "state")
    if tree is None:
        return reps.sparkSession.createDataFrame([], "lo bigint, hi bigint, m double")
    return cut(tree.distinct(), "tree")


def _merge_part(min_size: int):
    """One part of the tree, edges in ascending order.

    A vertex row has ``b`` null. Vertices of at least ``min_size`` come in with a
    cluster; the others leave where their component first reaches that size.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        name = f"{key[0]}"
        vertices, edges = part[part["b"].isna()], part[part["b"].notna()].sort_values("m")
        parent = {int(v): int(v) for v in vertices["a"]}
        size = dict(zip(vertices["a"].astype(int), vertices["size"]))
        cluster = {int(v): c for v, c in zip(vertices["a"], vertices["cluster"]) if c is not None and c == c}
        waiting = {v: [v] for v in parent if v not in cluster}
        out: list[tuple] = []

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def settle(groups: dict[int, set[int]], m: float) -> None:
            for root, members in groups.items():
                named = [cluster.pop(r) for r in members if r in cluster]
                held = [v for r in members for v in waiting.pop(r, [])]
                size[root] = sum(size[r] for r in members)
                if size[root] < min_size:
                    waiting[root] = held
                    continue
                top = named[0] if len(named) == 1 else f"{name}/{root}/{m!r}"
                if len(named) > 1:
                    out.extend(("cluster", -1, m, child, top) for child in named)
                cluster[root] = top
                out.extend(("exit", v, m, top, None) for v in held)

        lengths, firsts = np.unique(edges["m"].to_numpy(), return_index=True)
        links = list(zip(edges["a"].astype(int).tolist(), edges["b"].astype(int).tolist()))
        for m, first, end in zip(lengths, firsts, [*firsts[1:], len(links)]):
            touched: dict[int, set[int]] = {}
            for a, b in links[first:end]:
                x, y = find(a), find(b)
                if x == y:
                    continue
                parent[y] = x
                touched[x] = touched.pop(x, {x}) | touched.pop(y, {y})
            settle(touched, float(m))
        out.extend(("top", int(key[0]), 0.0, c, None) for c in cluster.values())
        return pd.DataFrame(out, columns=["kind", "id", "m", "name", "parent"])

    return run


def _halve(vertices: DataFrame, edges: DataFrame, part_edges: int) -> DataFrame | None:
    """Edges of the parts that are too long, with ``light``; None when there are none."""
    shape = edges.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("m", F.lit(0.5)).alias("mid"), F.max("m").alias("top"),
        F.min("m").alias("low"),
    )
    # A part whose edges are all of one length has nothing to order.
    long = cut(shape.filter((F.col("n") > part_edges) & (F.col("low") < F.col("top"))), "long-parts")
    if long.isEmpty():
        return None
    light = F.when(F.col("mid") < F.col("top"), F.col("m") <= F.col("mid")).otherwise(F.col("m") < F.col("top"))
    return cut(
        edges.join(F.broadcast(long.select("part", "mid", "top")), "part").withColumn("light", light)
        .select("part", "a", "b", "m", "light"),
        "halves",
    )


def exits(reps: DataFrame, tree: DataFrame, min_size: int, part_edges: int = PART_EDGES) -> tuple[DataFrame, DataFrame]:
    """Where every vertex leaves the hierarchy, and how clusters join.

    Returns ``id, m, name`` for all of ``reps(id, w, core)`` and the bounded table
    ``kind, id, m, name, parent`` of cluster joins and part tops.
    """
    own = F.when(F.col("w") >= min_size, F.concat(F.lit("copies/"), F.col("id").cast("string")))
    vertices = reps.select(
        F.lit(-1).cast("bigint").alias("part"), F.col("id").alias("a"), F.col("w").alias("size"), own.alias("cluster")
    )
    edges = tree.select(
        F.lit(-1).cast("bigint").alias("part"), F.col("lo").alias("a"), F.col("hi").alias("b"), "m"
    )
    member = reps.select("id", F.col("id").alias("v"))
    free_id = reps.agg(F.max("id")).first()[0] + 1
    while True:
        halves = _halve(vertices, edges, part_edges)
        if halves is None:
            break
        linked = components(halves.filter("light").select("a", "b"))
        grown = cut(vertices.join(linked.select(F.col("id").alias("a"), "root"), "a"), "grown")
        sizes = grown.groupBy("root").agg(
            F.sum("size").alias("size"), F.first("part").alias("part"), F.count(F.lit(1)).alias("n")
        )
        # A component is one new vertex of the heavy half; a big one is also a part of
        # its own, named by that vertex.
        numbered = with_position(sizes, ["root"], "_k").withColumn("into", F.col("_k") + free_id)
        roots = cut(numbered.withColumn("big", F.col("size") >= min_size), "roots")
        free_id += roots.count()
        where = cut(
            lookup(grown, roots.select("root", "n", "into", "big"), "root", "n").select(
                "a", "into", "big", "size", "cluster"
            ),
            "where",
        )
        outer = roots.select(
            "part", F.col("into").alias("a"), "size",
            F.when(F.col("big"), F.concat(F.lit("top/"), F.col("into").cast("string"))).alias("cluster"),
        )
        untouched = vertices.join(where.select("a"), "a", "left_anti").select("part", "a", "size", "cluster")
        inside = where.filter("big").select(F.col("into").alias("part"), "a", "size", "cluster")
        lower = halves.filter("light").join(where.filter("big").select("a", "into"), "a").select(
            F.col("into").alias("part"), "a", "b", "m"
        )
        upper = _relabel(halves.filter("not light").select("part", "a", "b", "m"), where)
        rest = edges.join(F.broadcast(halves.select("part").distinct()), "part", "left_anti").select("part", "a", "b", "m")
        small = where.filter("not big").select(F.col("a").alias("v"), "into")
        member = cut(
            member.join(small, "v", "left").select("id", F.coalesce("into", "v").alias("v")), "members"
        )
        vertices = cut(untouched.unionByName(inside).unionByName(outer), "vertices")
        edges = cut(lower.unionByName(upper).unionByName(rest), "edges")

    flat = _even_parts(edges, part_edges)
    even = _merge_even(vertices, flat)
    vertices = vertices.join(F.broadcast(flat.select("part")), "part", "left_anti").select("part", "a", "size", "cluster")
    edges = edges.join(F.broadcast(flat.select("part")), "part", "left_anti").select("part", "a", "b", "m")
    rows = edges.select("part", "a", "b", "m", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("cluster")).unionByName(
        vertices.select("part", "a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("m"), "size", "cluster")
    )
    merged = rows.groupBy("part").applyInPandas(_merge_part(min_size), _EXITS)
    found = cut(merged.unionByName(even), "exits")
    copies = reps.filter(F.col("w") >= min_size).select("id", F.col("core").alias("m"), own.alias("name"))
    left = found.filter("kind = 'exit'").select(F.col("id").alias("v"), "m", "name")
    counted = left.join(member.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v")
    placed = lookup(member, counted, "v", "n").filter(F.col("name").isNotNull()).select("id", "m", "name")
    return placed.unionByName(copies), found.filter("kind <> 'exit'")


def _even_parts(edges: DataFrame, part_edges: int) -> DataFrame:
    """Parts too long for one task whose edges all have one length."""
    shape = edges.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"))
    return cut(shape.filter(F.col("n") > part_edges), "even-parts")


def _merge_even(vertices: DataFrame, flat: DataFrame) -> DataFrame:
    """All vertices of such a part meet at once, which needs no order of edges."""
    inside = vertices.join(F.broadcast(flat.select("part", "m")), "part")
    own_name = F.concat(F.lit("even/"), F.col("part").cast("string"))
    tops = inside.groupBy("part").agg(
        F.count("cluster").alias("named"), F.first("cluster", ignorenulls=True).alias("one")
    ).select("part", "named", F.when(F.col("named") == 1, F.col("one")).otherwise(own_name).alias("top"))
    rows = inside.join(F.broadcast(tops), "part")
    none = F.lit(None).cast("string")
    left = rows.filter(F.col("cluster").isNull()).select(
        F.lit("exit").alias("kind"), F.col("a").alias("id"), "m", F.col("top").alias("name"), none.alias("parent")
    )
    joined = rows.filter(F.col("cluster").isNotNull() & (F.col("named") > 1)).select(
        F.lit("cluster").alias("kind"), F.lit(-1).cast("bigint").alias("id"), "m",
        F.col("cluster").alias("name"), F.col("top").alias("parent"),
    )
    named = tops.select(
        F.lit("top").alias("kind"), F.col("part").alias("id"), F.lit(0.0).alias("m"),
        F.col("top").alias("name"), none.alias("parent"),
    )
    return left.unionByName(joined).unionByName(named)


def _relabel(edges: DataFrame, where: DataFrame) -> DataFrame:
    """Both ends of heavy edges to the vertices of their components."""
    into = where.select(F.col("a").alias("v"), "into")
    for end in ("a", "b"):
        edges = edges.join(into.withColumnRenamed("v", end), end, "left").withColumn(
            end, F.coalesce("into", end)
        ).drop("into")
    return edges.select("part", "a", "b", "m")


def _lam(m: float) -> float:
    return 1.0 / m if m > 0 else math.inf


def choose(parents: dict[str, tuple[str, float]], sums: dict[str, tuple[float, int]]) -> dict[str, str]:
    """Chosen cluster for every cluster at or below one, by excess of mass.

    ``parents`` gives a cluster's parent and the length at which it joins; ``sums``
    the total of 1/m and the number of the rows that leave in it. The number of
    clusters is bounded by twice the rows over the smallest cluster size.
    """
    names = set(sums) | set(parents) | {p for p, _ in parents.values()}
    children: dict[str, list[str]] = {name: [] for name in names}
    for child, (parent, _) in parents.items():
        children[parent].append(child)
    roots = [name for name in names if name not in parents]
    order, todo = [], list(roots)
    while todo:
        name = todo.pop()
        order.append(name)
        todo.extend(children[name])
    size: dict[str, int] = {}
    mass: dict[str, float] = {}
    chosen: set[str] = set()
    for name in reversed(order):
        total, count = sums.get(name, (0.0, 0))
        born = _lam(parents[name][1]) if name in parents else 0.0
        own = total - count * born
        for child in children[name]:
            own += size[child] * (_lam(parents[child][1]) - born)
        size[name] = count + sum(size[child] for child in children[name])
        below = sum(mass[child] for child in children[name])
        if name in roots:
            continue
        if children[name] and below > own:
            mass[name] = below
        else:
            mass[name] = own
            chosen.add(name)
    answer: dict[str, str] = {}
    for name in order:
        above = answer.get(parents[name][0]) if name in parents else None
        if above is not None:
            answer[name] = above
        elif name in chosen:
            answer[name] = name
    return answer


def hdbscan(
    reps: DataFrame,
    min_cluster_size: int,
    min_samples: int,
    block_rows: int | None = None,
    part_edges: int = PART_EDGES,
) -> DataFrame:
    """``id, cluster_id, probability`` of distinct weighted vectors."""
    rows = reps.agg(F.sum("w")).first()[0]
    nothing = reps.select("id", F.lit(NOISE).alias("cluster_id"), F.lit(0.0).alias("probability"))
    if rows < min_cluster_size:
        return nothing
    ready = cut(reps.join(core_distances(reps, min_samples, block_rows), "id"), "cores")
    tree = spanning_tree(ready, block_rows, part_edges)
    placed, joins = exits(ready, tree, min_cluster_size, part_edges)
    placed = cut(placed.join(reps.select("id", "w"), "id"), "placed")

    links = joins.collect()
    tops = {f"top/{r.id}": r.name for r in links if r.kind == "top"}

    def real(name: str) -> str:
        while name in tops:
            name = tops[name]
        return name

    parents = {real(r.name): (real(r.parent), r.m) for r in links if r.kind == "cluster"}
    lam = F.when(F.col("m") > 0, 1.0 / F.col("m")).otherwise(F.lit(float("inf")))
    totals = placed.groupBy("name").agg(
        F.sum(lam * F.col("w")).alias("total"), F.sum("w").alias("n"), F.max(lam).alias("death")
    ).collect()
    sums: dict[str, tuple[float, int]] = {}
    death: dict[str, float] = {}
    for r in totals:
        name = real(r.name)
        total, count = sums.get(name, (0.0, 0))
        sums[name] = (total + r.total, count + r.n)
        death[name] = max(death.get(name, 0.0), r.death)
    for parent, m in parents.values():
        death[parent] = max(death.get(parent, 0.0), _lam(m))

    answer = choose(parents, sums)
    spelled = [(r.name, answer.get(real(r.name))) for r in totals]
    if not any(target for _, target in spelled):
        return nothing
    table = reps.sparkSession.createDataFrame(
        [(name, target, death.get(target, 0.0)) for name, target in spelled if target is not None],
        "name string, target string, death double",
    )
    named = cut(placed.join(F.broadcast(table), "name"), "named")
    numbers = rank_labels(named.select("id", F.col("target").alias("root")))
    share = F.when((F.col("death") == 0) | (lam == float("inf")), 1.0).otherwise(F.least(lam, "death") / F.col("death"))
    labeled = numbers.join(named.select("id", share.alias("probability")), "id")
    return reps.select("id").join(labeled, "id", "left").select(
        "id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability")
    )


def fit(reps: DataFrame, rows: int, alpha: float) -> Clustering:
    """Labels and probabilities with the sizes that follow from rows and ``alpha``."""
    size, samples = min_cluster_size_for(rows, alpha), min_samples_for(rows, alpha)
    found = cut(hdbscan(reps, size, samples), "hdbscan")
    facts = {"min_cluster_size": size, "min_samples": samples}
    return Clustering(found.select("id", "cluster_id"), facts, found.select("id", "probability"))
