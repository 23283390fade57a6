"""Exact and approximate top-k search of one vector table in another."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.functions.vectors import as_double, l2_normalize, norm
from labeltrail.operators.blocks import (
    Block,
    Cells,
    exact_squares,
    make_cells,
    meet,
    reach_all,
    reach_nearest,
    reach_probes,
    rough_squares,
    squares,
    where,
)
from labeltrail.operators.cluster.kmeans import trained
from labeltrail.operators.heavy import lookup
from labeltrail.scratch import cut

METRICS = ("cosine", "flat", "ivf")
IVF_LISTS = 100  # fixed value: number of inverted lists
IVF_ROUNDS = 300  # most rounds of the k-means behind them


def collapse(points: DataFrame) -> DataFrame:
    """Equal vectors once: smallest ``id``, ``vec``, and number of copies ``w``."""
    return points.groupBy("vec").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("w")
    ).select("id", "vec", "w")


def _bound(qid: np.ndarray, seen: dict[str, np.ndarray] | None, k: int) -> np.ndarray:
    """Squared distance of the ``k``-th of the hits that ``nearest_fold`` left for each query, infinite if there are fewer."""
    if seen is None:
        return np.full(len(qid), np.inf)
    first, end = np.searchsorted(seen["qid"], qid), np.searchsorted(seen["qid"], qid, side="right")
    return np.where(end - first >= k, seen["d2"][np.minimum(first + k, len(seen["d2"])) - 1], np.inf)


_CANDIDATES = 64  # more of them for a row and hit wanted, and rounding decides too little


def nearest_kernel(k: int, carry: str | None = None):
    """Kernel: base rows of a block pair that may be among the ``k`` nearest of each query, the ``k`` nearest here among them.

    What the blocks before gave bounds the search, so most pairs of a later block are only compared with a number.
    ``carry`` names a base column to hand on with each hit.
    """

    def close(q: Block, b: Block, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, na, room = rough_squares(q, b)
        limit = bound - na + 2 * room
        open_ = np.flatnonzero(~np.isfinite(bound))
        if len(open_):
            width = min(k, out.shape[1])
            limit[open_] = np.partition(out if len(open_) == len(out) else out[open_], width - 1, axis=1)[:, width - 1] + 2 * room
        if out.dtype == np.float32:  # rounded up
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        rows, cols = where(out <= limit[:, None])
        if out.dtype == np.float32 and len(rows) > _CANDIDATES * k * len(q.vec):
            out, room = squares(q.vec, b.vec)
            width = min(k, out.shape[1])
            kth = np.minimum(bound, np.partition(out, width - 1, axis=1)[:, width - 1])
            rows, cols = where(out <= kth[:, None] + 2 * room)
        return rows, cols

    def kernel(q: Block, b: Block, seen: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        bound = _bound(q["id"], seen, k)
        rows, cols = close(q, b, bound)
        exact = exact_squares(q.vec, b.vec, rows, cols)
        if seen is not None:
            near = exact <= bound[rows]
            rows, cols, exact = rows[near], cols[near], exact[near]
        ids = b["id"][cols]
        order = np.lexsort((ids, exact, rows))
        rows, cols, ids, exact = rows[order], cols[order], ids[order], exact[order]
        start = np.searchsorted(rows, np.arange(len(q.vec)))
        keep = np.arange(len(rows)) - start[rows] < k
        hits = {"qid": q["id"][rows[keep]], "bid": ids[keep], "d2": exact[keep]}
        if carry is not None:
            hits[carry] = b[carry][cols[keep]]
        return hits

    return kernel


def nearest_fold(k: int):
    """The ``k`` best of what a block of queries found in several blocks."""

    def fold(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((found["bid"], found["d2"], found["qid"]))
        qid = found["qid"][order]
        start = np.searchsorted(qid, qid)
        keep = order[np.arange(len(qid)) - start < k]
        return {c: v[keep] for c, v in found.items()}

    return fold


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits per query; ties go to the smaller base id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "bid"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, cells: Cells, k: int, carry: str | None = None) -> DataFrame:
    """``qid, bid, d2, rank`` of the ``k`` nearest base vectors of ``queries(id, vec)``."""
    schema = "qid bigint, bid bigint, d2 double" + (f", {carry} bigint" if carry else "")
    return best_hits(meet(queries, cells, reach_nearest(k), nearest_kernel(k, carry), schema, nearest_fold(k), told=True), k)


def _search_vector(vec: str | Column, metric: str, is_base: bool) -> Column:
    """Vector whose Euclidean order is the metric's order.

    Cosine search ranks unit vectors by inner product. One more coordinate, 1 for a
    zero base vector and 0 otherwise, makes that order Euclidean for all rows.
    """
    if metric != "cosine":
        return as_double(vec)
    unit = l2_normalize(vec)
    extra = F.when(norm(as_double(vec)) > 0, 0.0).otherwise(1.0) if is_base else F.lit(0.0)
    return F.concat(unit, F.array(extra))


def ivf_centers(points: DataFrame, seed: int = 42, rounds: int = IVF_ROUNDS, lists: int | None = IVF_LISTS) -> np.ndarray:
    """Centres of up to ``lists`` inverted lists by k-means; None takes as many as the root of the rows.

    A warning tells if they still moved after ``rounds``.
    """
    rows = points.count()
    k = min(lists or math.ceil(math.sqrt(rows)), rows)
    centers, _, settled = trained(points.select("id", "vec", F.lit(1).cast("long").alias("w")), k, seed, 1, rounds)
    if not settled:
        warnings.warn(f"centres of the inverted lists still moved after {rounds} rounds", stacklevel=2)
    return centers


def search(
    queries: DataFrame,
    base: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    where: dict[str, str] | None = None,
    mode: str = "pre",
    nprobe: int = 1,
    seed: int = 42,
    block_rows: int | None = None,
    centers: np.ndarray | None = None,
    lists: int | None = IVF_LISTS,
) -> DataFrame:
    """Top-k of ``base(idx, embedding[, metadata])`` for each of ``queries(qid, embedding)``.

    Returns ``qid, rank, idx`` with ``similarity`` and ``distance`` for cosine
    (1 - similarity), or squared ``distance`` and ``l2`` otherwise. ``where`` tests
    metadata entries for equality: ``pre`` before the search, ``post`` among the 3k
    nearest, which may leave fewer than k. ``centers`` sets the inverted lists of ``ivf``,
    ``lists`` the number that is trained, None for the root of the rows. An empty base raises.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    if mode not in ("pre", "post"):
        raise ValueError(f"unknown mode {mode!r}")
    if where and mode == "pre":
        base = base.filter(_matches(where))
    wanted = 3 * k if where and mode == "post" else k

    points = base.select(
        F.col("idx").cast("bigint").alias("id"), _search_vector("embedding", metric, True).alias("vec")
    )
    points = cut(_first_copies(points, wanted), "base")
    asked = queries.select(
        F.col("qid").cast("bigint").alias("id"), _search_vector("embedding", metric, False).alias("vec")
    )
    distinct = cut(collapse(asked), "queries")

    if metric == "ivf":
        cells = make_cells(points, block_rows=block_rows, pivots=ivf_centers(points, seed, lists=lists) if centers is None else centers)
        hits = meet(
            distinct, cells, reach_probes(nprobe) if nprobe < len(cells.pivots) else reach_all,
            nearest_kernel(wanted), "qid bigint, bid bigint, d2 double", nearest_fold(wanted), widen=False, told=True,
        )
        best = best_hits(hits, wanted)
    else:
        best = nearest(distinct, make_cells(points, wanted, block_rows), wanted)

    if where and mode == "post":
        best = _filter_hits(best, base, where, k)
    lists = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "bid", "d2"))).alias("hits")
    )
    table = distinct.join(lists, distinct["id"] == lists["qid"]).select("vec", "w", "hits")
    flat = (
        lookup(cut(asked, "asked"), table, "vec", "w")
        .select(F.col("id").alias("qid"), F.explode("hits").alias("hit"), norm("vec").alias("_size"))
        .select("qid", "hit.rank", F.col("hit.bid").alias("idx"), F.col("hit.d2").alias("d2"), "_size")
    )
    if metric == "cosine":
        # |q - b|^2 = |q|^2 + 1 - 2 q.b, as every base vector has length one here.
        similarity = (F.col("_size") * F.col("_size") + 1.0 - F.col("d2")) / 2.0
        return flat.select(
            "qid", "rank", "idx", similarity.alias("similarity"), (1.0 - similarity).alias("distance")
        )
    return flat.select("qid", "rank", "idx", F.col("d2").alias("distance"), F.sqrt("d2").alias("l2"))


def _first_copies(points: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of equal vectors: no others can be among the ``k`` best."""
    if k == 1:
        return collapse(points).select("id", "vec")
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return points.withColumn("_copy", copy).filter(F.col("_copy") <= k).drop("_copy")


def _matches(where: dict[str, str]) -> Column:
    test = F.lit(True)
    for key, value in where.items():
        test = test & F.coalesce(F.try_element_at("metadata", F.lit(key)) == value, F.lit(False))
    return test


def _filter_hits(best: DataFrame, base: DataFrame, where: dict[str, str], k: int) -> DataFrame:
    passing = base.filter(_matches(where)).select(F.col("idx").cast("bigint").alias("bid"))
    kept = best.join(passing, "bid", "left_semi")
    return best_hits(kept.drop("rank"), k)


def top1(queries: DataFrame, base: DataFrame, **options) -> DataFrame:
    """Nearest base row of every query."""
    return search(queries, base, k=1, **options).drop("rank")
