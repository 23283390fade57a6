"""Shared steps of the clustering methods.

Every method works on distinct vectors ``reps(id, vec, w)``, where ``id`` is the
smallest position among ``w`` equal vectors, and returns ``labels(id, cluster_id)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.quantile import bin_width, column_median, exact_median
from labeltrail.functions.vectors import as_double, norm
from labeltrail.operators.blocks import Block, block_size, distances, make_cells, meet_pairs, squares, with_place
from labeltrail.operators.heavy import lookup
from labeltrail.operators.position import with_position
from labeltrail.operators.search import collapse, nearest
from labeltrail.scratch import cut

NOISE = -1


@dataclass(frozen=True)
class Clustering:
    """``labels(idx, cluster_id)``, run facts, and per-row extras of the method."""

    labels: DataFrame
    info: dict = field(default_factory=dict)
    extras: DataFrame | None = None


def as_points(vectors: DataFrame) -> DataFrame:
    """``vectors(idx, embedding)`` as ``points(id, vec)``."""
    return vectors.select(F.col("idx").cast("bigint").alias("id"), as_double("embedding").alias("vec"))


def distinct_vectors(points: DataFrame) -> DataFrame:
    return cut(collapse(points), "reps")


def spread_labels(points: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels, or other columns of distinct vectors, back to every position."""
    told = [c for c in labels.columns if c != "id"]
    table = reps.join(labels, "id").select("vec", "w", *told)
    return lookup(points, table, "vec", "w").select(F.col("id").alias("idx"), *told)


def total_weight(reps: DataFrame) -> int:
    return reps.agg(F.sum("w")).first()[0] or 0


def rank_labels(members: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """``members(id, root)`` to labels 0, 1, ... by the smallest id of each group.

    ``further(id, root)`` get the label of their root and don't count for its number.
    """
    roots = members.groupBy("root").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    numbered = with_position(roots, ["_first"], "_label").select("root", "_rows", "_label")
    if further is not None:
        members = members.unionByName(further)
    return lookup(members, numbered, "root", "_rows").select("id", F.col("_label").cast("int").alias("cluster_id"))


def count_labels(labels: DataFrame) -> tuple[int, int]:
    """Clusters without noise, and noise rows."""
    row = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("cluster_id") != NOISE).alias("clusters"),
        F.sum(F.when(F.col("cluster_id") == NOISE, F.col("n")).otherwise(0)).alias("noise"),
    ).first()
    return row.clusters, row.noise or 0


def neighbor_distances(reps: DataFrame) -> DataFrame:
    """Distance ``d`` to the nearest other row for each distinct vector, weight ``w``."""
    copied = reps.filter("w > 1").select("id", F.lit(0.0).alias("d"), "w")
    single = reps.filter("w = 1")
    if single.isEmpty():
        return copied
    hits = nearest(single.select("id", "vec"), make_cells(reps.select("id", "vec"), 2), 2)
    others = hits.filter("qid <> bid").groupBy("qid").agg(F.sqrt(F.min("d2")).alias("d"))
    return copied.unionByName(others.select(F.col("qid").alias("id"), "d", F.lit(1).cast("bigint").alias("w")))


def median_neighbor_distance(reps: DataFrame, zero_eps: str = "raise") -> float:
    """Median distance to the nearest other row over all rows.

    It is 0 when more than half of the rows have a copy. Then this raises, or with
    ``zero_eps='positive_median'`` takes the median over the rows without one.
    """
    found = cut(neighbor_distances(reps), "neighbors")
    value = column_median(found, "d", "w")
    if value is None:
        raise ValueError("neighbour distances need at least two rows")
    if value == 0.0 and zero_eps == "positive_median":
        value = column_median(found.filter("d > 0"), "d", "w") or 0.0
    if value <= 0.0:
        raise ValueError("eps is 0: over half of the rows are copies; see zero_eps")
    return value


_MEDIAN_BLOCK = 512  # the distances of two blocks stay in the cache
_MEDIAN_BINS = 1 << 16
_MEDIAN_FETCH = 400_000
_GUESS_ROWS = 2_000
_NEAR_DIM = 8  # up to so many components, blocks of neighbours are far smaller than the whole
_NEAR_BLOCK = 128
_NONE, _NO_WEIGHT = np.zeros(0), np.zeros(0, np.int64)


def _guessed(reps: DataFrame) -> tuple[float, float] | None:
    """An interval in which the median of the distances is likely to be, from those of some rows; counts over all pairs tell if it is."""
    rows = reps.select("vec", "w").orderBy(F.xxhash64("vec"), "vec").limit(_GUESS_ROWS).collect()
    if len(rows) < _GUESS_ROWS:
        return None
    vec = np.array([r.vec for r in rows], dtype=float)
    w = np.array([r.w for r in rows], dtype=float)
    d = distances(vec, vec)[np.triu_indices(len(vec), 1)]
    weight = (w[:, None] * w[None, :])[np.triu_indices(len(vec), 1)]
    order = np.argsort(d)
    share = np.cumsum(weight[order]) / weight.sum()
    # How much the share of a row's distances below the median differs from row to row tells how far off the median may be.
    below = distances(vec, vec) < d[order[np.searchsorted(share, 0.5)]]
    spread = float(np.std(below @ w / w.sum())) * math.sqrt(float((w * w).mean()) / float(w.mean()) ** 2 / len(vec))
    room = min(0.05, 8.0 * spread + 2.0 / len(vec))
    lo, hi = d[order[np.searchsorted(share, (0.5 - room, 0.5 + room))]]
    return (float(lo), float(hi)) if 0 < lo < hi else None


def pair_distance_median(reps: DataFrame) -> float | None:
    """Median of the positive pairwise distances over all rows, exact.

    Block pairs are reduced to histograms until the interval around the median is
    small enough to read. Every pair is met once in a pass, and the first interval comes from
    some rows, so two passes are enough for most tables.
    """
    top = 2.0 * (1.0 + 1e-9) * (reps.agg(F.max(norm("vec"))).first()[0] or 0.0)
    some = reps.select("id", "vec", "w")
    dim = reps.agg(F.max(F.size("vec"))).first()[0] or 1
    place, rows = (None, _MEDIAN_BLOCK) if dim > _NEAR_DIM else ("_place", min(_MEDIAN_BLOCK, _NEAR_BLOCK))
    if place is not None:
        some = cut(with_place(some, place), "places")

    def run(kernel, schema: str) -> DataFrame:
        return meet_pairs(some, kernel, schema, block_size(dim, rows), place)

    def reduced(a: Block, b: Block, same: bool, lo: float, hi: float) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Weights of the pairs below and above the interval, and distances and weights of those inside; distances of zero are left out."""
        if not same:
            (one, far), (other, wide) = a.ball, b.ball
            gap, reach = math.sqrt(float(((one - other) ** 2).sum())), far + wide + 1e-9 * top
            if 0 < gap - reach and (gap + reach < lo or gap - reach > hi):  # no distance of zero, and all on one side
                weight = int(a["w"].sum()) * int(b["w"].sum())
                return (weight, 0, _NONE, _NO_WEIGHT) if gap + reach < lo else (0, weight, _NONE, _NO_WEIGHT)
        d2 = squares(a.vec, b.vec)[0]
        single = bool((a["w"] == 1).all() and (b["w"] == 1).all())
        weight = None if single else a["w"][:, None] * b["w"][None, :]
        if same:
            upper = np.triu_indices(len(d2), 1)
            d2, weight = d2[upper], None if single else weight[upper]
        else:
            d2, weight = d2.ravel(), None if single else weight.ravel()

        def sum_of(mask: np.ndarray) -> int:
            return int(np.count_nonzero(mask)) if single else int(weight[mask].sum())

        # Roots are drawn only where the squares leave it open on which side of an end a distance is.
        near_lo, near_hi = lo * lo * (1.0 - 1e-14), hi * hi * (1.0 + 1e-14)
        at = np.flatnonzero((d2 >= near_lo) & (d2 <= near_hi))
        d, told = np.sqrt(np.maximum(d2[at], 0.0)), np.ones(len(at), np.int64) if single else weight[at]
        inside = (d >= lo) & (d <= hi) & (d > 0)
        below = sum_of(d2 < near_lo) + int(told[d < lo].sum()) - sum_of(d2 <= 0) if lo > 0 else 0
        above = sum_of(d2 > near_hi) + int(told[d > hi].sum())
        return below, above, d[inside], told[inside]

    def histogram(lo: float, hi: float, bins: int) -> dict[int, tuple[int, float, float]]:
        width = bin_width(lo, hi, bins) or np.inf

        def kernel(met: Iterator[tuple[Block, Block, bool]]) -> dict[str, np.ndarray]:
            sums = np.zeros(bins + 2, np.int64)  # the last two are above and below
            low, high = np.full(bins + 2, np.inf), np.full(bins + 2, -np.inf)
            for a, b, same in met:
                below, above, d, weight = reduced(a, b, same, lo, hi)
                sums[bins] += above
                sums[bins + 1] += below
                if len(d):
                    place = np.minimum(np.floor((d - lo) / width), bins - 1).astype(np.int64)
                    np.add.at(sums, place, weight)
                    np.minimum.at(low, place, d)
                    np.maximum.at(high, place, d)
            own = np.flatnonzero(sums)
            return {"b": np.where(own > bins, -1, own), "n": sums[own], "low": low[own], "high": high[own]}

        found = run(kernel, "b bigint, n bigint, low double, high double").groupBy("b").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        return {r.b: (r.n, r.low, r.high) for r in found.collect()}

    def values(lo: float, hi: float) -> tuple[int, list[tuple[float, int]]]:
        def kernel(met: Iterator[tuple[Block, Block, bool]]) -> dict[str, np.ndarray]:
            seen, counts, under = [], [], 0
            for a, b, same in met:
                below, _, d, weight = reduced(a, b, same, lo, hi)
                seen.append(d)
                counts.append(weight)
                under += below
            # One row with value -1 holds the count below.
            return {"v": np.concatenate([*seen, [-1.0]]), "n": np.concatenate([*counts, [under]]).astype(np.int64)}

        rows = run(kernel, "v double, n bigint").groupBy("v").agg(F.sum("n").alias("n")).collect()
        below = sum(r.n for r in rows if r.v < 0)
        return below, sorted((r.v, r.n) for r in rows if r.v >= 0)

    return exact_median(histogram, values, 0.0, top, 1e-12 * top, _guessed(reps), _MEDIAN_BINS, _MEDIAN_FETCH)
