"""Density clustering with exact neighbour counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.blocks import Block, make_cells, meet, reach_within, within
from labeltrail.operators.cluster.common import (
    NOISE,
    median_neighbor_distance,
    rank_labels,
    total_weight,
)
from labeltrail.operators.cluster.components import components
from labeltrail.scratch import cut


def min_samples_for(n: int, alpha: float) -> int:
    return max(3, int(math.log(n) * alpha))


def _count_kernel(eps: float):
    def kernel(q: Block, b: Block):
        near = within(q.vec, b.vec, eps)
        counts = near.astype(np.float64) @ b["w"].astype(np.float64)
        return {"id": q["id"], "n": counts.astype(np.int64)}

    return kernel


def _reach_kernel(eps: float):
    """Links of core rows and of border rows to the core rows of a block.

    Every core row is linked to the smallest id it reaches inside the block pair, so at most one link per row
    leaves the kernel, however many pairs are near. A border row is linked to one row of each cluster of the
    block pair that it touches.
    """

    def kernel(q: Block, b: Block):
        near = within(q.vec, b.vec, eps)
        core = q["core"].astype(bool)
        between, qid, bid = near[core], q["id"][core], b["id"]
        q_root, b_root = qid.copy(), bid.copy()
        far = np.iinfo(np.int64).max
        while True:
            q_next = np.minimum(q_root, np.where(between, b_root[None, :], far).min(axis=1))
            b_next = np.minimum(b_root, np.where(between, q_next[:, None], far).min(axis=0, initial=far))
            if (q_next == q_root).all() and (b_next == b_root).all():
                break
            q_root, b_root = q_next, b_next
        a, root = np.concatenate([qid, bid]), np.concatenate([q_root, b_root])
        links = np.unique(np.stack([a, root], axis=1)[a != root], axis=0)
        row, col = np.nonzero(near[~core])
        touched = np.unique(np.stack([q["id"][~core][row], b_root[col]], axis=1), axis=0)
        return {
            "a": np.concatenate([links[:, 0], touched[:, 0]]), "b": np.concatenate([links[:, 1], touched[:, 1]]),
            "border": np.repeat([0, 1], [len(links), len(touched)]),
        }

    return kernel


def dbscan(reps: DataFrame, eps: float, min_samples: int, block_rows: int | None = None) -> DataFrame:
    """Labels of distinct weighted vectors, noise -1.

    A row is core with ``min_samples`` rows, itself and copies included, within
    ``eps``, bound included. Clusters are numbered by their first core row; a border
    row takes the lowest-numbered cluster in reach.
    """
    cells = make_cells(reps, block_rows=block_rows)
    counts = meet(reps, cells, reach_within(eps), _count_kernel(eps), "id bigint, n bigint")
    degree = counts.groupBy("id").agg(F.sum("n").alias("n"))
    marked = cut(reps.join(degree, "id").withColumn("core", F.col("n") >= min_samples), "cores")

    core = marked.filter("core").select("id", "vec")
    if core.isEmpty():
        return marked.select("id", F.lit(NOISE).alias("cluster_id"))
    # One meeting with the core rows gives the links of clusters and what border rows touch.
    pivots = cells.pivots if len(cells.pivots) > 1 else None
    asked = marked.select("id", "vec", F.col("core").cast("int").alias("core"))
    found = cut(
        meet(asked, make_cells(core, block_rows=block_rows, pivots=pivots), reach_within(eps), _reach_kernel(eps), "a bigint, b bigint, border bigint"),
        "links",
    )
    linked = components(found.filter("border = 0").select("a", "b"))
    alone = core.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("root"))
    members = cut(linked.unionByName(alone), "members")
    touched = (
        found.filter("border = 1").select(F.col("a").alias("row"), F.col("b").alias("id")).join(members, "id")
        .groupBy("row").agg(F.min("root").alias("root"))  # clusters are numbered by their root
    )
    labels = rank_labels(members, touched.select(F.col("row").alias("id"), "root"))
    noise = marked.filter("not core").select("id").join(touched.select(F.col("row").alias("id")), "id", "left_anti")
    return labels.unionByName(noise.select("id", F.lit(NOISE).alias("cluster_id")))


def parameters(reps: DataFrame, alpha: float, zero_eps: str = "raise") -> tuple[float, int]:
    """Radius and neighbour count that follow from the rows and ``alpha``."""
    eps = median_neighbor_distance(reps, zero_eps) / alpha
    return eps, min_samples_for(total_weight(reps), alpha)
