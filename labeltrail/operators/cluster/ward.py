"""Ward clustering: all mutual nearest neighbours merge at once, round by round.

Ward's distance is reducible: merging two mutual neighbours never brings a third
cluster nearer to either. So the parallel merges give the partition of the
one-by-one order, and a cluster with no partner below the threshold is finished.
For the same reason a cluster keeps its nearest neighbour until that one merges, so a
round searches only for new clusters and those whose neighbour is gone, first in the own
cell and then in those cells that may hold a nearer one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.blocks import (
    Block,
    exact_squares,
    make_cells,
    meet,
    reach_all,
    reach_bound,
    reach_probes,
    squares,
)
from labeltrail.operators.cluster.common import rank_labels
from labeltrail.operators.cluster.components import components
from labeltrail.scratch import Rounds, cut


def _partner_kernel(threshold: float):
    limit = threshold * threshold

    def factor(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 2.0 * n * m / (n + m)

    def kernel(q: Block, b: Block):
        plain, room = squares(q.vec, b.vec)
        scaled = factor(q["w"][:, None].astype(float), b["w"][None, :].astype(float))
        out = plain * scaled
        out[q["id"][:, None] == b["id"][None, :]] = np.inf
        best = out.min(axis=1)
        rows, cols = np.nonzero(
            (out <= (best[:, None] + 4 * room * scaled)) & (out <= limit + 2 * room * scaled)
        )
        if len(rows) == 0:
            return None
        exact = exact_squares(q.vec, b.vec, rows, cols) * factor(
            q["w"][rows].astype(float), b["w"][cols].astype(float)
        )
        mine, theirs = q["id"][rows], b["id"][cols]
        # Both ends of a pair order their candidates alike, so equal distances
        # cannot keep two partners from choosing each other.
        order = np.lexsort((np.maximum(mine, theirs), np.minimum(mine, theirs), exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        keep = first[np.sqrt(exact[first]) < threshold]
        return {"id": mine[keep], "partner": theirs[keep], "d2": exact[keep]}

    return kernel


def _partners(asked: DataFrame, active: DataFrame, threshold: float, block_rows: int | None) -> DataFrame:
    """Candidates for the nearest partner of each of ``asked`` below the threshold, the nearest among them.

    The partner in the own cell bounds the search in the others: Ward's factor 2 n m / (n + m) grows with
    m, so a nearer one is no farther in plain distance than the bound over the factor at the smallest m.
    """
    cells, kernel, schema = make_cells(active, block_rows=block_rows), _partner_kernel(threshold), "id bigint, partner bigint, d2 double"
    if len(cells.pivots) == 1:
        return meet(asked, cells, reach_all, kernel, schema)
    near = meet(asked, cells, reach_probes(1), kernel, schema, widen=False).groupBy("id").agg(F.min("d2").alias("d2"))
    least = float(active.agg(F.min("w")).first()[0])
    factor = 2.0 * F.col("w") * least / (F.col("w") + least)
    bound = F.sqrt(F.coalesce("d2", F.lit(threshold * threshold)) / factor).alias("bound")
    bounded = cut(asked.join(near, "id", "left").select("id", "vec", "w", bound), "bounded")
    return meet(bounded, cells, reach_bound("bound"), kernel, schema)


def ward(reps: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """Labels of distinct weighted vectors; merges stop at ``threshold``, excluded."""
    active = reps.select("id", "vec", "w")
    stale, known = active, None
    links: DataFrame | None = None
    rounds = Rounds(reps.sparkSession)
    while True:
        found = _partners(stale, active, threshold, block_rows)
        lo, hi = F.least("id", "partner"), F.greatest("id", "partner")
        fresh = found.groupBy("id").agg(F.min(F.struct("d2", lo.alias("lo"), hi.alias("hi"))).alias("c")).select("id", "c.lo", "c.hi")
        choice = rounds.cut(fresh if known is None else fresh.unionByName(known), "partners")
        mutual = choice.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        pairs = rounds.cut(mutual.select("lo", "hi"), "pairs")
        if pairs.isEmpty():
            if known is None:
                break
            stale, known = active, None  # equal distances may leave choices that no partner returns
            continue
        kept = cut(pairs, "merges")
        links = kept if links is None else links.unionByName(kept)
        # Rows without a partner are finished and leave the search.
        living = active.join(choice.select("id"), "id", "left_semi")
        merged = living.join(pairs.select(F.col("hi").alias("id"), "lo"), "id", "left").withColumn(
            "into", F.coalesce("lo", "id")
        )
        halves = merged.groupBy("into").agg(
            F.sum("w").alias("w"), F.collect_list(F.struct("id", "w", "vec")).alias("parts")
        )
        total = F.aggregate(
            F.array_sort("parts"),
            F.transform(F.get("parts", F.lit(0))["vec"], lambda _: F.lit(0.0)),
            lambda acc, p: F.zip_with(acc, p["vec"], lambda x, y: x + y * p["w"]),
        )
        active = rounds.cut(
            halves.select(
                F.col("into").alias("id"), F.transform(total, lambda x: x / F.col("w")).alias("vec"), "w"
            ),
            "active",
        )
        gone = pairs.select(F.explode(F.array("lo", "hi")).alias("partner"))
        partner = (F.col("lo") + F.col("hi") - F.col("id")).alias("partner")
        known = rounds.cut(
            choice.select("id", "lo", "hi", partner).join(gone, "partner", "left_anti")
            .join(gone.withColumnRenamed("partner", "id"), "id", "left_anti").select("id", "lo", "hi"),
            "known",
        )
        stale = rounds.cut(active.join(known.select("id"), "id", "left_anti").select("id", "vec", "w"), "stale")
        rounds.end()
    if links is None:
        return rank_labels(reps.select("id", F.col("id").alias("root")))
    linked = components(links.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    alone = reps.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("root"))
    return rank_labels(linked.unionByName(alone))
