"""Mean shift with a flat kernel and binned seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.vectors import squared_distance
from labeltrail.operators.blocks import Block, make_cells, matrix, meet, reach_within, within
from labeltrail.operators.cluster.common import pair_distance_median, rank_labels, total_weight
from labeltrail.operators.position import with_position
from labeltrail.operators.search import collapse, nearest
from labeltrail.scratch import cut

MAX_ROUNDS = 300  # fixed value
MOVE_SHARE = 1e-3  # fixed value: a seed rests when it moves less than this share of the bandwidth
_SENT_SEEDS = 1024  # so many moving seeds at most are sent to the tasks, each of which adds up its rows by seed
_SENT_NUMBERS = 1 << 17  # most components of them
_PAIRS = 1 << 20  # distances held at a time


class NoMode(ValueError):
    """No row lies within the bandwidth of any seed."""


def bandwidth_of(middle: float | None, alpha: float) -> float | None:
    """Bandwidth that follows from the median positive distance; None if all rows are equal."""
    return None if middle is None else max(middle / alpha, middle * 0.1)


def bandwidth_for(
    points: DataFrame, reps: DataFrame, alpha: float, seed: int = 42, rows: int | None = None
) -> float | None:
    """Median positive distance over ``alpha``, of all rows or of a seeded sample of ``rows``; None if all are equal."""
    if rows is not None:
        reps = cut(collapse(points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)), "bandwidth-sample")
    return bandwidth_of(pair_distance_median(reps), alpha)


def _shift_kernel(bandwidth: float):
    def kernel(q: Block, b: Block):
        near = within(q.vec, b.vec, bandwidth)
        weight = near * b["w"][None, :].astype(float)
        count = weight.sum(axis=1)
        hit = count > 0
        sums = (weight @ b.vec)[hit]
        return {
            "id": q["id"][hit], "vec": list(q.vec[hit]), "n": count[hit].astype(np.int64), "total": list(sums)
        }

    return kernel


def _pulled(reps: DataFrame, ids: np.ndarray, seeds: np.ndarray, bandwidth: float) -> dict[int, tuple[int, np.ndarray]]:
    """Weight and vector sum of the rows in reach of each seed that has any, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, step = np.zeros(len(ids)), np.zeros(seeds.shape), max(16, _PAIRS // len(ids))
        for batch in batches:
            vec, w = matrix(batch.column("vec")), batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(vec), step):
                weight = within(seeds, vec[a : a + step], bandwidth) * w[None, a : a + step]
                n += weight.sum(axis=1)
                total += weight @ vec[a : a + step]
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[own]), pa.array(n[own].astype(np.int64)), pa.array(list(total[own]), pa.list_(pa.float64()))], names=["id", "n", "total"]
        )

    parts = reps.select("vec", "w").mapInArrow(run, "id long, n long, total array<double>")
    sums = parts.groupBy("id").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
    return {r.id: (r.n, np.array(r.total)) for r in sums.collect()}


def _rest_of_rounds(reps: DataFrame, moving: DataFrame, bandwidth: float, left: int) -> tuple[DataFrame | None, bool]:
    """Where each of the few ``moving`` seeds comes to rest, ``id, vec, n``, and whether all did within ``left`` further rounds."""
    rows = moving.orderBy("id").collect()  # at most _SENT_SEEDS
    if not rows:
        return None, True
    ids, seeds = np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows], float)
    done: list[tuple[int, list[float], int]] = []
    settled = True
    for round_number in range(left + 1):
        found = _pulled(reps, ids, seeds, bandwidth)
        met = np.array([k for k, i in enumerate(ids.tolist()) if i in found], np.int64)
        ids, seeds = ids[met], seeds[met]
        n = np.array([found[i][0] for i in ids.tolist()], np.int64)
        mean = np.array([found[i][1] / found[i][0] for i in ids.tolist()]).reshape(seeds.shape)
        rested = np.sqrt(((mean - seeds) ** 2).sum(axis=1)) <= MOVE_SHARE * bandwidth
        if round_number == left:
            settled, rested = bool(rested.all()), np.ones(len(ids), bool)
        done += [(int(ids[k]), mean[k].tolist(), int(n[k])) for k in np.flatnonzero(rested)]
        ids, seeds = ids[~rested], mean[~rested]
        if not len(ids):
            break
    return (reps.sparkSession.createDataFrame(done, "id bigint, vec array<double>, n bigint") if done else None), settled


def _means(parts: DataFrame) -> DataFrame:
    """Mean of the rows in reach of each seed, and how far the seed moves to it."""
    total = vector_to_array(Summarizer.sum(array_to_vector("total")))
    sums = parts.groupBy("id").agg(F.first("vec").alias("vec"), F.sum("n").alias("n"), total.alias("total"))
    moved = sums.select("id", "vec", "n", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    return moved.withColumn("step", F.sqrt(squared_distance("vec", "mean")))


def _dominated_kernel(bandwidth: float):
    """Query modes that have a stronger base mode within the bandwidth."""

    def kernel(q: Block, b: Block):
        near = within(q.vec, b.vec, bandwidth)
        stronger = q["rank"][:, None] > b["rank"][None, :]
        hit = (near & stronger).any(axis=1)
        return {"id": q["id"][hit]}

    return kernel


def _distinct_modes(modes: DataFrame, bandwidth: float) -> DataFrame:
    """Modes in order of strength, each dropping the weaker ones within the bandwidth.

    A round keeps every mode that no stronger open mode reaches and closes what
    those reach; the outcome is that of the one-by-one order.
    """
    # Strength is the number of rows in reach, then the coordinates.
    best = modes.groupBy("vec").agg(F.max("n").alias("n"))
    ranked = with_position(best, [F.desc("n"), F.desc("vec")], "rank")
    opened = cut(ranked.select(F.col("rank").alias("id"), "vec", "rank"), "modes")
    kept: DataFrame | None = None
    while not opened.isEmpty():
        beaten = meet(
            opened, make_cells(opened), reach_within(bandwidth), _dominated_kernel(bandwidth), "id bigint"
        ).distinct()
        winners = cut(opened.join(beaten, "id", "left_anti"), "modes")
        kept = winners if kept is None else kept.unionByName(winners)
        rest = opened.join(winners.select("id"), "id", "left_anti")
        if rest.isEmpty():
            break
        closed = meet(
            rest, make_cells(winners), reach_within(bandwidth), _dominated_kernel(bandwidth), "id bigint"
        ).distinct()
        opened = cut(rest.join(closed, "id", "left_anti"), "modes")
    return kept


def meanshift(
    reps: DataFrame, bandwidth: float, bin_seeding: bool = True, block_rows: int | None = None,
    facts: dict | None = None, rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Labels of distinct weighted vectors by the nearest mode.

    Once few seeds move, a round sends them to the tasks, which add up their rows by seed: one pass, and no row is moved.
    ``facts`` gets a note if seeds still moved after the last of the ``rounds``.
    """
    cells = make_cells(reps, block_rows=block_rows)
    seeds = reps.select("vec")
    if bin_seeding:
        # Half-way cases go to the even side, as array rounding does.
        bins = seeds.select(
            F.transform("vec", lambda x: F.rint(x / bandwidth) * bandwidth + 0.0).alias("vec")
        ).distinct()
        # As many bins as rows: the rows themselves are the seeds.
        if bins.count() < total_weight(reps):
            seeds = bins
    moving = cut(with_position(seeds, ["vec"], "id").select("id", "vec"), "seeds")
    dim = reps.select(F.size("vec")).first()[0]
    resting: DataFrame | None = None
    for round_number in range(rounds + 1):
        if moving.count() <= min(_SENT_SEEDS, _SENT_NUMBERS // max(1, dim)):
            done, settled = _rest_of_rounds(reps, moving, bandwidth, rounds - round_number)
            if not settled and facts is not None:
                facts["note"] = f"seeds still moved after {rounds} rounds"
            if done is not None:
                resting = done if resting is None else resting.unionByName(done)
            break
        parts = meet(
            moving, cells, reach_within(bandwidth), _shift_kernel(bandwidth),
            "id bigint, vec array<double>, n bigint, total array<double>",
        )
        moved = cut(_means(parts), "shift")
        rested = F.col("step") <= MOVE_SHARE * bandwidth
        if round_number == rounds and facts is not None and not moved.filter(~rested).isEmpty():
            facts["note"] = f"seeds still moved after {rounds} rounds"
        still = rested | F.lit(round_number == rounds)
        done = moved.filter(still).select("id", F.col("mean").alias("vec"), "n")
        resting = done if resting is None else resting.unionByName(done)
        moving = moved.filter(~still).select("id", F.col("mean").alias("vec"))
    modes = None if resting is None else _distinct_modes(cut(resting, "resting"), bandwidth)
    if modes is None:
        raise NoMode("no row within the bandwidth of any seed")
    hits = nearest(reps.select("id", "vec"), make_cells(modes.select("id", "vec")), 1)
    labels = hits.select(F.col("qid").alias("id"), F.col("bid").alias("root"))
    return rank_labels(labels)
