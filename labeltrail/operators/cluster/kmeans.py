"""K-means with several starts, all of them in one pass over the rows per round.

Starts are chosen by k-means|| (Bahmani et al., VLDB 2012), with hashes for random numbers, so that a task that is
repeated draws the same. A round sends the centres of all starts that still move to the tasks, each of which adds
up its rows by centre; starts that have settled leave the pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltrail.operators.blocks import matrix
from labeltrail.scratch import cut

STARTS = 10  # fixed value: number of starts, best cost kept
ROUNDS = 300  # fixed value: most rounds of one start
_DRAWS = 5  # rounds of k-means||
_ROWS = 4_096
_CACHED = 1 << 17  # numbers held at a time when centres are compared


def clusters_for(n: int, alpha: float) -> int:
    return max(2, int(int(math.sqrt(n)) * alpha))


def _nearest(vec: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, the first of equal ones, and its squared distance."""
    # The square of the row is left out, as it is the same for all centres; parts stay in the cache.
    squares, turned = (centers * centers).sum(1), (-2.0 * centers).T
    best = np.empty(len(vec), np.int64)
    step = max(16, _CACHED // max(1, len(centers)))
    for a in range(0, len(vec), step):
        out = vec[a : a + step] @ turned
        out += squares
        best[a : a + step] = out.argmin(axis=1)
    gap = vec - centers[best]
    return best, (gap * gap).sum(axis=1)


_PACKED = "ids binary, vecs binary, ws binary"


def packed(reps: DataFrame) -> DataFrame:
    """The rows in parts of up to ``_ROWS``, each the bytes of its ids, vectors and weights: a pass over them needs no conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vec, w in _parts(batches):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"ids": [ids.astype(np.int64).tobytes()], "vecs": [vec.tobytes()], "ws": [w.tobytes()]})

    return reps.select("id", "vec", "w").mapInArrow(run, _PACKED)


def _columns(reps: DataFrame) -> DataFrame:
    return reps if "vecs" in reps.columns else reps.select("id", "vec", "w")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and weights, of plain or of packed rows."""
    for batch in batches:
        if "vecs" in batch.schema.names:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield ids, np.frombuffer(row["vecs"], float).reshape(len(ids), -1), np.frombuffer(row["ws"], float)
            continue
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            ids, w = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "w"))
            yield ids, matrix(part.column("vec")), w.astype(float)


def _uniform(ids: np.ndarray, *salts: int) -> np.ndarray:
    """A number above 0 and up to 1 for each id."""
    x = ids.astype(np.uint64)
    for salt in salts:
        x = (x + np.uint64(salt % (1 << 63)) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 1.0) / float(1 << 53)


def _seeds(reps: DataFrame, k: int, seed: int, starts: int, parts: DataFrame) -> list[np.ndarray]:
    """For each start, ``k`` centres at most: candidates drawn in a few passes over the packed ``parts``, and k-means++ among them."""
    firsts = [reps.orderBy(F.xxhash64("id", F.lit(seed), F.lit(s)), "id").select("vec").first() for s in range(starts)]
    reps = parts
    drawn = [np.array([f.vec]) for f in firsts]

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(drawn))
        for _, vec, w in _parts(batches):
            total += [(_nearest(vec, c)[1] * w).sum() for c in drawn]
        yield pa.RecordBatch.from_pydict({"start": np.arange(len(drawn)), "cost": total})

    def draw(costs: list[float], turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, vec, w in _parts(batches):
                for s, c in enumerate(drawn):
                    share = 2.0 * k * _nearest(vec, c)[1] * w / costs[s] if costs[s] > 0 else np.zeros(len(ids))
                    own = np.flatnonzero(_uniform(ids, seed, s, turn) < share)
                    yield pa.RecordBatch.from_pydict({"start": np.full(len(own), s), "id": ids[own], "vec": list(vec[own])}, schema=_DRAWN)

        return run

    for turn in range(_DRAWS):
        sums = {r.start: r.cost for r in reps.mapInArrow(cost, "start long, cost double").groupBy("start").agg(F.sum("cost").alias("cost")).collect()}
        found = reps.mapInArrow(draw([sums.get(s, 0.0) for s in range(starts)], turn), "start long, id long, vec array<double>").orderBy("start", "id").collect()
        for s in range(starts):
            own = [r.vec for r in found if r.start == s]
            if own:
                drawn[s] = np.concatenate([drawn[s], np.array(own)])
    drawn = [np.unique(c, axis=0) for c in drawn]
    weight = [np.zeros(len(c)) for c in drawn]
    for (s, c), (w, _, _) in _gathered(reps, drawn).items():
        weight[s][c] = w
    rng = np.random.default_rng(seed)
    return [_plus_plus(c, w, k, rng) for c, w in zip(drawn, weight)]


_DRAWN = pa.schema([("start", pa.int64()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the candidates, each drawn by its weight and squared distance to those before."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = weight * far
        if mass.sum() <= 0:
            mass = np.isin(np.arange(len(points)), chosen, invert=True).astype(float)
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return _refined(points, weight, points[chosen])


def _refined(points: np.ndarray, weight: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Some rounds of k-means among the candidates."""
    for _ in range(30):
        best = np.concatenate([_nearest(points[a : a + _ROWS], centers)[0] for a in range(0, len(points), _ROWS)])
        held = np.bincount(best, weight, len(centers))
        total = np.zeros(centers.shape)
        np.add.at(total, best, points * weight[:, None])
        moved = np.where(held[:, None] > 0, total / np.maximum(held, 1e-300)[:, None], centers)
        if np.allclose(moved, centers, rtol=0, atol=1e-12):
            break
        centers = moved
    return centers


def _gathered(reps: DataFrame, centers: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, np.ndarray, float]]:
    """Weight, vector sum and cost of the rows of each (start, centre), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, cost = [np.zeros(len(c)) for c in centers], [np.zeros(len(c)) for c in centers]
        total = [np.zeros(c.shape) for c in centers]
        for _, vec, w in _parts(batches):
            for s, c in enumerate(centers):
                best, d2 = _nearest(vec, c)
                order = np.argsort(best, kind="stable")
                own, first = np.unique(best[order], return_index=True)
                weight[s] += np.bincount(best, w, len(c))
                cost[s] += np.bincount(best, w * d2, len(c))
                total[s][own] += np.add.reduceat((vec * w[:, None])[order], first)
        for s in range(len(centers)):
            own = np.flatnonzero(weight[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), s)), pa.array(own), pa.array(weight[s][own]), pa.array(cost[s][own]), pa.array(list(total[s][own]), pa.list_(pa.float64()))],
                names=["start", "center", "w", "cost", "total"],
            )

    parts = _columns(reps).mapInArrow(run, "start long, center long, w double, cost double, total array<double>")
    sums = parts.groupBy("start", "center").agg(
        F.sum("w").alias("w"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    )
    return {(r.start, r.center): (r.w, np.array(r.total), r.cost) for r in sums.collect()}


def lloyd(reps: DataFrame, centers: list[np.ndarray], rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[float], list[bool]]:
    """Centres, cost and whether they settled, of each start. A centre without rows stays where it is."""
    centers = [c.copy() for c in centers]
    costs, settled = [math.inf] * len(centers), [False] * len(centers)
    for _ in range(rounds + 1):
        moving = [s for s in range(len(centers)) if not settled[s]]
        if not moving:
            break
        sums = _gathered(reps, [centers[s] for s in moving])
        for place, s in enumerate(moving):
            moved = centers[s].copy()
            for c in range(len(moved)):
                if (place, c) in sums:
                    w, total, _ = sums[place, c]
                    moved[c] = total / w
            costs[s] = sum(sums[place, c][2] for c in range(len(moved)) if (place, c) in sums)
            settled[s] = bool(np.allclose(moved, centers[s], rtol=0, atol=1e-12 * (1.0 + np.abs(moved).max())))
            centers[s] = moved
    return centers, costs, settled


def assign(reps: DataFrame, centers: np.ndarray) -> DataFrame:
    """``id, cluster_id`` of the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vec, _ in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_nearest(vec, centers)[0].astype(np.int32))], names=["id", "cluster_id"])

    fields = [T.StructField("id", reps.schema["id"].dataType), T.StructField("cluster_id", T.IntegerType())]
    return reps.select("id", "vec", "w").mapInArrow(run, T.StructType(fields))


def trained(reps: DataFrame, k: int, seed: int = 42, starts: int = STARTS, rounds: int = ROUNDS) -> tuple[np.ndarray, float, bool]:
    """Centres of the best start, its cost, and whether it settled within ``rounds``."""
    parts = cut(packed(reps), "packed")
    centers, costs, settled = lloyd(parts, _seeds(reps, k, seed, starts, parts), rounds)
    best = int(np.argmin(costs))
    return centers[best], costs[best], settled[best]


def kmeans(reps: DataFrame, k: int, seed: int = 42, starts: int = STARTS, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """Labels of distinct weighted vectors, with inertia and centers of the best start.

    ``note`` tells if the best start still moved in the last of its ``rounds``.
    """
    centers, cost, settled = trained(reps, k, seed, starts, rounds)
    facts = {"inertia": cost, "centers": [center.tolist() for center in centers]}
    if not settled:
        facts["note"] = f"stopped after {rounds} rounds"
    return assign(reps, centers), facts
