"""Small blocks are met in runs by kernels that are told a bound, and the cells to meet are bounded without a sort."""

import numpy as np
import pytest

from labeltrail.operators import blocks, search


def test_small_blocks_are_met_in_runs(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(600, 24)))], "id long, vec array<double>")

    def kernel(q, b, seen=None):
        return {"id": q["id"], "calls": np.ones(len(q.vec), np.int64), "met": np.full(len(q.vec), len(b.vec)), "most": np.full(len(q.vec), len(q.vec))}

    def fold(found):
        ids, place = np.unique(found["id"], return_inverse=True)
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, place, found["most"])
        return {"id": ids, **{c: np.bincount(place, found[c]).astype(np.int64) for c in ("calls", "met")}, "most": most}

    cells = blocks.make_cells(df, 3, 16)
    assert len(cells.pivots) > 20
    rows = blocks.meet(df, cells, blocks.reach_all, kernel, "id bigint, calls bigint, met bigint, most bigint", fold, told=True).collect()
    met = np.bincount([r.id for r in rows], [r.met for r in rows])
    assert len(met) == 600 and set(met.tolist()) == {600.0}
    assert max(r.most for r in rows) == 16  # queries still come in blocks of that size
    assert all(r.calls <= 1 + np.log2(r.met / 16 + 1) for r in rows) and max(r.met for r in rows) > 100  # before: a call for each block of 16


def test_runs_hold_all_rows_and_are_bounded():
    import pyarrow as pa

    rows = pa.table({"id": np.arange(100_000)})
    for size in (1, 64, 2048, 1 << 16):
        runs = blocks._runs(rows, size)
        assert np.array_equal(np.concatenate([r["id"].to_numpy() for r in runs]), np.arange(100_000))
        assert runs[0].num_rows == size or size > 100_000
        assert max(r.num_rows for r in runs) * size <= max(blocks.RUN_PAIRS, size * size)
    assert blocks._runs(rows.slice(0, 0), 64) == []


@pytest.mark.parametrize("dim", [3, 40])
def test_search_in_small_blocks_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    vec = np.concatenate([rng.normal(size=(300, dim)), rng.normal(size=(200, dim)) * 0.01 + 5])  # near places that come late
    vec[320:340], vec[7] = vec[3], vec[400]  # more copies than hits
    vec[490:] *= 1e3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "idx long, embedding array<double>")
    d2 = ((vec[:, None] - vec[None]) ** 2).sum(-1)
    order = np.lexsort((np.broadcast_to(np.arange(500), d2.shape), d2), axis=1)
    for metric in ("flat", "cosine"):
        hits = search.search(rows.withColumnRenamed("idx", "qid"), rows, k=4, metric=metric, block_rows=8).collect()
        assert len(hits) == 2000
        if metric == "flat":
            assert all(order[h.qid, h["rank"] - 1] == h.idx and h.distance == pytest.approx(d2[h.qid, h.idx], rel=1e-9, abs=1e-12) for h in hits)
        else:
            unit = vec / np.linalg.norm(vec, axis=1)[:, None]
            best = np.sort(unit @ unit.T, axis=1)[:, ::-1]
            assert all(h.similarity == pytest.approx(best[h.qid, h["rank"] - 1], abs=1e-9) for h in hits)


@pytest.mark.parametrize("kept, k", [(3, 1), (3, 3), (3, 7), (1, 2), (8, 60)])
def test_cells_to_meet_hold_the_nearest(kept, k):
    rng = np.random.default_rng(k)
    vec = rng.normal(size=(50, 3))
    pivots = np.concatenate([vec[:9], [[50.0, 0.0, 0.0]]])  # the last cell is empty, others hold few
    far = blocks._to_pivots(vec, pivots)
    cell = far.argmin(axis=1)
    own = far[np.arange(50), cell]
    near, radius = np.full((10, kept), np.inf), np.zeros(10)
    for c in range(9):
        held = np.sort(own[cell == c])
        near[c, : min(kept, len(held))], radius[c] = held[:kept], held.max()
    cells = blocks.Cells(None, pivots, radius, np.bincount(cell, minlength=10), near, 8)
    mask = blocks.reach_nearest(k)(vec, far, cells, None)
    for i in range(50):
        ends = sorted(x for c in range(9) for x in far[i, c] + np.concatenate([near[c, np.isfinite(near[c])], np.full(max(0, cells.count[c] - kept), radius[c])]))
        bound = ends[min(k, 50) - 1]
        assert np.array_equal(mask[i], far[i] - radius <= bound + blocks._SLACK * (1.0 + far[i]))
        assert mask[i][cell[np.argsort(((vec - vec[i]) ** 2).sum(1))[:k]]].all()
