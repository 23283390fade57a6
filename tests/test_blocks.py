"""Grids of strips: copies per vector, and results that don't depend on the cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltrail.operators import blocks
from labeltrail.operators.search import nearest


def _copies(n, tasks):
    """Most copies of a query and of a vector, and groups, where one cell holds all."""
    grid = blocks.make_grid(np.array([n]), np.array([n]), 2048, tasks)
    return grid.held[0], grid.asking[0], grid.groups


def test_copies_grow_with_the_root_of_the_tasks():
    for n in (200_000, 800_000, 3_200_000):  # 1, 4 and 16 times the data
        for tasks in (64, 256, 1024):
            held, asking, groups = _copies(n, tasks)
            by_memory = math.ceil(n / (blocks.STRIP_BLOCKS * 2048))  # a strip is bounded
            bound = max(by_memory, 2 * math.sqrt(blocks.GROUPS_PER_TASK * tasks)) + 1
            assert max(held, asking) <= bound and groups <= 2 * max(by_memory**2, blocks.GROUPS_PER_TASK * tasks)
    small, large = _copies(800_000, 64), _copies(800_000, 1024)
    assert large[0] <= 4.5 * small[0]  # 16 times the tasks


def test_grid_of_uneven_sides_and_empty_cells():
    asked, count = np.array([0, 1, 5_000_000, 10]), np.array([10, 4_000_000, 7, 0])
    grid = blocks.make_grid(asked, count, 2048, 16)
    assert (grid.asking >= 1).all() and (grid.held >= 1).all()
    assert grid.asking[1] == 1 and grid.held[2] == 1 and grid.held[1] > 1 and grid.asking[2] > 1
    assert (np.diff(grid.first) == (grid.asking * grid.held)[:-1]).all()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    vec = np.concatenate([rng.normal(size=(150, 4)), rng.normal(size=(250, 4)) * 0.01 + 3])
    return vec, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "id long, vec array<double>")


@pytest.mark.parametrize("pairs, block_rows", [(1 << 22, None), (500, 16), (2_000, 40), (1, 7)])
def test_nearest_on_any_grid(spark, monkeypatch, points, pairs, block_rows):
    monkeypatch.setattr(blocks, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(blocks, "GROUPS_PER_TASK", 50)
    vec, df = points
    found = {(r.qid, r.rank): (r.bid, r.d2) for r in nearest(df, blocks.make_cells(df, 3, block_rows), 3).collect()}
    d2 = ((vec[:, None, :] - vec[None, :, :]) ** 2).sum(-1)
    order = np.lexsort((np.broadcast_to(np.arange(len(vec)), d2.shape), d2), axis=1)
    assert len(found) == 3 * len(vec)
    for (qid, rank), (bid, d) in found.items():
        assert bid == order[qid, rank - 1] and d == pytest.approx(d2[qid, bid], abs=1e-12)


@pytest.mark.parametrize("pairs", [1 << 22, 300])
def test_every_pair_meets_once(monkeypatch, points, pairs):
    monkeypatch.setattr(blocks, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(blocks, "GROUPS_PER_TASK", 30)
    vec, df = points

    def kernel(q, b):
        a, c = np.meshgrid(q["id"], b["id"], indexing="ij")
        return {"a": a.ravel(), "b": c.ravel()}

    met = blocks.meet(df, blocks.make_cells(df, block_rows=32), blocks.reach_all, kernel, "a bigint, b bigint")
    counts = met.groupBy("a", "b").count()
    assert counts.count() == len(vec) ** 2 and counts.agg(F.max("count")).first()[0] == 1


def test_fold_reduces_what_the_blocks_of_a_group_gave(points):
    vec, df = points

    def kernel(q, b):
        return {"id": q["id"], "n": np.full(len(q.vec), len(b.vec))}

    def fold(found):
        ids, place = np.unique(found["id"], return_inverse=True)
        return {"id": ids, "n": np.bincount(place, found["n"]).astype(np.int64)}

    cells = blocks.make_cells(df, block_rows=32)
    rows = [blocks.meet(df, cells, blocks.reach_all, kernel, "id bigint, n bigint", f).collect() for f in (None, fold)]
    assert len(rows[1]) == len(vec) < len(rows[0]) and {r.n for r in rows[1]} == {len(vec)}
    assert sum(r.n for r in rows[0]) == len(vec) ** 2


def test_ward_searches_fewer_rows_each_round(spark, monkeypatch):
    from labeltrail.operators.cluster import ward as module

    rng = np.random.default_rng(1)
    vec = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) + 6])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vec)], "id long, vec array<double>, w long")
    asked, meet = [], module.meet
    monkeypatch.setattr(module, "meet", lambda q, *a, **k: asked.append(q.count()) or meet(q, *a, **k))
    found = {r.id: r.cluster_id for r in module.ward(df, 3.0).collect()}
    groups = [([k], v, 1) for k, v in enumerate(vec)]
    while True:
        gaps = [
            (math.sqrt(2 * a[2] * b[2] / (a[2] + b[2])) * np.linalg.norm(a[1] - b[1]), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups[:i])
        ]
        d, i, j = min(gaps)
        if d >= 3.0:
            break
        a, b = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)]
        groups.append((a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]))
    assert {frozenset(g[0]) for g in groups} == {frozenset(k for k in found if found[k] == c) for c in set(found.values())}
    assert asked[0] == 60 and sum(asked[1:]) < 60 * (len(asked) - 1) / 2  # whole searches would be at least half of all rows


def test_dbscan_border_rows_take_the_first_cluster_in_reach(spark):
    from labeltrail.operators.cluster.dbscan import dbscan

    rng = np.random.default_rng(4)
    vec = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vec)], "id long, vec array<double>, w long")
    near = np.linalg.norm(vec[:, None] - vec[None], axis=2) <= 0.25
    core = near.sum(1) >= 4
    label, number = {}, 0
    for k in np.flatnonzero(core).tolist():
        if k in label:
            continue
        open_ = [k]
        label[k] = number
        while open_:
            for y in np.flatnonzero(near[open_.pop()] & core).tolist():
                if y not in label:
                    label[y] = number
                    open_.append(y)
        number += 1
    for k in np.flatnonzero(~core).tolist():
        label[k] = min((label[y] for y in np.flatnonzero(near[k] & core).tolist()), default=-1)
    assert number > 2 and any(label[k] >= 0 for k in np.flatnonzero(~core).tolist())
    assert {r.id: r.cluster_id for r in dbscan(df, 0.25, 4, block_rows=16).collect()} == label


def test_kmeans_starts_share_a_pass_and_settle(spark, monkeypatch):
    from labeltrail.operators.cluster import kmeans

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 3)) * 10
    vec = np.concatenate([c + rng.normal(size=(20, 3)) * 0.1 for c in centers])
    df = spark.createDataFrame([(k, v.tolist(), 1 + k % 2) for k, v in enumerate(vec)], "id long, vec array<double>, w long")
    passes, gathered = [], kmeans._gathered
    monkeypatch.setattr(kmeans, "_gathered", lambda reps, c: passes.append(len(c)) or gathered(reps, c))
    labels, facts = kmeans.kmeans(df, 6, starts=4)
    found = {r.id: r.cluster_id for r in labels.collect()}
    assert passes[0] == passes[1] == 4 and passes == sorted(passes, reverse=True)
    assert all(len({found[20 * g + k] for k in range(20)}) == 1 for g in range(6)) and len(set(found.values())) == 6
    cost = sum((1 + k % 2) * ((vec[k] - np.array(facts["centers"][found[k]])) ** 2).sum() for k in range(len(vec)))
    assert facts["inertia"] == pytest.approx(cost) and "note" not in facts


@pytest.mark.parametrize("pairs, block_rows", [(1 << 22, 512), (3_000, 16), (400, 7)])
def test_meet_pairs_meets_each_pair_once(spark, monkeypatch, points, pairs, block_rows):
    monkeypatch.setattr(blocks, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(blocks, "GROUPS_PER_TASK", 50)
    vec, df = points

    def kernel(met):
        a, b = [], []
        for q, base, same in met:
            rows, cols = np.triu_indices(len(q.vec), 1) if same else np.indices((len(q.vec), len(base.vec))).reshape(2, -1)
            a.append(q["id"][rows])
            b.append(base["id"][cols])
        return {"a": np.concatenate([*a, np.zeros(0, int)]), "b": np.concatenate([*b, np.zeros(0, int)])}

    rows = blocks.meet_pairs(df, kernel, "a bigint, b bigint", block_rows)
    found = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = len(vec) * (len(vec) - 1) // 2
    assert found.count() == found.distinct().count() == n and found.filter("a = b").isEmpty()


def test_queries_that_meet_most_cells_are_not_copied_for_each(spark, monkeypatch):
    """Vectors without a near place, many cells: one copy a strip, not one a cell."""
    rng = np.random.default_rng(8)
    vec = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "id long, vec array<double>")
    cells = blocks.make_cells(df, 3, 16)
    assert len(cells.pivots) > 20
    grids = []
    real = blocks.make_grid
    monkeypatch.setattr(blocks, "make_grid", lambda *args: grids.append(real(*args)) or grids[-1])
    found = {(r.qid, r.rank): r.bid for r in nearest(df, cells, 3).collect()}
    assert len(grids) == 1 and grids[0].groups == 1 and len(grids[0].asking) == 1
    d2 = ((vec[:, None, :] - vec[None, :, :]) ** 2).sum(-1)
    order = np.argsort(d2, axis=1)
    assert len(found) == 3 * len(vec) and all(order[q, r - 1] == b for (q, r), b in found.items())
