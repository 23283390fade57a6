"""Mean shift: few seeds are sent to the rows, and the median leaves out blocks that lie on one side."""

import numpy as np
import pytest

from labeltrail.operators import blocks
from labeltrail.operators.cluster import meanshift as ms


def _rows(spark, vec):
    return spark.createDataFrame([(k, v.tolist(), 1 + k % 3) for k, v in enumerate(vec)], "id long, vec array<double>, w long")


@pytest.mark.parametrize("rounds", [300, 2])
def test_sent_seeds_rest_where_met_ones_do(spark, monkeypatch, rounds):
    rng = np.random.default_rng(11)
    reps = _rows(spark, np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (3, 0), (0, 3))]))
    shifts, real, found = [], ms.meet, []
    monkeypatch.setattr(ms, "meet", lambda *args: shifts.append(args[4]) or real(*args))
    for sent in (0, 4, 1024):
        monkeypatch.setattr(ms, "_SENT_SEEDS", sent)
        shifts.clear()
        facts = {}
        labels = {r.id: r.cluster_id for r in ms.meanshift(reps, 0.8, facts=facts, rounds=rounds).collect()}
        found.append((labels, "note" in facts))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 180
    assert not [s for s in shifts if "total" in s]  # before: all rows met the seeds by a shuffle in every round


def test_strips_of_neighbours_meet_each_pair_once_and_bounds_spare_most(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_PAIRS", 20_000)
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(1200, 3))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    vec[:100] = vec[0]  # one busy place
    placed = blocks.with_place(_rows(spark, vec), "place").cache()

    def kernel(met):
        every, unclear = 0, 0
        for a, b, same in met:
            n = len(a.vec) * (len(a.vec) - 1) // 2 if same else len(a.vec) * len(b.vec)
            (one, far), (other, wide) = a.ball, b.ball
            gap = np.linalg.norm(one - other)
            every, unclear = every + n, unclear + (n if gap - far - wide <= 1.41 <= gap + far + wide else 0)
        return {"a": np.array([every]), "b": np.array([unclear])}

    rows = blocks.meet_pairs(placed, kernel, "a bigint, b bigint", 4, "place").collect()
    every, unclear = sum(r.a for r in rows), sum(r.b for r in rows)
    assert len(rows) > 3 and every == 1200 * 1199 // 2 and unclear < 0.6 * every
