"""The exact median of all distances, whether or not the first interval holds it."""

import numpy as np
import pytest

from labeltrail.operators import blocks
from labeltrail.operators.cluster import common


@pytest.mark.parametrize("guess", ["none", "some rows", "wrong"])
def test_pair_median_of_weighted_rows(spark, monkeypatch, guess):
    rng = np.random.default_rng(4)
    vec, w = rng.normal(size=(90, 3)), rng.integers(1, 4, 90)
    reps = spark.createDataFrame([(k, v.tolist(), int(m)) for k, (v, m) in enumerate(zip(vec, w))], "id long, vec array<double>, w long")
    monkeypatch.setattr(blocks, "GROUP_PAIRS", 500)
    monkeypatch.setattr(common, "_MEDIAN_BLOCK", 16)
    monkeypatch.setattr(common, "_MEDIAN_BINS", 32)
    monkeypatch.setattr(common, "_MEDIAN_FETCH", 50)
    if guess == "some rows":
        monkeypatch.setattr(common, "_GUESS_ROWS", 40)
    if guess == "wrong":
        monkeypatch.setattr(common, "_guessed", lambda _: (0.01, 0.02))
    d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))[np.triu_indices(90, 1)]
    every = np.repeat(d, (w[:, None] * w[None, :])[np.triu_indices(90, 1)])
    assert common.pair_distance_median(reps) == pytest.approx(np.median(every), abs=1e-9)
    passes = []
    real = common.meet_pairs
    monkeypatch.setattr(common, "meet_pairs", lambda *args: passes.append(1) or real(*args))
    monkeypatch.setattr(common, "_MEDIAN_BINS", 1 << 16)
    if guess == "some rows":  # before: every ordered pair, and one pass more for each factor of 1,024
        assert common.pair_distance_median(reps) == pytest.approx(np.median(every), abs=1e-9) and len(passes) == 2
