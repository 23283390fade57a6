"""Nearest rows with the bound of the blocks before and products in single precision, and rows packed for k-means."""

import numpy as np
import pyarrow as pa
import pytest

from labeltrail.operators import blocks, search
from labeltrail.operators.cluster import kmeans


def _block(ids, vec):
    return blocks.Block(pa.table({"id": pa.array(ids), "vec": pa.array(vec.tolist())}), vec)


@pytest.mark.parametrize("dim, shift, scale", [(3, 0.0, 1.0), (64, 0.0, 1.0), (64, 1e4, 1.0), (64, 0.0, 1e-12), (64, 0.0, 1e20)])
def test_bounded_blocks_give_the_nearest(dim, shift, scale):
    rng = np.random.default_rng(dim)
    vec = rng.normal(size=(400, dim)) * scale + shift
    vec[50:90] = vec[10]  # copies, and many equal distances
    ids, seen = rng.permutation(400), None
    q = _block(ids[:100], vec[:100])
    kernel, fold, given = search.nearest_kernel(3), search.nearest_fold(3), []
    for a in range(0, 400, 50):
        got = kernel(q, _block(ids[a : a + 50], vec[a : a + 50]), seen)
        given.append(len(got["qid"]))
        seen = fold(got if seen is None else {c: np.concatenate([seen[c], got[c]]) for c in got})
    d2 = ((vec[:100, None] - vec[None]) ** 2).sum(-1)
    wanted = {(int(ids[i]), int(ids[j])) for i in range(100) for j in np.lexsort((ids, d2[i]))[:3]}
    assert set(zip(seen["qid"].tolist(), seen["bid"].tolist())) == wanted
    assert given[0] == 300 and given[-1] < 150  # before: three for each query from each block


def test_search_over_several_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vec = rng.normal(size=(300, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "idx long, embedding array<double>")
    for options in ({"metric": "flat"}, {"metric": "ivf", "nprobe": 4, "centers": vec[:4]}):
        hits = search.search(rows.withColumnRenamed("idx", "qid"), rows, k=2, block_rows=32, **options).collect()
        d2 = ((vec[:, None] - vec[None]) ** 2).sum(-1)
        assert {(h.qid, h.idx) for h in hits} == {(i, int(j)) for i in range(300) for j in np.argsort(d2[i])[:2]}


def test_packed_rows_give_the_same_sums(spark):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(500, 5))
    reps = spark.createDataFrame([(i, v.tolist(), 1 + i % 2) for i, v in enumerate(vec)], "id long, vec array<double>, w long")
    parts = kmeans.packed(reps)
    assert parts.count() < 500  # before: a row for each vector in every round
    plain, short = (kmeans._gathered(rows, [vec[:7]]) for rows in (reps, parts))
    assert plain.keys() == short.keys()
    for key in plain:
        assert plain[key][0] == short[key][0] and np.allclose(plain[key][1], short[key][1], rtol=0, atol=1e-9)
