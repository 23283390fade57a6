"""The sweep covers all methods that find the number of clusters themselves, and equals its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
from labeltrail.operators.cluster import fit

ALPHAS = {"dbscan": (0.3, 0.5, 0.7, 1.0, 1.5)} | {m: (0.5, 1.0, 1.5) for m in ("hdbscan", "agglomerative", "meanshift")}


def test_sweep_alpha_runs_every_method_and_equals_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(11)
    centers = rng.normal(size=(5, 64))
    vec = (centers[rng.integers(0, 5, 90)] + rng.normal(size=(90, 64)) * rng.uniform(0.2, 0.6, (90, 1))).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(90), "embedding": pa.array(list(vec), pa.list_(pa.float32())), "label": pa.array(np.zeros(90), pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    found = [tuple(r) for r in entry.queries()["sweep_alpha"](spark, str(tmp_path)).collect()]
    assert {r[:2] for r in found} == {(m, a) for m, alphas in ALPHAS.items() for a in alphas}  # before: DBSCAN with two alphas
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert sorted(map(str, found)) == sorted(map(str, con.execute(entry.oracle_sql()["sweep_alpha"]).fetchall()))
    assert len({r[2] for r in found}) > 2  # the settings differ in what they find


def test_settings_of_a_sweep_share_what_does_not_follow_from_alpha(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx long, embedding array<double>")
    taken = []
    for name in ("distinct_vectors", "median_neighbor_distance", "pair_distance_median"):
        real = getattr(fit, name)
        monkeypatch.setattr(fit, name, lambda *a, real=real, name=name: taken.append(name) or real(*a))
    rows = fit.sweep(df, ["dbscan", "agglomerative"], [0.5, 1.0]).collect()
    assert sorted(taken) == ["distinct_vectors", "median_neighbor_distance", "pair_distance_median"]  # before: once for each alpha
    assert [(r.method, r.alpha) for r in rows] == [(m, a) for m in ("dbscan", "agglomerative") for a in (0.5, 1.0)]
    d = brute.pairwise(x)
    middle = np.median(d[np.triu_indices(45, 1)])
    for r in rows:
        labels = brute.ward(x, middle / r.alpha) if r.method == "agglomerative" else brute.dbscan(x, r.eps, r.min_samples)
        kept = labels != -1
        assert r.n_clusters == len(set(labels[kept])) and r.n_noise == (None if r.method == "agglomerative" else (~kept).sum())
        if r.n_clusters > 1:
            assert r.silhouette_score == pytest.approx(brute.silhouette(x[kept], labels[kept]))
        if r.method == "agglomerative":
            assert r.distance_threshold == pytest.approx(middle / r.alpha)
    with pytest.raises(ValueError):
        fit.sweep(df, ["dbscan", "spectral"], [1.0])
