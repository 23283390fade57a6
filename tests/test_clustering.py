import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from labeltrail.operators.cluster import common, dbscan, fit, hdbscan, meanshift, quality, ward
from labeltrail.operators.cluster.components import components
from labeltrail.scratch import cut


def table(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, embedding array<double>")


def reps_of(spark, x):
    points = common.as_points(table(spark, x))
    return points, common.distinct_vectors(points)


def labels_of(points, reps, labels):
    rows = common.spread_labels(points, reps, labels).orderBy("idx").collect()
    return np.array([r.cluster_id for r in rows])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.25, (40, 3)) for c in (-2, 0, 2)] + [rng.uniform(-4, 4, (30, 3))])
    x = x[rng.permutation(len(x))]
    x[100:120] = x[7]  # one row in 21 copies
    return x


@pytest.mark.parametrize("block_rows,eps,min_samples", [(32, 0.3, 3), (None, 0.6, 8)])
def test_dbscan_equals_the_scan(spark, data, block_rows, eps, min_samples):
    points, reps = reps_of(spark, data)
    got = labels_of(points, reps, dbscan.dbscan(reps, eps, min_samples, block_rows))
    assert (got == brute.dbscan(data, eps, min_samples)).all()


def test_dbscan_counts_the_bound_and_the_row_itself(spark):
    points, reps = reps_of(spark, [[0.0], [1.0], [2.0], [9.0]])
    assert labels_of(points, reps, dbscan.dbscan(reps, 1.0, 3)).tolist() == [0, 0, 0, -1]
    assert labels_of(points, reps, dbscan.dbscan(reps, 0.5, 2)).tolist() == [-1] * 4


def test_parameters_follow_rows_and_alpha(spark, data):
    _, reps = reps_of(spark, data)
    d = brute.pairwise(data) + np.where(np.eye(len(data)) > 0, np.inf, 0)
    eps, min_samples = dbscan.parameters(reps, 2.0)
    assert eps == pytest.approx(np.median(d.min(1)) / 2.0)
    assert min_samples == max(3, int(np.log(len(data)) * 2.0))


def test_mostly_copies_raise_or_use_the_others(spark):
    x = [[0.0]] * 6 + [[5.0], [7.0]]
    _, reps = reps_of(spark, x)
    with pytest.raises(ValueError):
        dbscan.parameters(reps, 1.0)
    assert dbscan.parameters(reps, 1.0, "positive_median")[0] == 2.0


@pytest.mark.parametrize("block_rows,threshold", [(16, 0.8), (None, 3.0)])
def test_ward_equals_one_by_one_merges(spark, data, block_rows, threshold):
    x = data[:60].copy()
    x[40:45] = x[7]
    points, reps = reps_of(spark, x)
    got = labels_of(points, reps, ward.ward(reps, threshold, block_rows))
    assert (got == brute.ward(x, threshold)).all()


@pytest.mark.parametrize("block_rows", [48, None])
def test_meanshift_equals_one_by_one(spark, data, block_rows):
    points, reps = reps_of(spark, data)
    got = labels_of(points, reps, meanshift.meanshift(reps, 1.2, block_rows=block_rows))
    assert brute.same_partition(got, brute.meanshift(data, 1.2))


def test_pair_median_of_positive_distances(spark, data):
    _, reps = reps_of(spark, data)
    d = brute.pairwise(data)
    assert common.pair_distance_median(reps) == pytest.approx(np.median(d[d > 0]), abs=1e-9)


def labeled_of(spark, x, labels):
    rows = [(i, [float(v) for v in r], 1, int(c)) for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, vec array<double>, w long, cluster_id int")


def test_silhouette(spark, data):
    labels = np.digitize(data[:, 0], [-1, 1])
    got = quality.silhouette_exact(labeled_of(spark, data, labels)).first().silhouette
    assert got == pytest.approx(brute.silhouette(data, labels))
    one = quality.silhouette_exact(labeled_of(spark, data[:5], [0] * 5)).first().silhouette
    alone = quality.silhouette_exact(labeled_of(spark, data[:5], range(5))).first().silhouette
    assert (one, alone) == (0.0, None)


def test_radius_has_noise_and_single_rows(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [2.0, 2.0]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, -1)], "idx long, cluster_id int")
    rows = {r.cluster_id: r for r in quality.cluster_radius(table(spark, x), labels).collect()}
    assert np.allclose(rows[0].centroid, [2 ** -0.5] * 2) and rows[0].max_distance == pytest.approx(1 - 2 ** -0.5)
    assert np.allclose(rows[-1].centroid, [2 ** -0.5] * 2) and rows[-1].max_distance == pytest.approx(0.0, abs=1e-15)
    flat = {r.cluster_id: r for r in quality.cluster_radius(table(spark, x), labels, "flat").collect()}
    assert flat[0].max_distance == pytest.approx(0.5 ** 0.5) and flat[-1].centroid == [2.0, 2.0]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + [(200, 201), (5, 5)], "a long, b long")
    roots = {r.id: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


@pytest.mark.parametrize("method", ["kmeans", "dbscan", "hdbscan", "agglomerative", "meanshift"])
def test_fit_gives_labels_and_facts(spark, data, method):
    data = data[:70]
    run = fit.cluster(table(spark, data), method, 1.0)
    rows = run.labels.orderBy("idx").collect()
    labels = np.array([r.cluster_id for r in rows])
    assert [r.idx for r in rows] == list(range(len(data)))
    assert run.info["n_clusters"] == len(set(labels) - {-1})
    kept = labels != -1
    if run.info["n_clusters"] > 1:
        assert run.info["silhouette_score"] == pytest.approx(brute.silhouette(data[kept], labels[kept]))
    if method == "kmeans":
        assert run.info["n_clusters"] <= int(np.sqrt(len(data)))
        assert run.info["inertia"] > 0


def test_unknown_method(spark, data):
    with pytest.raises(ValueError):
        fit.cluster(table(spark, data), "spectral")


def test_sweep_has_a_row_per_setting(spark, data):
    rows = fit.sweep(table(spark, data[:60]), ["dbscan"], [0.5, 1.0], score="none").orderBy("alpha").collect()
    assert [(r.method, r.alpha) for r in rows] == [("dbscan", 0.5), ("dbscan", 1.0)]
    assert rows[0].eps == pytest.approx(2 * rows[1].eps)


@pytest.mark.parametrize("block_rows,part_edges", [(None, 100_000), (32, 20)])
def test_hdbscan_equals_thresholds(spark, data, block_rows, part_edges):
    x = data[:90].copy()
    x[50:53] = x[7]  # four copies
    points, reps = reps_of(spark, x)
    rows = hdbscan.hdbscan(reps, 6, 4, block_rows, part_edges)
    at = {tuple(r.vec): (r.cluster_id, r.probability) for r in reps.join(rows, "id").collect()}
    got = [at[tuple(float(v) for v in row)] for row in x]
    labels, share = brute.hdbscan(x, 6, 4)
    assert len(set(labels)) > 2
    assert brute.same_partition([g[0] for g in got], labels.tolist())
    assert [g[0] == -1 for g in got] == (labels == -1).tolist()
    assert np.allclose([g[1] for g in got], share, atol=1e-9)


def test_hdbscan_meets_near_cells_only(spark, monkeypatch):
    """The own cell bounds the search in the others, and a component does not meet cells that are its own as a whole."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(-1, 1, (300, 2)), rng.uniform(9, 11, (300, 2))])
    points, reps = reps_of(spark, x)
    pairs, real = [], hdbscan.meet

    def met(asked, cells, reach, *args, **options):
        rows = asked.toPandas()
        vec = np.array(rows["vec"].tolist())
        far = np.sqrt(((vec[:, None] - cells.pivots[None]) ** 2).sum(-1))
        pairs.append(int((reach(vec, far, cells, pa.RecordBatch.from_pandas(rows)) @ cells.count).sum()))
        return real(asked, cells, reach, *args, **options)

    monkeypatch.setattr(hdbscan, "meet", met)
    d = brute.pairwise(x)
    core = np.sort(d, axis=1)[:, 5]
    ready = cut(reps.join(hdbscan.core_distances(reps, 5, 16), "id"), "cores")
    found = {r.id: r.core for r in ready.collect()}
    at = {tuple(r.vec): r.id for r in reps.collect()}
    assert np.allclose([found[at[tuple(v)]] for v in x.tolist()], core, rtol=1e-12, atol=0)
    tree = hdbscan.spanning_tree(ready, 16)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, best, total = {0}, reach[0].copy(), 0.0
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        k = int(best.argmin())
        total += best[k]
        inside.add(k)
        best = np.minimum(best, reach[k])
    assert tree.count() == len(x) - 1
    assert tree.agg(F.sum("m")).first()[0] == pytest.approx(total, rel=1e-12)
    assert sum(pairs) < len(x) * len(x)


@pytest.mark.parametrize("part_edges", [2, 100])
def test_roots_of_few_and_many_edges(spark, part_edges):
    edges = spark.createDataFrame([(5, 3), (3, 9), (8, 7), (7, 8), (1, 9)], "a long, b long")
    found = {r.id: r.root for r in hdbscan._roots(edges, part_edges).collect()}
    assert found == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7}


def test_components_keep_two_rounds_of_tables(spark):
    from pathlib import Path

    from labeltrail.operators.cluster.components import components
    from labeltrail.scratch import _session_folder

    chain = spark.range(1, 600).selectExpr("id as a", "id - 1 as b")
    folder = Path(_session_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = components(chain)
    assert found.filter("root <> 0").isEmpty() and found.count() == 600
    assert len(set(folder.iterdir()) - before) <= 2 * 5


def test_labels_of_one_giant_group(spark):
    members = spark.range(2_000).selectExpr("id", "if(id < 1900, 5, id) as root")
    labels = {r["id"]: r["cluster_id"] for r in common.rank_labels(members).collect()}
    assert len(labels) == 2_000 and {labels[i] for i in range(1900)} == {0} and labels[1999] == 100


def test_ward_meets_near_cells_only(spark, monkeypatch):
    """The partner in the own cell bounds the search in the others, whatever the threshold."""
    rng = np.random.default_rng(11)
    x, w = rng.uniform(-1, 1, (500, 2)), rng.integers(1, 9, 500)
    active = spark.createDataFrame([(k, v.tolist(), int(m)) for k, (v, m) in enumerate(zip(x, w))], "id long, vec array<double>, w long")
    pairs, real = [], ward.meet

    def met(asked, cells, reach, *args, **options):
        rows = asked.toPandas()
        vec = np.array(rows["vec"].tolist())
        far = np.sqrt(((vec[:, None] - cells.pivots[None]) ** 2).sum(-1))
        pairs.append(int((reach(vec, far, cells, pa.RecordBatch.from_pandas(rows)) @ cells.count).sum()))
        return real(asked, cells, reach, *args, **options)

    monkeypatch.setattr(ward, "meet", met)
    found = ward._partners(active, active, 3.0, 16).groupBy("id").agg(F.min(F.struct("d2", "partner")).alias("c")).collect()
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1) * 2.0 * w[:, None] * w[None, :] / (w[:, None] + w[None, :])
    np.fill_diagonal(d2, np.inf)
    assert {r.id: r.c.partner for r in found} == dict(enumerate(d2.argmin(axis=1).tolist()))
    assert sum(pairs) < 0.5 * 500 * 500
