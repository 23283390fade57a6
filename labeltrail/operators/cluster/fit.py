"""One entry point for all clustering methods."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.cluster import dbscan as _dbscan
from labeltrail.operators.cluster import hdbscan as _hdbscan
from labeltrail.operators.cluster import kmeans as _kmeans
from labeltrail.operators.cluster import meanshift as _meanshift
from labeltrail.operators.cluster import ward as _ward
from labeltrail.operators.cluster.common import (
    Clustering,
    as_points,
    count_labels,
    distinct_vectors,
    median_neighbor_distance,
    pair_distance_median,
    spread_labels,
    total_weight,
)
from labeltrail.operators.cluster.quality import silhouette_of, silhouette_squared
from labeltrail.scratch import cut

METHODS = ("kmeans", "dbscan", "hdbscan", "agglomerative", "meanshift")
SCORES = ("exact", "squared", "none")


@dataclass(frozen=True)
class _Rows:
    """Rows to cluster, and what of them does not depend on alpha, worked out once."""

    points: DataFrame
    reps: DataFrame
    zero_eps: str

    @cached_property
    def total(self) -> int:
        return total_weight(self.reps)

    @cached_property
    def near(self) -> float:
        return median_neighbor_distance(self.reps, self.zero_eps)

    @cached_property
    def middle(self) -> float | None:
        return pair_distance_median(self.reps)


def _rows_of(vectors: DataFrame, zero_eps: str) -> _Rows:
    points = as_points(vectors)
    return _Rows(points, distinct_vectors(points), zero_eps)


def _check(method: str, score: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown clustering method {method!r}, expected one of {METHODS}")
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}, expected one of {SCORES}")


def cluster(
    vectors: DataFrame,
    method: str = "dbscan",
    alpha: float = 1.0,
    seed: int = 42,
    zero_eps: str = "raise",
    score: str = "exact",
    bandwidth_rows: int | None = None,
) -> Clustering:
    """Cluster ``vectors(idx, embedding)``.

    Parameters of a method follow from the number of rows, the distances and
    ``alpha``. ``score`` picks the silhouette: ``exact`` measures all pairs of
    distinct vectors, ``squared`` is linear, ``none`` leaves it out. Mean shift sets its
    bandwidth by all rows, or by a sample of ``bandwidth_rows``.
    """
    _check(method, score)
    return _cluster(_rows_of(vectors, zero_eps), method, alpha, seed, score, bandwidth_rows)


def _cluster(given: _Rows, method: str, alpha: float, seed: int, score: str, bandwidth_rows: int | None) -> Clustering:
    points, reps, rows = given.points, given.reps, given.total
    facts: dict = {"method": method}
    extras = None

    if method == "kmeans":
        k = _kmeans.clusters_for(rows, alpha)
        labels, found = _kmeans.kmeans(reps, k, seed)
        facts.update(found)
    elif method == "dbscan":
        eps, min_samples = given.near / alpha, _dbscan.min_samples_for(rows, alpha)
        labels = _dbscan.dbscan(reps, eps, min_samples)
        facts.update(eps=eps, min_samples=min_samples)
    elif method == "hdbscan":
        found = _hdbscan.fit(reps, rows, alpha)
        labels, extras = found.labels, found.extras
        facts.update(found.info)
    elif method == "agglomerative":
        if given.middle is None:
            raise ValueError("no two different vectors")
        labels = _ward.ward(reps, given.middle / alpha)
        facts.update(distance_threshold=given.middle / alpha)
    else:
        labels, found = _fit_meanshift(given, alpha, seed, bandwidth_rows)
        facts.update(found)

    labels = cut(labels, "labels")
    labeled = cut(reps.join(labels, "id"), "labeled")
    spread = cut(spread_labels(points, reps, labels), "labels")
    clusters, noise = count_labels(spread)
    facts.update(n_clusters=clusters)
    has_noise = method in ("dbscan", "hdbscan")
    if has_noise:
        facts.update(n_noise=noise)
    facts["silhouette_score"] = _score(labeled, clusters, has_noise, score)
    return Clustering(spread, facts, None if extras is None else spread_labels(points, reps, extras))


def _score(labeled: DataFrame, clusters: int, drop_noise: bool, score: str) -> float | None:
    if score == "none":
        return None
    if clusters <= 1:
        return 0.0
    if score == "exact":
        return silhouette_of(labeled, drop_noise)
    return silhouette_squared(labeled.filter("cluster_id <> -1") if drop_noise else labeled)


def _fit_meanshift(given: _Rows, alpha: float, seed: int, bandwidth_rows: int | None) -> tuple[DataFrame, dict]:
    """Binned seeds first; if no seed has a row in reach, twice the bandwidth with all rows as seeds next, one cluster last."""
    facts: dict = {}
    reps = given.reps
    if bandwidth_rows is None:
        bandwidth = _meanshift.bandwidth_of(given.middle, alpha)
    else:
        bandwidth = _meanshift.bandwidth_for(given.points, reps, alpha, seed, bandwidth_rows)
    one_cluster = reps.select("id", F.lit(0).alias("cluster_id"))
    if bandwidth is None:
        return one_cluster, {"note": "all rows are equal: one cluster"}
    facts["bandwidth"] = bandwidth
    try:
        return _meanshift.meanshift(reps, bandwidth, facts=facts), facts
    except _meanshift.NoMode:
        facts.update(bandwidth=2 * bandwidth, note="bandwidth was doubled")
    try:
        return _meanshift.meanshift(reps, 2 * bandwidth, bin_seeding=False, facts=facts), facts
    except _meanshift.NoMode:
        facts["note"] = "all rows in one cluster"
        return one_cluster, facts


INFO_FIELDS = {
    "method": "string",
    "n_clusters": "bigint",
    "n_noise": "bigint",
    "silhouette_score": "double",
    "inertia": "double",
    "eps": "double",
    "min_samples": "bigint",
    "min_cluster_size": "bigint",
    "distance_threshold": "double",
    "bandwidth": "double",
    "note": "string",
}


def info_row(df: DataFrame, facts: dict) -> DataFrame:
    """Run facts as one row with a fixed schema."""
    spark = df.sparkSession
    columns = [F.lit(facts.get(k)).cast(t).alias(k) for k, t in INFO_FIELDS.items()]
    return spark.range(1).select(*columns)


def sweep(
    vectors: DataFrame, methods: list[str], alphas: list[float], seed: int = 42, zero_eps: str = "raise",
    score: str = "exact", bandwidth_rows: int | None = None,
) -> DataFrame:
    """One info row per method and alpha.

    Distinct rows and the distances that parameters follow from are worked out once. Settings run one after
    the other, as the plans of several at a time take a small driver's memory.
    """
    for method in methods:
        _check(method, score)
    given = _rows_of(vectors, zero_eps)
    rows = []
    for method, alpha in product(methods, alphas):
        run = _cluster(given, method, alpha, seed, score, bandwidth_rows)
        rows.append(info_row(vectors, run.info).withColumn("alpha", F.lit(float(alpha))))
    return reduce(DataFrame.unionByName, rows)
