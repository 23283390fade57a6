"""Classification of new events and the check of their label sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.vectors import dot, l2_normalize
from labeltrail.operators.bloom import BloomFilter, check_ngrams
from labeltrail.operators.cluster.common import NOISE
from labeltrail.operators.heavy import lookup
from labeltrail.operators.ngrams import label_ngrams
from labeltrail.operators.search import top1
from labeltrail.scratch import cut


def classify(
    queries: DataFrame,
    base: DataFrame,
    labels: DataFrame,
    centroids: DataFrame,
    class_threshold: float = 0.5,
    distance_to: str = "nearest",
) -> DataFrame:
    """Class of each of ``queries(idx, embedding)`` by its nearest known vector.

    ``labels(idx, cluster_id)`` belong to ``base(idx, embedding)``, and
    ``centroids(cluster_id, centroid, max_distance)`` to the labels. Within the
    radius, or outside it but not beyond ``class_threshold``, the class is that of
    the nearest vector; else, or with no cluster or radius, it is unknown.
    The distance is the one to the nearest vector, or with
    ``distance_to='centroid'`` to its cluster's centroid.
    """
    if distance_to not in ("nearest", "centroid"):
        raise ValueError(f"unknown distance_to {distance_to!r}")
    asked = queries.select(F.col("idx").alias("qid"), "embedding")
    hits = cut(top1(asked, base).withColumnRenamed("idx", "base_idx"), "hits")
    facts = ["cluster_id", "max_distance"] + (["centroid"] if distance_to == "centroid" else [])
    # One base row may be the nearest of many queries, so its facts are looked up
    # once per base row and reach the queries without moving the frequent ones.
    met = hits.groupBy("base_idx").agg(F.count(F.lit(1)).alias("n"))
    table = (
        met.join(labels.select(F.col("idx").alias("base_idx"), "cluster_id"), "base_idx", "left")
        .join(centroids.select(*facts), "cluster_id", "left")
        .select("base_idx", "n", *facts)
    )
    return decide(queries, lookup(hits, table, "base_idx", "n"), class_threshold, distance_to)


def decide(
    queries: DataFrame, hits: DataFrame, class_threshold: float = 0.5, distance_to: str = "nearest"
) -> DataFrame:
    """Classes from ``hits(qid, base_idx, similarity, distance, cluster_id, max_distance)``.

    One row per query; a query without a hit is unknown, with null facts.
    """
    columns = ["idx"] if distance_to == "nearest" else ["idx", "embedding"]
    rows = queries.select(*columns).join(hits.withColumnRenamed("qid", "idx"), "idx", "left")
    if distance_to == "centroid":
        similarity = dot(l2_normalize("embedding"), "centroid")
        rows = rows.withColumn("similarity", similarity).withColumn("distance", 1.0 - similarity)
    within = F.coalesce(F.col("distance") <= F.col("max_distance"), F.lit(False))
    unknown = F.col("max_distance").isNull() | (~within & (F.col("distance") > class_threshold))
    flagged = rows.withColumn("within_max_distance", within).withColumn(
        "is_unknown", F.coalesce(unknown, F.lit(True))
    )
    return flagged.select(
        "idx",
        "base_idx",
        "cluster_id",
        "is_unknown",
        F.when(~F.col("is_unknown"), F.col("cluster_id")).alias("class_id"),
        "similarity",
        "distance",
        "max_distance",
        "within_max_distance",
    )


def class_counts(classified: DataFrame) -> DataFrame:
    """Rows per class, most frequent first; unknown by name."""
    name = F.when(F.col("is_unknown"), "unknown").otherwise(F.col("class_id").cast("string"))
    return classified.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        F.desc("cnt"), "class"
    )


def class_summary(classified: DataFrame) -> DataFrame:
    """Classified and unknown rows, one row."""
    return classified.agg(
        F.count_if(~F.col("is_unknown")).alias("classified"), F.count_if("is_unknown").alias("unknown")
    )


def top_assigned_clusters(classified: DataFrame, top_n: int = 10) -> DataFrame:
    """Clusters met most often, by nearest vector and whatever the class; noise left out."""
    return (
        classified.filter(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != NOISE))
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "cluster_id")
        .limit(top_n)
    )


def sequence_labels(classified: DataFrame, unknown_label: int = NOISE) -> DataFrame:
    """``idx, label``: unknown becomes ``unknown_label``, the noise label by default."""
    label = F.when(F.col("is_unknown"), F.lit(unknown_label)).otherwise(
        F.coalesce(F.col("class_id"), F.lit(NOISE))
    )
    return classified.select("idx", label.cast("int").alias("label"))


def check_sequence(
    seq: DataFrame, bloom: BloomFilter, n: int, keys: tuple[str, ...] = ()
) -> DataFrame:
    """N-grams of ``seq(idx, label)`` with ``is_member``; misses start an anomaly."""
    return check_ngrams(bloom, label_ngrams(seq, n, keys=keys))


def anomalies(checked: DataFrame) -> DataFrame:
    """N-grams the filter has never seen."""
    return checked.filter(~F.col("is_member"))


def match_summary(checked: DataFrame) -> DataFrame:
    """Totals and shares of matched and unmatched n-grams, one row."""
    sums = checked.agg(
        F.count(F.lit(1)).alias("total_ngrams"), F.count_if("is_member").alias("matched_ngrams")
    ).withColumn("unmatched_ngrams", F.col("total_ngrams") - F.col("matched_ngrams"))

    def percent(part: str):
        share = F.round(100.0 * F.col(part) / F.col("total_ngrams"), 2)
        return F.when(F.col("total_ngrams") > 0, share).otherwise(0.0)

    return sums.select(
        "*",
        percent("matched_ngrams").alias("matched_percent"),
        percent("unmatched_ngrams").alias("unmatched_percent"),
    )
