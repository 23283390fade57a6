"""Label sequences: matching events with labels, gaps and noise numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.cluster.common import NOISE
from labeltrail.operators.ngrams import label_ngrams
from labeltrail.operators.position import with_position
from labeltrail.scratch import cut


def match_sequence(events: DataFrame, labels: DataFrame, data: str = "raw") -> DataFrame:
    """``idx, cluster_id, data``; sequences of unequal length or with other positions raise."""
    n_events, n_labels = events.count(), labels.count()
    if n_events != n_labels:
        raise ValueError(f"{n_events} events do not fit {n_labels} labels")
    matched = cut(_match(events, labels, data), "matched")
    n_matched = matched.count()
    if n_matched != n_events:
        raise ValueError(f"{n_matched} of {n_events} events have a label at their position")
    return matched


def _match(events: DataFrame, labels: DataFrame, data: str) -> DataFrame:
    return events.select("idx", F.col(data).alias("data")).join(
        labels.select("idx", F.col("cluster_id").cast("int").alias("cluster_id")), "idx"
    ).select("idx", "cluster_id", "data")


def match_shorter(events: DataFrame, labels: DataFrame, data: str = "raw") -> DataFrame:
    """The same over the length of the shorter sequence; both are numbered from 0 without gaps first."""
    first = with_position(events.select(F.col("idx").alias("_at"), data), ["_at"], "idx")
    second = with_position(labels.select(F.col("idx").alias("_at"), "cluster_id"), ["_at"], "idx")
    return _match(first, second, data)


def labels_from_mapping(mapping: DataFrame, renumber_noise: bool = True, gap_label: int = 0) -> DataFrame:
    """Labels for every position 0..max of a mapping ``cluster_id, idx``.

    Each noise row gets a number of its own after the largest cluster, in position
    order. A position the mapping lacks gets ``gap_label``. An empty mapping raises.
    """
    known = mapping.filter(F.col("idx").isNotNull()).select("idx", F.col("cluster_id").cast("int"))
    ends = known.agg(
        F.max("idx").alias("last"), F.max(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("top")
    ).first()
    if ends.last is None:
        raise ValueError("the mapping holds no rows")
    if renumber_noise:
        first = 0 if ends.top is None else ends.top + 1
        noise = with_position(known.filter(F.col("cluster_id") == NOISE), ["idx"], "_n").select(
            "idx", (F.col("_n") + first).cast("int").alias("cluster_id")
        )
        known = known.filter(F.col("cluster_id") != NOISE).unionByName(noise)
    spark = mapping.sparkSession
    places = spark.range(ends.last + 1).withColumnRenamed("id", "idx")
    return places.join(known, "idx", "left").select(
        "idx", F.coalesce("cluster_id", F.lit(gap_label)).alias("cluster_id")
    )


def write_matched(matched: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep a matched sequence, as parquet or JSON lines."""
    matched.write.mode("overwrite").format(fmt).save(path)


def read_matched(spark, path: str, fmt: str = "parquet") -> DataFrame:
    schema = "idx bigint, cluster_id int, data string"
    return spark.read.schema(schema).format(fmt).load(path)


def ngrams_from_matched(matched: DataFrame, n: int) -> DataFrame:
    """N-grams of a stored matched sequence in index order."""
    return label_ngrams(matched, n, label="cluster_id")
