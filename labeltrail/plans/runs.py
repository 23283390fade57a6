"""Training, detection and cluster study as whole runs over event logs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from labeltrail.config import RunConfig
from labeltrail.functions.embed import EmbedFunction, embed
from labeltrail.functions.text import METADATA_FIELDS, event_metadata, event_text, fields
from labeltrail.functions.vectors import l2_normalize
from labeltrail.operators.bloom import build_filter, filter_quality
from labeltrail.operators.cluster.fit import cluster
from labeltrail.operators.cluster.quality import cluster_radius
from labeltrail.operators.detect import check_sequence, classify, sequence_labels
from labeltrail.operators.ngrams import compare_sizes, count_ngrams, label_ngrams
from labeltrail.operators.position import split_by_position
from labeltrail.operators.sequence import labels_from_mapping, match_shorter
from labeltrail.operators.trace import cluster_statistics, refine, refined_statistics, trace
from labeltrail.scratch import cut
from labeltrail.sources.store import Model


def event_vectors(
    events: DataFrame, config: RunConfig, fn: EmbedFunction | None = None, exact_text: bool = True,
    data_type: str = "normal",
) -> DataFrame:
    """``events(idx, raw)`` to ``idx, embedding, metadata`` with unit vectors."""
    texts = cut(
        events.select("idx", "raw", event_text("raw", config.keep_prefixes, exact_text).alias("text")),
        "texts",
    )
    embedded = embed(texts, "text", fn, config.embedding_dim)
    metadata = event_metadata("idx", "text", fields("raw", names=METADATA_FIELDS), data_type)
    return embedded.select("idx", l2_normalize("embedding").alias("embedding"), metadata.alias("metadata"))


def cluster_collection(vectors: DataFrame, config: RunConfig, score: str = "exact") -> Model:
    """Labels, facts and radii of a vector collection."""
    run = cluster(
        vectors, config.clustering_method, config.clustering_alpha, config.clustering_seed,
        config.zero_eps, score, config.bandwidth_rows,
    )
    centroids = cut(cluster_radius(vectors, run.labels), "centroids")
    facts = {k: v for k, v in run.info.items() if k != "centers"}
    return Model(config, vectors, run.labels, centroids, info=facts)


def train_sequence(labels: DataFrame, config: RunConfig) -> Model:
    """N-grams, their counts and the filter of a label sequence ``labels(idx, cluster_id)``."""
    ngrams = cut(label_ngrams(labels, config.ngram_size, "cluster_id"), "ngrams")
    counts = count_ngrams(ngrams)
    return Model(
        config, labels=labels, ngrams=ngrams, ngram_counts=counts,
        bloom=build_filter(counts, config.bloom_error_rate),
    )


def train(
    events: DataFrame,
    config: RunConfig = RunConfig(),
    fn: EmbedFunction | None = None,
    exact_text: bool = True,
    score: str = "exact",
) -> Model:
    """Model of normal ``events(idx, raw)``."""
    vectors = cut(event_vectors(events, config, fn, exact_text), "vectors")
    clustered = cluster_collection(vectors, config, score)
    sequence = train_sequence(clustered.labels, config)
    return replace(
        clustered, ngrams=sequence.ngrams, ngram_counts=sequence.ngram_counts, bloom=sequence.bloom
    )


@dataclass(frozen=True)
class Detection:
    """Classes of the new events and their n-grams with the filter's answer."""

    classified: DataFrame
    checked: DataFrame


def detect(
    events: DataFrame,
    model: Model,
    fn: EmbedFunction | None = None,
    exact_text: bool = True,
    ngram_size: int | None = None,
    class_threshold: float | None = None,
    unknown_label: int = -1,
    distance_to: str = "nearest",
) -> Detection:
    """Classify new ``events(idx, raw)`` and check their label sequence.

    Text, size and threshold settings are the trained ones; an ``ngram_size`` other
    than the trained one raises.
    """
    model.require("vectors", "labels", "centroids", "bloom")
    config = model.config
    if ngram_size is not None and ngram_size != config.ngram_size:
        raise ValueError(f"the model was trained with n={config.ngram_size}, not {ngram_size}")
    threshold = config.class_threshold if class_threshold is None else class_threshold
    vectors = cut(event_vectors(events, config, fn, exact_text, "attack"), "vectors")
    classified = cut(
        classify(vectors, model.vectors, model.labels, model.centroids, threshold, distance_to), "classes"
    )
    checked = check_sequence(sequence_labels(classified, unknown_label), model.bloom, config.ngram_size)
    return Detection(classified, checked)


@dataclass(frozen=True)
class Study:
    """Tables of a cluster study."""

    statistics: DataFrame
    refined: DataFrame
    refined_statistics: DataFrame
    matched: DataFrame
    sizes: DataFrame
    quality: DataFrame


def study(
    events: DataFrame,
    labels: DataFrame,
    config: RunConfig = RunConfig(),
    sizes: tuple[int, ...] = (2, 3),
    share: float = 0.8,
) -> Study:
    """Trace, refine, match and test a clustering of ``events(idx, raw)``.

    Noise rows get cluster numbers of their own here, unlike in training. The filter
    is built on the first ``share`` of the n-grams and tested on the rest.
    """
    traced = cut(trace(events, labels), "traced")
    refined = refine(traced, config.keep_prefixes or ("",))
    rebuilt = cut(labels_from_mapping(traced), "labels")
    matched = cut(match_shorter(events, rebuilt), "matched")
    wanted = sorted({config.ngram_size, *sizes})
    ngrams = cut(label_ngrams(matched, config.ngram_size, "cluster_id"), "ngrams")
    known, test = split_by_position(ngrams, share)
    bloom = build_filter(known, config.bloom_error_rate)
    return Study(
        cluster_statistics(traced),
        refined,
        refined_statistics(refined),
        matched,
        compare_sizes(matched, wanted, label="cluster_id"),
        filter_quality(bloom, known, test),
    )
