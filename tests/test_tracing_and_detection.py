import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltrail.config import RunConfig
from labeltrail.operators import bloom, detect, sequence, trace
from labeltrail.operators.heavy import lookup
from labeltrail.plans import runs
from labeltrail.sources import store

EVENTS = [
    {"processName": "sh", "eventName": "open", "syscall": "open", "x": {"a": 1}},
    {"processName": "sh", "eventName": "read", "syscall": None},
    {"processName": "vi", "eventName": "read"},
    {"processName": "vi", "eventName": "read", "syscall": None, "argsNum": 2},
    {"eventName": "exec"},
]
LABELS = [0, 1, 1, 1, -1]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(EVENTS)], "idx long, raw string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(enumerate(LABELS)), "idx long, cluster_id int")


@pytest.fixture(scope="module")
def traced(log, labels):
    return trace.trace(log, labels)


def test_rows_and_summaries(traced):
    assert [r.idx for r in trace.cluster_rows(traced, 1).orderBy("idx").collect()] == [1, 2, 3]
    assert trace.cluster_rows(traced, 9).count() == 0
    rows = trace.top_clusters(traced, 2).collect()
    assert [(r.cluster_id, r.cnt, r.first_idx) for r in rows] == [(1, 3, 1), (0, 1, 0)]
    assert json.loads(rows[0].sample_data)["eventName"] == "read"
    assert [r.cnt for r in trace.cluster_counts(traced).collect()] == [1, 1, 3]
    assert [r.idx for r in trace.largest_cluster_head(traced, 2).collect()] == [1, 2]
    lists = trace.cluster_indices(traced, chunk=2).filter("cluster_id = 1").orderBy("part").collect()
    assert [r.indices for r in lists] == [[1], [2, 3]]


def test_statistics_count_missing_as_a_value(traced):
    rows = {r.cluster_id: r for r in trace.cluster_statistics(traced).collect()}
    assert (rows[1].cnt, rows[1].unique_processes, rows[1].unique_syscalls) == (3, 2, 2)
    assert (rows[1].most_common_process, rows[1].most_common_syscall) == ("vi", None)
    assert (rows[-1].unique_processes, rows[-1].most_common_process) == (1, "N/A")


def test_refined_statistics_count_present_fields_only(traced):
    refined = trace.refine(traced, ("processName", "syscall", "args"))
    rows = {r.cluster_id: r for r in trace.refined_statistics(refined).collect()}
    assert (rows[1].unique_syscalls, rows[1].most_common_syscall, rows[1].unique_events) == (1, None, 0)
    assert (rows[-1].unique_processes, rows[-1].most_common_process) == (0, None)
    wide = trace.flatten(refined)
    assert wide.columns == ["cluster_id", "index", "argsNum", "processName", "syscall"]
    assert wide.filter("argsNum = '2'").count() == 1
    samples = {r.cluster_id: r.sample_data for r in trace.refined_samples(refined).collect()}
    assert samples[0] == {"processName": "sh", "syscall": "open"}


def test_mapping_tables(spark, traced, tmp_path):
    trace.write_mapping(traced, str(tmp_path / "m"))
    trace.write_mapping_json(traced, str(tmp_path / "j"), chunk=2)
    want = sorted((r.cluster_id, r.idx, r.raw) for r in traced.collect())
    for read in (trace.read_mapping(spark, str(tmp_path / "m")), trace.read_mapping_json(spark, str(tmp_path / "j"))):
        assert sorted((r.cluster_id, r.idx, r.data) for r in read.collect()) == want
    totals = trace.mapping_totals(trace.read_mapping(spark, str(tmp_path / "m"))).first()
    assert (totals.total_clusters, totals.total_samples) == (3, 5)


def test_matching(spark, log, labels, tmp_path):
    matched = sequence.match_sequence(log, labels)
    assert [(r.idx, r.cluster_id) for r in matched.orderBy("idx").collect()] == list(enumerate(LABELS))
    with pytest.raises(ValueError):
        sequence.match_sequence(log, labels.filter("idx < 3"))
    with pytest.raises(ValueError):  # as many labels, at other positions
        sequence.match_sequence(log, labels.withColumn("idx", labels["idx"] + 2))
    assert sequence.match_shorter(log, labels.filter("idx < 3")).count() == 3
    gapped = sequence.match_shorter(log.filter("idx <> 1"), labels.withColumn("idx", labels["idx"] * 3))
    assert [(r.idx, r.cluster_id) for r in gapped.orderBy("idx").collect()] == list(enumerate(LABELS[:4]))
    for fmt in ("parquet", "json"):
        sequence.write_matched(matched, str(tmp_path / fmt), fmt)
        again = sequence.read_matched(spark, str(tmp_path / fmt), fmt)
        grams = sequence.ngrams_from_matched(again, 2).orderBy("start_idx").collect()
        assert [tuple(r.ngram) for r in grams] == [(0, 1), (1, 1), (1, 1), (1, -1)]


def test_labels_from_mapping(spark):
    mapping = spark.createDataFrame([(2, 0), (-1, 1), (0, 3), (-1, 4)], "cluster_id int, idx long")

    def values(**options):
        return [r.cluster_id for r in sequence.labels_from_mapping(mapping, **options).orderBy("idx").collect()]

    assert values() == [2, 3, 0, 0, 4]
    assert values(renumber_noise=False, gap_label=-5) == [2, -1, -5, 0, -1]
    only_noise = spark.createDataFrame([(-1, 0), (-1, 1)], "cluster_id int, idx long")
    assert [r.cluster_id for r in sequence.labels_from_mapping(only_noise).orderBy("idx").collect()] == [0, 1]
    with pytest.raises(ValueError):
        sequence.labels_from_mapping(mapping.limit(0))


def test_lookup_with_a_heavy_key(spark):
    left = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' else string(id % 200) end as k")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat("k", F.lit("!")))
    for limit in (1, 3, 2000):
        rows = lookup(left, right, "k", "n", limit).collect()
        assert len(rows) == 1000 and all(r.v == r.k + "!" for r in rows)


def unit(angle):
    return [float(np.cos(angle)), float(np.sin(angle))]


def test_classes(spark):
    base = spark.createDataFrame([(0, unit(0.0)), (1, unit(1.5)), (2, unit(3.0))], "idx long, embedding array<double>")
    labels = spark.createDataFrame([(0, 7), (1, 8), (2, -1)], "idx long, cluster_id int")
    centers = spark.createDataFrame(
        [(7, unit(0.0), 0.01), (8, unit(1.5), 0.0)], "cluster_id int, centroid array<double>, max_distance double")
    asked = spark.createDataFrame(
        [(0, unit(0.1)), (1, unit(0.6)), (2, unit(1.5)), (3, unit(-1.2)), (4, unit(3.0))],
        "idx long, embedding array<double>")
    rows = detect.classify(asked, base, labels, centers, 0.5).orderBy("idx").collect()
    assert [(r.cluster_id, r.class_id, r.is_unknown, r.within_max_distance) for r in rows] == [
        (7, 7, False, True), (7, 7, False, False), (8, 8, False, rows[2].within_max_distance),
        (7, None, True, False), (-1, None, True, False),
    ]
    classified = detect.classify(asked, base, labels, centers, 0.5)
    assert [r.label for r in detect.sequence_labels(classified).orderBy("idx").collect()] == [7, 7, 8, -1, -1]
    assert [r.label for r in detect.sequence_labels(classified, -2).orderBy("idx").collect()][3:] == [-2, -2]
    assert [(r["class"], r.cnt) for r in detect.class_counts(classified).collect()] == [("7", 2), ("unknown", 2), ("8", 1)]
    assert [(r.cluster_id, r.cnt) for r in detect.top_assigned_clusters(classified).collect()] == [(7, 3), (8, 1)]
    summary = detect.class_summary(classified).first()
    assert (summary.classified, summary.unknown) == (3, 2)
    by_center = detect.classify(asked, base, labels, centers, 0.5, "centroid").orderBy("idx").collect()
    assert by_center[0].distance == pytest.approx(1 - np.cos(0.1))


def test_match_summary_of_nothing(spark):
    row = detect.match_summary(spark.createDataFrame([], "start_idx long, is_member boolean")).first()
    assert (row.total_ngrams, row.matched_percent, row.unmatched_percent) == (0, 0.0, 0.0)


def lines(names):
    return [(i, json.dumps({"eventName": n, "n": i})) for i, n in enumerate(names)]


@pytest.fixture(scope="module")
def model(spark):
    normal = spark.createDataFrame(lines(["open", "read", "read", "close"] * 10), "idx long, raw string")
    config = RunConfig(clustering_method="agglomerative", clustering_alpha=4.0, ngram_size=2, bloom_error_rate=1e-6)
    return runs.train(normal, config, score="none")


def test_detection_finds_the_unseen_order(spark, model):
    attack = spark.createDataFrame(lines(["open", "read", "close", "open", "close"]), "idx long, raw string")
    result = runs.detect(attack, model)
    assert [r.start_idx for r in detect.anomalies(result.checked).collect()] == [3]
    assert detect.match_summary(result.checked).first().matched_percent == 75.0
    with pytest.raises(ValueError):
        runs.detect(attack, model, ngram_size=3)


def test_model_store(spark, model, tmp_path):
    store.save_model(spark, model, str(tmp_path))
    again = store.load_model(spark, str(tmp_path))
    assert again.config == model.config and again.bloom.params() == model.bloom.params()
    assert again.labels.count() == 40 and again.centroids.count() == 3
    attack = spark.createDataFrame(lines(["close", "close"]), "idx long, raw string")
    assert detect.anomalies(runs.detect(attack, again).checked).count() == 1

    empty = store.Model(model.config)
    store.save_model(spark, empty, str(tmp_path / "empty"))
    with pytest.warns(UserWarning):
        read = store.load_model(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        runs.detect(attack, read)


def test_study(log, labels):
    result = runs.study(log, labels, RunConfig(ngram_size=2, bloom_error_rate=1e-6))
    assert [r.cluster_id for r in result.matched.orderBy("idx").collect()] == [0, 1, 1, 1, 2]
    row = result.quality.first()
    assert (row.total_tested, row.true_negative) == (1, 1)
    assert [(r.n, r.total_ngrams) for r in result.sizes.collect()] == [(2, 4), (3, 3)]
    assert result.statistics.count() == result.refined_statistics.count() == 3


def test_prefix_list_keeps_empty_parts():
    assert RunConfig.parse_prefixes("a, b,") == ("a", "b", "")


def test_queries_have_sql_or_say_why(spark):
    import __spark_entry__ as entry

    names, sql = {q.__name__ for q in entry._QUERIES}, set(entry.oracle_sql())
    assert sql <= set(entry.queries())
    assert names - sql == {
        "vec_ivf", "kmeans_labels", "ward_labels", "meanshift_labels", "hdbscan_labels"
    }
