"""Training and detection from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from labeltrail.config import RunConfig
from labeltrail.operators.detect import anomalies, class_counts, class_summary, match_summary, top_assigned_clusters
from labeltrail.operators.ngrams import top_ngrams
from labeltrail.plans.runs import detect, train
from labeltrail.scratch import clear
from labeltrail.sources.events import read_events
from labeltrail.sources.store import load_model, save_model


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="labeltrail")
    steps = parser.add_subparsers(dest="step", required=True)
    for step in ("train", "detect"):
        part = steps.add_parser(step)
        part.add_argument("-p", "--path", required=True, help="JSON-lines event log")
        part.add_argument("-m", "--model", required=True, help="model folder")
    defaults = RunConfig()
    part = steps.choices["train"]
    part.add_argument("--method", default=defaults.clustering_method)
    part.add_argument("--alpha", type=float, default=defaults.clustering_alpha)
    part.add_argument("--n", type=int, default=defaults.ngram_size)
    part.add_argument("--error-rate", type=float, default=defaults.bloom_error_rate)
    part.add_argument("--threshold", type=float, default=defaults.class_threshold)
    part.add_argument("--keep-prefixes", type=RunConfig.parse_prefixes, default=defaults.keep_prefixes)
    part.add_argument("--zero-eps", default=defaults.zero_eps)
    part.add_argument("--score", default="none")
    part.add_argument("--bandwidth-rows", type=int, default=defaults.bandwidth_rows)
    part.add_argument("--top-n", type=int, default=defaults.top_n_clusters)
    part.add_argument("--shuffle", action="store_true", help="read the events in a seeded random order")
    steps.choices["detect"].add_argument("-o", "--output", required=True, help="folder for classes, counts, anomalies and rejects")
    return parser.parse_args()


def main() -> None:
    given = _arguments()
    spark = SparkSession.builder.appName("labeltrail").getOrCreate()
    log = read_events(spark, given.path, shuffle=given.step == "train" and given.shuffle)
    events = log.events
    print(f"{log.rejects.count()} lines are no events")
    if given.step == "train":
        config = RunConfig(
            clustering_method=given.method, clustering_alpha=given.alpha, ngram_size=given.n,
            bloom_error_rate=given.error_rate, class_threshold=given.threshold,
            keep_prefixes=given.keep_prefixes, zero_eps=given.zero_eps, bandwidth_rows=given.bandwidth_rows,
            top_n_clusters=given.top_n, shuffle=given.shuffle,
        )
        model = train(events, config, score=given.score)
        save_model(spark, model, given.model)
        top_ngrams(model.ngrams, config.top_n_clusters).write.mode("overwrite").json(f"{given.model}/top-ngrams")
        log.rejects.write.mode("overwrite").json(f"{given.model}/rejects")
    else:
        model = load_model(spark, given.model)
        found = detect(events, model)
        tables = {
            "classified": found.classified, "class-counts": class_counts(found.classified),
            "class-summary": class_summary(found.classified),
            "top-clusters": top_assigned_clusters(found.classified, model.config.top_n_clusters),
            "checked-summary": match_summary(found.checked), "anomalies": anomalies(found.checked), "rejects": log.rejects,
        }
        for name, table in tables.items():
            table.write.mode("overwrite").json(f"{given.output}/{name}")
    clear(spark)


if __name__ == "__main__":
    main()
