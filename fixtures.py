"""Inputs for the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.functions.vectors import l2_normalize
from labeltrail.scratch import new_path

NOISE_ABOVE = 150.0
EVENT_LABELS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_label() -> Column:
    label = F.when(F.col("value") > NOISE_ABOVE, -1)
    for event_type, number in EVENT_LABELS.items():
        label = label.when(F.col("event_type") == event_type, number)
    return label.cast("int")


def label_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order with a label per type, -1 above a value: ``idx, user_id, label``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), "user_id", event_label().alias("label")
    )


def event_line() -> Column:
    """One JSON line per event, with nested, null, missing and escaped parts."""
    syscall = (
        F.when(F.col("event_type") == "view", "")
        .when(F.col("value") > NOISE_ABOVE, ', "syscall": null')
        .otherwise(F.concat(F.lit(', "syscall": "sys_'), "event_type", F.lit('"')))
    )
    tag = F.when(F.col("event_type") == "error", ', "executableTag": "a\\u003cb"').otherwise("")
    return F.concat(
        F.lit('{"eventId": '), F.col("event_id").cast("string"),
        F.lit(', "processName": "u'), F.col("user_id").cast("string"),
        F.lit('", "eventName": "'), F.col("event_type"), F.lit('"'),
        syscall,
        F.lit(', "returnValue": '), F.floor("value").cast("string"),
        F.lit(', "args": [{"name": "k", "value": "'), F.replace("props", F.lit('"'), F.lit('\\"')),
        F.lit('"}], "executable": {"path": "/bin/'), F.col("event_type"), F.lit('"}'),
        tag,
        F.lit("}"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, raw, label``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), event_line().alias("raw"), event_label().alias("label")
    )


def traced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, raw, cluster_id`` with the event label as cluster."""
    return event_log(spark, sf_dir).withColumnRenamed("label", "cluster_id")


def write_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as text files in event order, with a cut line after each signup, a number after each click, a
    blank line after each purchase, an event with a doubled key after each error and one with text behind it after each view."""
    after = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit('{"eventId": '), F.col("event_id").cast("string"), F.lit(", ")))
        .when(F.col("event_type") == "click", F.col("event_id").cast("string"))
        .when(F.col("event_type") == "purchase", F.lit("  "))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"eventName": "x", "eventName": "d'), F.col("event_id").cast("string"), F.lit('", "n": NaN}')))
        .when(F.col("event_type") == "view", F.lit('{"eventName": "c"} junk'))
    )
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.posexplode(F.array(event_line(), after)).alias("part", "value")
    ).filter(F.col("value").isNotNull())
    path = new_path(spark, "event-log")
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id", "part").select("value").write.text(path)
    return path


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, embedding, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", "label")


def labels_of(rows: DataFrame) -> DataFrame:
    return rows.select("idx", F.col("label").alias("cluster_id"))


def folded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 components summed in three runs, unit length: vectors with dense places."""
    def run(start: int, length: int) -> Column:
        part = F.slice(F.col("embedding").cast("array<double>"), start, length)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    return vectors(spark, sf_dir).select(
        "idx", l2_normalize(F.array(run(1, 21), run(22, 21), run(43, 22))).alias("embedding")
    )
