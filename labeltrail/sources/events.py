"""JSON-lines event logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.functions.text import OBJECT, event_text, line_kind
from labeltrail.operators.position import shuffle_rows, with_position


@dataclass(frozen=True)
class EventLog:
    """``events(idx, raw[, text, data_type])`` in file order, and the refused lines."""

    events: DataFrame
    rejects: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the columns that order them: file, start of the split, place in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("raw"),
    )


def sort_lines(lines: DataFrame, order_by: list[str]) -> EventLog:
    """Index the lines that hold a JSON object; blank lines vanish.

    Lines that are not JSON, or JSON but no object, are the rejects. Positions
    count the surviving lines only.
    """
    checked = lines.filter(F.col("raw").rlike(r"\S")).withColumn("_kind", line_kind("raw"))
    survivors = with_position(checked.filter(F.col("_kind") == OBJECT).drop("_kind"), order_by, "idx")
    rejects = checked.filter(F.col("_kind") != OBJECT).select("raw", F.col("_kind").alias("reason"))
    return EventLog(survivors.drop(*order_by), rejects)


def read_events(
    spark: SparkSession,
    path: str,
    keep_prefixes: tuple[str, ...] | None = None,
    data_type: str = "normal",
    exact_text: bool = True,
    shuffle: bool = False,
    seed: int = 42,
) -> EventLog:
    """Scan a log: position, raw line, event text and type of the set.

    A missing path raises, as Spark's reader does.
    """
    log = sort_lines(read_lines(spark, path), ["_file", "_start", "_line"])
    events = log.events.select(
        "idx",
        "raw",
        event_text("raw", keep_prefixes, exact_text).alias("text"),
        F.lit(data_type).alias("data_type"),
    )
    return EventLog(shuffle_rows(events, seed) if shuffle else events, log.rejects)


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """The log without texts: ``idx, raw``."""
    return sort_lines(read_lines(spark, path), ["_file", "_start", "_line"]).events.select("idx", "raw")
