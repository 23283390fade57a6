"""Clusters traced back to events: rows, summaries, statistics, mapping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.text import EVENT_FIELDS, MISSING, field_or_default, fields
from labeltrail.scratch import cut

# Column names of the three field statistics.
STAT_NAMES = {"processName": "process", "eventName": "event", "syscall": "syscall"}
UNIQUE_NAMES = {"processName": "unique_processes", "eventName": "unique_events", "syscall": "unique_syscalls"}
INDEX_CHUNK = 100_000


def trace(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with their cluster, by position."""
    return events.join(labels.select("idx", "cluster_id"), "idx")


def cluster_rows(traced: DataFrame, cluster_id: int) -> DataFrame:
    """Rows of one cluster; empty if there is none."""
    return traced.filter(F.col("cluster_id") == cluster_id)


def cluster_summary(traced: DataFrame, data: str = "raw") -> DataFrame:
    """Rows, first position and first row of every cluster.

    Positions are aggregated alone; the text is fetched for the first ones only.
    """
    firsts = traced.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"), F.min("idx").alias("first_idx"))
    rows = traced.select(F.col("idx").alias("first_idx"), F.col(data).alias("sample_data"))
    return firsts.join(rows, "first_idx").select("cluster_id", "cnt", "first_idx", "sample_data")


def cluster_indices(labels: DataFrame, chunk: int = INDEX_CHUNK) -> DataFrame:
    """Positions of every cluster as sorted lists, one list per ``chunk`` positions.

    The lists of a cluster in order of ``part`` are its whole index list; no single
    list grows with the cluster.
    """
    part = F.floor(F.col("idx") / chunk).cast("bigint")
    return labels.groupBy("cluster_id", part.alias("part")).agg(
        F.sort_array(F.collect_list("idx")).alias("indices")
    )


def top_clusters(traced: DataFrame, top_n: int = 10, data: str = "raw") -> DataFrame:
    """Largest clusters with a sample row; ties by first position."""
    return cluster_summary(traced, data).orderBy(F.desc("cnt"), "first_idx").limit(top_n)


def cluster_counts(labels: DataFrame) -> DataFrame:
    """Rows per cluster, in cluster order."""
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt")).orderBy("cluster_id")


def largest_cluster_head(traced: DataFrame, rows: int = 3) -> DataFrame:
    """First rows of the largest cluster."""
    largest = top_clusters(traced, 1).select("cluster_id")
    return traced.join(F.broadcast(largest), "cluster_id", "left_semi").orderBy("idx").limit(rows)


def _field_values(traced: DataFrame, values: dict[str, Column], present: dict[str, Column]) -> DataFrame:
    """``cluster_id, field, value`` rows for the values that count."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("field"), values[name].alias("value"), present[name].alias("present"))
        for name in EVENT_FIELDS
    ])
    exploded = traced.select("cluster_id", F.explode(pairs).alias("p"))
    return exploded.filter("p.present").select("cluster_id", "p.field", "p.value")


def _statistics(traced: DataFrame, field_values: DataFrame) -> DataFrame:
    """Distinct and most common value per cluster and field, by two counting steps.

    Values are counted per (cluster, value) first, so a large cluster is spread over
    its values and a frequent value is combined before the shuffle. Null counts as a
    value; the smallest of equally common values wins, null last.
    """
    counts = field_values.groupBy("cluster_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col("value").isNull().alias("is_null"), F.col("value"))
    per_field = counts.groupBy("cluster_id").pivot("field", list(EVENT_FIELDS)).agg(
        F.count(F.lit(1)).alias("unique"), F.min_by("value", order).alias("common")
    )
    sizes = traced.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"))
    return sizes.join(per_field, "cluster_id", "left").select(
        "cluster_id",
        "cnt",
        *[F.coalesce(f"{f}_unique", F.lit(0)).alias(UNIQUE_NAMES[f]) for f in EVENT_FIELDS],
        *[F.col(f"{f}_common").alias(f"most_common_{STAT_NAMES[f]}") for f in EVENT_FIELDS],
    ).orderBy(F.desc("cnt"), "cluster_id")


def cluster_statistics(traced: DataFrame, data: str = "raw") -> DataFrame:
    """Field statistics per cluster; an absent field counts as ``N/A``."""
    with_fields = traced.select("cluster_id", fields(data, names=EVENT_FIELDS).alias("_f"))
    values = {name: field_or_default("_f", name, MISSING) for name in EVENT_FIELDS}
    present = {name: F.lit(True) for name in EVENT_FIELDS}
    return _statistics(traced, _field_values(with_fields, values, present))


def refine(traced: DataFrame, keep_prefixes: tuple[str, ...], data: str = "raw") -> DataFrame:
    """``cluster_id, idx, filtered``: the top-level fields with a kept prefix."""
    return traced.select("cluster_id", "idx", fields(data, keep_prefixes=tuple(keep_prefixes)).alias("filtered"))


def refined_statistics(refined: DataFrame) -> DataFrame:
    """Field statistics over the fields that are there; 0 and null when there are none."""
    values = {name: F.try_element_at("filtered", F.lit(name)) for name in EVENT_FIELDS}
    present = {name: F.map_contains_key("filtered", name) for name in EVENT_FIELDS}
    return _statistics(refined, _field_values(refined, values, present))


def refined_samples(refined: DataFrame) -> DataFrame:
    """First refined row of every cluster."""
    firsts = refined.groupBy("cluster_id").agg(F.min("idx").alias("idx"))
    return firsts.join(refined.select("idx", F.col("filtered").alias("sample_data")), "idx").drop("idx")


def field_names(refined: DataFrame) -> list[str]:
    """All field names seen, sorted."""
    names = refined.select(F.explode(F.map_keys("filtered")).alias("name")).distinct()
    return sorted(row.name for row in names.collect())


def flatten_long(refined: DataFrame) -> DataFrame:
    """A row for each field: ``cluster_id, index, name, value``. Any number of names is fine."""
    return refined.select("cluster_id", F.col("idx").alias("index"), F.explode("filtered").alias("name", "value"))


def flatten(refined: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Wide table: cluster, position, then one column for each of ``names``, or of all names found."""
    if names is None:
        refined = cut(refined, "refined")  # read twice
        names = field_names(refined)
    return refined.select(
        "cluster_id",
        F.col("idx").alias("index"),
        *[F.try_element_at("filtered", F.lit(name)).alias(name) for name in names],
    )


def write_mapping(traced: DataFrame, path: str, data: str = "raw", max_rows: int = 1_000_000) -> None:
    """Mapping as a table ``cluster_id, idx, data``, one folder per cluster.

    Ranges of (cluster, position) give small clusters few files and split large ones.
    """
    rows = traced.select("cluster_id", "idx", F.col(data).alias("data"))
    rows.repartitionByRange("cluster_id", "idx").write.option(
        "maxRecordsPerFile", max_rows
    ).partitionBy("cluster_id").mode("overwrite").parquet(path)


def read_mapping(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("cluster_id").cast("int"), "idx", "data")


def mapping_totals(mapping: DataFrame) -> DataFrame:
    """Clusters and rows of a mapping, one row."""
    return mapping.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("total_clusters"), F.sum("n").alias("total_samples")
    )


def write_mapping_json(traced: DataFrame, path: str, data: str = "raw", chunk: int = 10_000) -> None:
    """Mapping as nested JSON lines, a cluster cut into lines of at most ``chunk`` positions."""
    part = F.floor(F.col("idx") / chunk).cast("bigint")
    traced.groupBy("cluster_id", part.alias("part")).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_list(F.struct("idx", data))).alias("rows"),
    ).select(
        "cluster_id",
        "part",
        "count",
        F.transform("rows", lambda r: r["idx"]).alias("indices"),
        F.transform("rows", lambda r: F.struct(r["idx"].alias("index"), r[data].alias("data"))).alias("data"),
    ).write.mode("overwrite").json(path)


def read_mapping_json(spark, path: str) -> DataFrame:
    """Rows of a nested JSON mapping."""
    schema = "cluster_id int, part bigint, data array<struct<index: bigint, data: string>>"
    return spark.read.schema(schema).json(path).select(
        "cluster_id", F.explode("data").alias("d")
    ).select("cluster_id", F.col("d.index").alias("idx"), F.col("d.data").alias("data"))
