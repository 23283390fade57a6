"""Sliding label n-grams, their counts and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.operators.position import with_position


def ngram_text(ngram: str | Column) -> Column:
    """Text key of an n-gram: ``(4, 5)``, and ``(4,)`` for a single label."""
    ngram = F.col(ngram) if isinstance(ngram, str) else ngram
    body = F.array_join(F.transform(ngram, lambda x: x.cast("string")), ", ")
    tail = F.when(F.size(ngram) == 1, ",)").otherwise(")")
    return F.concat(F.lit("("), body, tail)


def _gapless_start(rows: DataFrame, pos: str) -> int | None:
    """Smallest position if the unique positions have no gap."""
    ends = rows.agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return ends.lo if ends.n and ends.hi - ends.lo + 1 == ends.n else None


def label_ngrams(
    seq: DataFrame,
    n: int,
    label: str = "label",
    pos: str = "idx",
    keys: tuple[str, ...] = (),
    bucket_rows: int = 8192,
) -> DataFrame:
    """All n-grams of a label sequence in steps of one: ``start_idx, ngram``.

    The sequence is global unless ``keys`` are given. Positions are cut into
    equal buckets and the first n-1 rows of a bucket are copied to the one before,
    so each bucket yields its n-grams alone: one shuffle, and no long sequence or
    busy key ends up in one task. ``pos`` must be unique; where it has gaps, or with
    ``keys``, rows are numbered anew first.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    columns = list(dict.fromkeys([*keys, pos, label]))
    rows = seq.select(*columns)
    first = None if keys else _gapless_start(rows, pos)
    if first is None:
        rows = with_position(rows, [*keys, pos], "_pos")
    else:
        rows = rows.withColumn("_pos", F.col(pos) - first)

    width = max(bucket_rows, n)
    own = F.floor(F.col("_pos") / width).cast("bigint")
    if n > 1:
        halo = (F.pmod(F.col("_pos"), F.lit(width)) < n - 1) & (own > 0)
        homes = F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))
        rows = rows.withColumn("_own", own).withColumn("_bucket", F.explode(homes))
    else:
        rows = rows.withColumn("_own", own).withColumn("_bucket", own)

    ordered = Window.partitionBy("_bucket").orderBy("_pos")
    rows = rows.withColumn(
        "ngram", F.collect_list(F.col(label).cast("int")).over(ordered.rowsBetween(0, n - 1))
    )
    keep = (F.col("_own") == F.col("_bucket")) & (F.size("ngram") == n)
    for key in keys:
        rows = rows.withColumn(f"_end_{key}", F.lead(key, n - 1).over(ordered))
        keep = keep & F.col(key).eqNullSafe(F.col(f"_end_{key}"))
    return rows.filter(keep).select(*keys, F.col(pos).alias("start_idx"), "ngram")


def count_ngrams(ngrams: DataFrame) -> DataFrame:
    """Occurrences and first start of every distinct n-gram."""
    return ngrams.groupBy("ngram").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("start_idx").alias("first_idx")
    )


def top_ngrams(ngrams: DataFrame, top_k: int = 10) -> DataFrame:
    """The ``top_k`` most frequent n-grams, ties first-seen first, with their share."""
    counts = count_ngrams(ngrams)
    total = counts.agg(F.sum("cnt")).scalar()
    return (
        counts.orderBy(F.desc("cnt"), "first_idx")
        .limit(top_k)
        .select(
            ngram_text("ngram").alias("ngram"),
            "cnt",
            "first_idx",
            F.round(100.0 * F.col("cnt") / total, 2).alias("percent"),
        )
    )


def ngram_totals(ngrams: DataFrame) -> DataFrame:
    """Total and distinct n-gram counts, one row."""
    return count_ngrams(ngrams).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_ngrams"),
        F.count(F.lit(1)).alias("unique_ngrams"),
    )


def compare_sizes(seq: DataFrame, sizes: list[int], **options) -> DataFrame:
    """Totals for several n on the same sequence, one row per n."""
    parts = [
        ngram_totals(label_ngrams(seq, n, **options)).select(F.lit(n).alias("n"), "*")
        for n in sizes
    ]
    return reduce(DataFrame.unionByName, parts)
