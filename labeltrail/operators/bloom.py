"""Approximate membership of n-grams: a Bloom filter held as a Spark table.

The filter is cut into shards of bounded capacity, each with bits for its own
exact count, so the error rate holds at every size. A key's shard and bit places
come from ``xxhash64`` with one seed each.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.heavy import lookup
from labeltrail.operators.ngrams import ngram_text
from labeltrail.scratch import cut

SHARD_CAPACITY = 100_000
BROADCAST_BYTES = 32 << 20
_SHARD_SEED = -1


@dataclass(frozen=True)
class BloomFilter:
    """``table(shard INT, m BIGINT, words ARRAY<BIGINT>)`` and its parameters."""

    table: DataFrame
    capacity: int
    error_rate: float
    hashes: int
    shards: int

    @property
    def size_bytes(self) -> int:
        return int(self.capacity * bits_per_key(self.error_rate) / 8) + 8 * self.shards

    def params(self) -> dict:
        return {
            "capacity": self.capacity,
            "error_rate": self.error_rate,
            "hashes": self.hashes,
            "shards": self.shards,
        }


def bits_per_key(error_rate: float) -> float:
    return -math.log(error_rate) / math.log(2) ** 2


def check_error_rate(error_rate: float) -> None:
    if not 0 < error_rate < 1:
        raise ValueError(f"error_rate must lie between 0 and 1, got {error_rate}")
    if error_rate < 1e-10:
        warnings.warn(f"error_rate {error_rate} makes a very large filter", stacklevel=3)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(_SHARD_SEED)), F.lit(shards)).cast("int")


def _places(key: Column, hashes: int, m: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), m) for i in range(hashes)])


def build_filter(
    ngrams: DataFrame, error_rate: float = 0.001, shard_capacity: int = SHARD_CAPACITY
) -> BloomFilter:
    """Filter over the distinct n-grams; capacity is their number."""
    check_error_rate(error_rate)
    keys = cut(ngrams.select("ngram").distinct().select(ngram_text("ngram").alias("key")), "keys")
    capacity = keys.count()
    if capacity == 0:
        raise ValueError("a filter needs at least one n-gram")
    hashes = max(1, round(-math.log2(error_rate)))
    shards = math.ceil(capacity / shard_capacity)

    keyed = keys.select("key", _shard(F.col("key"), shards).alias("shard"))
    sizes = keyed.groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) * F.lit(bits_per_key(error_rate))).cast("bigint").alias("m")
    )
    set_bits = (
        keyed.join(sizes, "shard")
        .select("shard", F.explode(_places(F.col("key"), hashes, F.col("m"))).alias("place"))
        .select(
            "shard",
            F.shiftright("place", 6).alias("word"),
            F.expr("shiftleft(1L, int(place & 63))").alias("bits"),
        )
    )
    blank = sizes.select(
        "shard",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("m") - 1, 6))).alias("word"),
        F.lit(0).cast("bigint").alias("bits"),
    )
    words = (
        set_bits.unionByName(blank)
        .groupBy("shard", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("pairs"))
        .select("shard", F.transform("pairs", lambda p: p["bits"]).alias("words"))
    )
    table = cut(sizes.join(words, "shard"), "filter")
    return BloomFilter(table, capacity, error_rate, hashes, shards)


def _probe(bloom: BloomFilter, counted: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``is_member`` to distinct n-grams.

    A filter below ``broadcast_bytes`` goes to every executor, a larger one is joined by shard. The bit
    tests are written out one by one: they stay in generated code, so no row gets a copy of its shard.
    """
    probes = counted.withColumn("_key", ngram_text("ngram")).withColumn("shard", _shard(F.col("_key"), bloom.shards))
    small = bloom.size_bytes <= broadcast_bytes
    joined = probes.join(F.broadcast(bloom.table) if small else bloom.table, "shard")
    hit = F.lit(True)
    for i in range(bloom.hashes):
        place = F.pmod(F.xxhash64("_key", F.lit(i)), F.col("m"))
        word = F.get("words", F.shiftright(place, 6).cast("int"))
        hit = hit & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return joined.select(*counted.columns, hit.alias("is_member"))


def _counted(ngrams: DataFrame) -> DataFrame:
    return ngrams.groupBy("ngram").agg(F.count(F.lit(1)).alias("_n"))


def check_ngrams(
    bloom: BloomFilter | None, ngrams: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``is_member`` to every n-gram row.

    Each distinct n-gram is probed once; the answers go back to the rows by a look-up
    that frequent n-grams do not bring out of balance.
    """
    if bloom is None:
        raise ValueError("no filter: build or load one first")
    answers = _probe(bloom, _counted(ngrams), broadcast_bytes)
    return lookup(ngrams, answers, "ngram", "_n").select(*ngrams.columns, "is_member")


def _known(known: DataFrame, counted: DataFrame) -> DataFrame:
    """Add ``is_known`` to distinct n-grams."""
    distinct_known = known.select("ngram").distinct().withColumn("_hit", F.lit(True))
    return counted.join(distinct_known, "ngram", "left").select(
        *counted.columns, F.coalesce("_hit", F.lit(False)).alias("is_known")
    )


def exact_membership(known: DataFrame, ngrams: DataFrame) -> DataFrame:
    """Add ``is_known``: whether the n-gram is among the known ones, exactly."""
    answers = _known(known, _counted(ngrams))
    return lookup(ngrams, answers, "ngram", "_n").select(*ngrams.columns, "is_known")


def unseen_ngrams(known: DataFrame, ngrams: DataFrame) -> DataFrame:
    """Rows whose n-gram was never seen."""
    return exact_membership(known, ngrams).filter(~F.col("is_known")).drop("is_known")


def filter_quality(bloom: BloomFilter, known: DataFrame, test: DataFrame) -> DataFrame:
    """Confusion counts over the test n-grams, repeats included, one row.

    ``false_positive_rate`` divides by all tests; ``fpr_negatives`` by the true
    negatives and false positives only.
    """
    # Tests collapse to distinct n-grams with counts before they meet the filter.
    counted = test.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))
    flags = _known(known, _probe(bloom, counted))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("cnt")).otherwise(0)), F.lit(0))

    member, truth = F.col("is_member"), F.col("is_known")
    sums = flags.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_tested"),
        total(truth & member).alias("true_positive"),
        total(~truth & member).alias("false_positive"),
        total(~truth & ~member).alias("true_negative"),
        total(truth & ~member).alias("false_negative"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    tp, fp, tn, fn = (
        F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative")
    )
    return sums.select(
        "*",
        ratio(fp, F.col("total_tested")).alias("false_positive_rate"),
        ratio(fp, fp + tn).alias("fpr_negatives"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )


def self_check(bloom: BloomFilter, ngrams: DataFrame, n: int = 10) -> DataFrame:
    """How many of the first ``n`` n-grams the filter finds, one row."""
    first = ngrams.orderBy("start_idx").limit(n)
    return check_ngrams(bloom, first).agg(
        F.count(F.lit(1)).alias("tested"), F.count_if("is_member").alias("found")
    )
