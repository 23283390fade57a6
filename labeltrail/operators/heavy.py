"""Look-up joins that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from labeltrail.scratch import cut

HEAVY_KEYS_LIMIT = 2_000
BROADCAST_BYTES = 64 << 20
_FIXED_SIZE = (NumericType, BooleanType, DateType, TimestampType)


def _written_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values that can be long, written as text."""
    long = [f.name for f in df.schema.fields if not isinstance(f.dataType, _FIXED_SIZE)]
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("bigint") for c in long]
    return reduce(Column.__add__, sizes, F.lit(0).cast("bigint"))


def lookup(
    left: DataFrame, right: DataFrame, key: str, weight: str, limit: int = HEAVY_KEYS_LIMIT
) -> DataFrame:
    """Left join to a table with one row per ``key`` and its row count ``weight``.

    Keys that hold more than 1/``limit`` of all rows, so fewer than ``limit`` of
    them, are broadcast and their rows never move; the others take a hash join.
    ``right`` is written once, as it is read several times; ``left`` is read twice. Should the frequent keys
    carry more than 64 MB, all rows take the join of the two tables, whose busy keys Spark can split.
    """
    right = cut(right, "lookup")
    size = _written_bytes(right)
    keys, total, longest = right.agg(F.count(F.lit(1)), F.sum(weight), F.max(size)).first()
    total = total or 0
    if keys < limit and (longest or 0) * keys <= BROADCAST_BYTES:  # all of them are few
        return left.join(F.broadcast(right.drop(weight)), key, "left")
    heavy = right.filter(F.col(weight) * limit > total)
    light = right.filter(F.col(weight) * limit <= total)
    payload = [c for c in right.columns if c not in (key, weight)]
    if (longest or 0) * limit > BROADCAST_BYTES and (heavy.agg(F.sum(size)).first()[0] or 0) > BROADCAST_BYTES:
        return left.join(right.select(key, *payload), key, "left")
    tagged = left.join(
        F.broadcast(heavy.select(key, F.lit(True).alias("_heavy"), *payload)), key, "left"
    )
    done = tagged.filter("_heavy").drop("_heavy")
    rest = (
        tagged.filter(F.col("_heavy").isNull())
        .drop("_heavy", *payload)
        .join(light.select(key, *payload), key, "left")
    )
    return done.unionByName(rest)
