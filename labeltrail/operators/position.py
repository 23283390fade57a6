"""Dense global positions and position-based row choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from labeltrail.scratch import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_position(df: DataFrame, order_by: list[str | Column], name: str = "idx") -> DataFrame:
    """Add 0, 1, 2, ... in the given total order, without a one-task window.

    Rows are range-partitioned and sorted; a position is the number of rows in
    the earlier partitions plus the row's place in its own. Only one count per
    partition is gathered.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    fixed = cut(ranged, "position").withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    low_bits = F.lit((1 << _ROW_BITS) - 1).cast("bigint")
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row").bitwiseAND(low_bits))
        .drop("_part", "_row", "_offset")
    )


def shuffle_rows(df: DataFrame, seed: int = 42, key: str = "idx") -> DataFrame:
    """Seeded random order; every row keeps its ``idx``, so nothing comes apart."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def head_sample(df: DataFrame, n: int, key: str = "idx") -> DataFrame:
    """First ``n`` rows in sequence order, for inspection."""
    return df.orderBy(key).limit(n)


def split_by_position(
    df: DataFrame, share: float = 0.8, pos: str = "start_idx"
) -> tuple[DataFrame, DataFrame]:
    """First ``floor(share * rows)`` rows by position, and the rest.

    Positions may start anywhere, have gaps and repeat (n-grams of several keys); rows of one position
    are told apart by their other columns.
    """
    rows, first, last = df.agg(F.count(F.lit(1)), F.min(pos), F.max(pos)).first()
    cutoff = int(rows * share)
    if rows and last - first + 1 == rows and df.select(pos).distinct().count() == rows:  # each position once: ranks are known
        return df.filter(F.col(pos) < first + cutoff), df.filter(F.col(pos) >= first + cutoff)
    plain = [f.name for f in df.schema.fields if f.name != pos and not isinstance(f.dataType, (MapType, VariantType))]
    ranked = with_position(df, [pos, *plain], "_rank")
    return ranked.filter(F.col("_rank") < cutoff).drop("_rank"), ranked.filter(F.col("_rank") >= cutoff).drop("_rank")
