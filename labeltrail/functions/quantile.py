"""Exact medians of data too large to gather: histogram passes that close in."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
FETCH_ROWS = 20_000

# histogram(lo, hi, bins) -> {bin: (count, smallest, largest value)}; bin -1 is below lo,
# ``bins`` above hi.
Histogram = Callable[[float, float, int], dict[int, tuple[int, float, float]]]
# values(lo, hi) -> count below lo, and [(value, count)] sorted by value for lo <= value <= hi.
Values = Callable[[float, float], tuple[int, list[tuple[float, int]]]]


def bin_width(lo: float, hi: float, bins: int) -> float:
    return (hi - lo) / bins


def exact_median(
    histogram: Histogram, values: Values, lo: float, hi: float, room: float = 0.0,
    guess: tuple[float, float] | None = None, bins_wanted: int = BINS, fetch_rows: int = FETCH_ROWS,
) -> float | None:
    """Median by rank over ``[lo, hi]``, mean of the two middle values when even.

    Every pass counts again what lies below the interval, and the next interval runs
    between values that are there. ``room`` is how much a value may differ from pass
    to pass by rounding. ``guess`` is the interval of the first pass; if its counts show that
    the median is not in it, the next pass takes ``[lo, hi]``.
    """
    whole = (lo, hi)
    lo, hi = guess or whole
    while True:
        bins = histogram(lo, hi, bins_wanted)
        total = sum(count for count, _, _ in bins.values())
        if total == 0:
            return None
        ranks = ((total - 1) // 2, total // 2)
        below = bins[-1][0] if -1 in bins else 0
        inside = {b: bins[b] for b in sorted(bins) if 0 <= b < bins_wanted}
        if not below <= ranks[0] <= ranks[1] < below + sum(count for count, _, _ in inside.values()):
            if (lo, hi) == whole:
                raise ValueError(f"values outside of {whole}")
            lo, hi = whole
            continue
        first, last = _bins_of(inside, below, ranks)
        if max(first[2] - first[1], last[2] - last[1]) <= 4 * room:
            return (first[1] + last[1]) / 2.0
        lo, hi = first[1] - room, last[2] + room
        if sum(count for count, low, high in inside.values() if high >= lo and low <= hi) <= fetch_rows:
            return _pick(*values(lo, hi), ranks)


def _bins_of(
    inside: dict[int, tuple[int, float, float]], below: int, ranks: tuple[int, int]
) -> list[tuple[int, float, float]]:
    """The bins that hold the two middle ranks."""
    seen, found = below, []
    for entry in inside.values():
        seen += entry[0]
        while len(found) < 2 and ranks[len(found)] < seen:
            found.append(entry)
    return found


def _pick(below: int, pairs: list[tuple[float, int]], ranks: tuple[int, int]) -> float:
    seen, found = below, []
    for value, count in pairs:
        seen += count
        while len(found) < 2 and ranks[len(found)] < seen:
            found.append(value)
    return (found[0] + found[1]) / 2.0


def column_median(df: DataFrame, value: str, weight: str) -> float | None:
    """Exact weighted median of a column."""
    v, w = F.col(value), F.col(weight)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if ends.lo is None:
        return None

    def histogram(lo: float, hi: float, bins: int) -> dict[int, tuple[int, float, float]]:
        width = bin_width(lo, hi, bins) or math.inf
        place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        b = F.when(v < lo, -1).when(v > hi, bins).otherwise(place).cast("int")
        found = df.groupBy(b.alias("b")).agg(F.sum(w).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        return {r.b: (r.n, r.low, r.high) for r in found.collect()}

    def values(lo: float, hi: float) -> tuple[int, list[tuple[float, int]]]:
        kept = F.when(v >= lo, v)  # null stands for all values below
        rows = df.filter(v <= hi).groupBy(kept.alias("v")).agg(F.sum(w).alias("n")).collect()
        below = sum(r.n for r in rows if r.v is None)
        return below, sorted((r.v, r.n) for r in rows if r.v is not None)

    return exact_median(histogram, values, ends.lo, ends.hi)
