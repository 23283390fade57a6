"""Connected components by alternating star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.scratch import Rounds


def _smallest(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(other).alias("m"))


def _large_star(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """Every larger neighbour of a vertex is linked to its smallest neighbour.

    The smallest neighbours are written first: a join of two plain tables is one whose
    busy keys (the centre of a star has all its edges) Spark splits over several tasks.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    smallest = rounds.cut(_smallest(both, "u", "v").select("u", F.least("m", "u").alias("m")), "smallest")
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is linked to the smallest."""
    smallest = rounds.cut(_smallest(edges, "hi", "lo"), "smallest")
    moved = edges.join(smallest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(smallest.select("hi", F.col("m").alias("lo")))


def _is_done(edges: DataFrame) -> bool:
    """Whether every edge goes straight to a root: one edge up at most, none above it."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    degree = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degree.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``id, root``: root is the smallest id of the component.

    Vertices without an edge do not appear.
    """
    links = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    rounds = Rounds(edges.sparkSession)
    current = rounds.cut(links.distinct(), "links")
    while not _is_done(current):
        rounds.end()
        large = rounds.cut(_large_star(current, rounds), "large")
        current = rounds.cut(_small_star(large, rounds).distinct(), "links")
    stars = current.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    roots = current.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return stars.unionByName(roots)
