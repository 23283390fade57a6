"""A vector collection: a parquet table with ids, positions and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.functions.vectors import as_double, l2_normalize
from labeltrail.operators.heavy import lookup
from labeltrail.operators.position import with_position
from labeltrail.operators.search import METRICS, search
from labeltrail.scratch import cut

SCHEMA = "id string, idx bigint, embedding array<float>, metadata map<string,string>, metric string"


@dataclass(frozen=True)
class Collection:
    """A named collection under ``path`` with a fixed metric."""

    spark: SparkSession
    path: str
    name: str
    metric: str = "flat"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}, expected one of {METRICS}")

    @property
    def location(self) -> str:
        return f"{self.path.rstrip('/')}/{self.name}"

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.location)
        except AnalysisException:
            return False
        return True

    def rows(self) -> DataFrame:
        """The stored table; a metric other than the stored one raises."""
        table = self.spark.read.schema(SCHEMA).parquet(self.location)
        stored = table.select("metric").first()
        if stored is not None and stored.metric != self.metric:
            raise ValueError(f"collection {self.name} holds {stored.metric} vectors, not {self.metric}")
        return table.drop("metric")

    def append(self, vectors: DataFrame, mode: str = "append") -> None:
        """Add ``vectors(idx, embedding[, metadata, id])``.

        ``idx`` orders the new rows; they go on from the rows already there, and ids
        default to ``{name}_{idx}``. All vectors must have one length. Cosine
        vectors are stored with unit length.
        """
        start, dim = 0, None
        if mode == "append" and self.exists():
            found = self.rows().agg(F.max("idx").alias("last"), F.max(F.size("embedding")).alias("d")).first()
            start, dim = (found.last if found.last is not None else -1) + 1, found.d
        sizes = vectors.agg(
            F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")
        ).first()
        if sizes.lo != sizes.hi or (dim is not None and sizes.hi not in (None, dim)):
            raise ValueError(f"vector length {sizes.lo}..{sizes.hi} does not fit, collection has {dim}")
        placed = with_position(vectors, ["idx"], "_place")
        place = F.col("_place") + F.lit(start)
        auto_id = F.concat(F.lit(f"{self.name}_"), place.cast("string"))
        values = l2_normalize("embedding") if self.metric == "cosine" else as_double("embedding")
        placed.select(
            (F.col("id") if "id" in vectors.columns else auto_id).alias("id"),
            place.alias("idx"),
            values.cast("array<float>").alias("embedding"),
            (F.col("metadata") if "metadata" in vectors.columns
             else F.create_map().cast("map<string,string>")).alias("metadata"),
            F.lit(self.metric).alias("metric"),
        ).write.mode(mode).parquet(self.location)

    def vectors(self) -> DataFrame:
        """All vectors with their position; order by ``idx`` for insert order."""
        return self.rows().select("idx", "embedding")

    def entries(self) -> DataFrame:
        """Ids and metadata."""
        return self.rows().select("id", "metadata")

    def info(self) -> DataFrame:
        """Name, size, vector length, metric and path, one row."""
        return collection_info(self.rows(), self.name, self.metric, self.path)

    def search(self, queries: DataFrame, k: int = 3, **options) -> DataFrame:
        """Top-k with id and metadata of every hit."""
        base = self.rows()
        hits = cut(search(queries, base, k=k, metric=self.metric, **options), "hits")
        # One row may be the hit of most queries: its metadata is fetched once.
        met = hits.groupBy("idx").agg(F.count(F.lit(1)).alias("_n")).join(base.select("idx", "id", "metadata"), "idx")
        return lookup(hits, met, "idx", "_n")


def collection_info(table: DataFrame, name: str, metric: str, path: str = "") -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("total_embeddings"), F.max(F.size("embedding")).alias("embedding_dim")
    ).select(
        F.lit(name).alias("collection_name"),
        "total_embeddings",
        "embedding_dim",
        F.lit(metric).alias("index_type"),
        F.lit(path).alias("persist_directory"),
    )
