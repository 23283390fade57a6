"""A trained model as tables in a versioned folder."""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.config import RunConfig
from labeltrail.operators.bloom import BloomFilter

# The tables of a run.
TABLES = ("vectors", "labels", "centroids", "ngrams", "ngram_counts")


@dataclass(frozen=True)
class Model:
    """Tables and parameters of one training run; every part may be missing."""

    config: RunConfig
    vectors: DataFrame | None = None
    labels: DataFrame | None = None
    centroids: DataFrame | None = None
    ngrams: DataFrame | None = None
    ngram_counts: DataFrame | None = None
    bloom: BloomFilter | None = None
    info: dict = field(default_factory=dict)

    def require(self, *parts: str) -> None:
        missing = [part for part in parts if getattr(self, part) is None]
        if missing:
            raise ValueError(f"the model lacks {', '.join(missing)}")


def _write_text(spark: SparkSession, path: str, values: dict) -> None:
    text = json.dumps(values, ensure_ascii=False, default=str)
    row = spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    row.write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_model(spark: SparkSession, model: Model, path: str) -> str:
    """Write the parts there are to a new version folder, then point ``current`` at it.

    A run that fails half-way leaves ``current`` on the version before.
    """
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    version = f"{stamp}-{uuid.uuid4().hex[:8]}"
    root = f"{path.rstrip('/')}/{version}"
    parts = []
    for name in TABLES:
        table = getattr(model, name)
        if table is not None:
            table.write.parquet(f"{root}/{name}")
            parts.append(name)
    if model.bloom is not None:
        model.bloom.table.write.parquet(f"{root}/bloom")
        _write_text(spark, f"{root}/bloom_params", model.bloom.params())
        parts.append("bloom")
    _write_text(
        spark, f"{root}/run", {"config": model.config.as_dict(), "info": model.info, "parts": parts}
    )
    _write_text(spark, f"{path.rstrip('/')}/current", {"version": version})
    return root


def load_model(spark: SparkSession, path: str, version: str | None = None) -> Model:
    """Read a run back; a missing part gives a warning and stays None."""
    version = version or _read_text(spark, f"{path.rstrip('/')}/current")["version"]
    root = f"{path.rstrip('/')}/{version}"
    run = _read_text(spark, f"{root}/run")
    config = dict(run["config"])
    if config.get("keep_prefixes") is not None:
        config["keep_prefixes"] = tuple(config["keep_prefixes"])
    model = Model(RunConfig(**config), info=run["info"])
    for name in TABLES:
        table = _read_table(spark, root, name)
        if table is not None:
            model = replace(model, **{name: table})
    words = _read_table(spark, root, "bloom")
    if words is not None:
        params = _read_text(spark, f"{root}/bloom_params")
        model = replace(model, bloom=BloomFilter(words, **params))
    return model


def _read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        warnings.warn(f"the model has no {name}", stacklevel=3)
        return None
