"""Text to vector: a user's model function or the built-in hashed-token vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.vectors import l2_normalize
from labeltrail.operators.heavy import lookup
from labeltrail.scratch import cut

# Fixed value: a token that every text starts with, so that no vector is empty.
START_TOKEN = "[CLS]"

EmbedFunction = Callable[[pd.Series], np.ndarray]


def tokens(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.array(F.lit(START_TOKEN)), F.split(F.lower(text), " "))


def hashed_vectors(texts: DataFrame, key: str, text_col: str = "text", dim: int = 64) -> DataFrame:
    """``key, embedding``: signed token hashes summed into ``dim`` slots, unit length.

    Tokens are counted per (row, slot) before the shuffle, so a long text costs at
    most ``dim`` shuffled rows.
    """
    token = F.explode(tokens(text_col)).alias("token")
    number = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint")
    slots = (
        texts.select(key, token)
        .withColumn("_h", number)
        .select(
            key,
            (F.col("_h") % dim).alias("slot"),
            F.when(F.floor(F.col("_h") / dim) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
        )
        .groupBy(key, "slot")
        .agg(F.sum("sign").alias("v"))
    )
    filled = slots.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m")
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)),
    )
    return filled.select(key, l2_normalize(dense).alias("embedding"))


def distinct_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every text once: ``text_id`` (md5), text, and its number of rows ``_rows``."""
    return (
        df.groupBy(text_col)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(F.md5(text_col).alias("text_id"), F.col(text_col).alias("text"), "_rows")
    )


def _model_vectors(texts: DataFrame, fn: EmbedFunction) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(fn(batch), dtype=np.float64)))

    return texts.select("text_id", apply("text").alias("embedding"))


def embed_distinct(texts: DataFrame, fn: EmbedFunction | None = None, dim: int = 64) -> DataFrame:
    """``text_id, embedding`` for a table of distinct texts."""
    if fn is None:
        return hashed_vectors(texts, "text_id", "text", dim)
    return _model_vectors(texts, fn)


def embed(
    df: DataFrame,
    text_col: str = "text",
    fn: EmbedFunction | None = None,
    dim: int = 64,
    cache: DataFrame | None = None,
) -> DataFrame:
    """Add ``embedding`` to every row; equal texts are embedded once.

    ``fn`` maps a batch of texts to a matrix, one row per text. ``cache`` is a
    table ``text_id, embedding`` of vectors made earlier.
    """
    texts = cut(distinct_texts(df, text_col), "texts")
    if cache is None:
        vectors = embed_distinct(texts, fn, dim)
    else:
        fresh = embed_distinct(new_texts(texts, cache), fn, dim)
        vectors = fresh.unionByName(cache.select("text_id", "embedding"))
    table = texts.select("text_id", "_rows").join(vectors, "text_id")
    keyed = df.withColumn("text_id", F.md5(text_col))
    return lookup(keyed, table, "text_id", "_rows").drop("text_id")


def new_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts that the cache does not hold yet."""
    return texts.join(cache.select("text_id"), "text_id", "left_anti")


def mean_pool(token_vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean of all token vectors per key: one row per token in, one per key out."""
    means = (
        token_vectors.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))
